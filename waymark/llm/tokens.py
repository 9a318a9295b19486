"""Token ids of whole texts by the tokenizers library, with a cache of pre-tokens.

Byte-level BPE merges only inside a pre-token, and the pre-tokens of a text whose blanks are single
spaces and single line feeds are those of its space-separated words. Such texts are put together from
the ids of their distinct words, and these from the ids of their distinct pre-tokens, all as arrays.
Pre-tokens not met before are encoded by the library's model, many as one text: between them stands the
letter of a byte that no UTF-8 text holds and no merge takes, so nothing merges across. Every other text
(double blanks, control characters, letters beyond Latin, special tokens) is encoded by the library as a
whole. The ids are the same either way.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of texts that cross to Python at once; Spark's own default of 10,000 can be gigabytes of long texts.
BATCH_ROWS = 1000
#: Most text, in bytes, and most rows that are encoded at once: the more, the more often a word is met again.
ENCODE_BYTES, ENCODE_ROWS = 4_000_000, BATCH_ROWS
#: Pre-tokens that a worker remembers (about 50 bytes each); beyond, it keeps the half that was met last.
CACHE_WORDS = 200_000
#: Pre-tokens that one call of the library encodes, and of those the ones that are one text.
AT_ONCE, JOINED = 10_000, 100
#: A text with a longer word, in bytes, is encoded as a whole.
LONG_WORD = 1 << 16

#: Characters whose class is the same in every edition of Unicode that a library may use.
_KNOWN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]]


_STRANGE = r"[^\n\x20-\x7e\x{a1}-\x{24f}]"
_LETTER, _NUMBER, _OTHER, _SPACE, _NEWLINE = range(5)


def _classes() -> np.ndarray:
    """The byte-level scheme's class of each character below U+0250."""
    out = np.full(0x250, _OTHER, np.uint8)
    for c in _KNOWN:
        out[ord(c)] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)
    out[0x20], out[0x0A] = _SPACE, _NEWLINE
    return out


_CLASSES = _classes()
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> np.ndarray:
    """The byte-level scheme's letter of each byte: itself if it is visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    letters = np.arange(256, dtype="<u2")
    letters[hidden] = 0x100 + np.arange(len(hidden))
    return letters


def _separator(model: dict, letters: np.ndarray) -> str | None:
    """A letter of the vocabulary that no merge takes, of a byte that no UTF-8 text holds."""
    merged = {c for m in model["merges"] for c in (m if isinstance(m, str) else "".join(m))}
    never = (chr(letters[b]) for b in [0xC0, 0xC1, *range(0xF5, 0x100)])
    return next((c for c in never if c in model["vocab"] and c not in merged), None)


def _starts(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the bytes of words (``words``: their starts), each led by a space or a line feed."""
    code = raw.astype(np.uint16)
    lead = np.flatnonzero(raw >= 0xC0)  # characters of two bytes
    code[lead] = (code[lead] & 0x1F) << 6 | code[lead + 1] & 0x3F
    kind = _CLASSES[code]
    kind[lead + 1] = kind[lead]
    start = np.ones(len(raw) + 3, bool)
    start[1 : len(raw)] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    start[words] = True
    quote = np.flatnonzero((raw == ord("'")) & start[: len(raw)])
    if len(quote):  # 's 't 'm 'd 're 've 'll
        after = np.append(raw, np.zeros(2, np.uint8))
        c, d = after[quote + 1], after[quote + 2]
        one = np.isin(c, list(b"stmd"))
        two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return np.flatnonzero(start[: len(raw)])


def _bytes_of(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings, and where each starts and the last ends."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _gather(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``begin`` and hold ``n``, one after the other."""
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - (end - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at]


def bounded(docs):
    """``docs``, in a session that sends at most ``BATCH_ROWS`` rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def let_go() -> None:
    """Give back what a worker still holds of other stages' tasks: encoders with their words, and memory that was freed."""
    _ENCODERS.clear()
    trim()


def trim() -> None:
    """Give back memory that a worker has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Encoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        model, letters = spec["model"], _byte_letters()
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            and all("<" in s for s in self.specials)
            and _separator(model, letters) is not None
        )
        self.cache_words, self.tick = cache_words, 0
        if self.by_word:
            self.newline = len(self._whole(["\n"])[0])
            self.model = Tokenizer(self.tokenizer.model)  # the model alone, for pre-tokens in byte letters
            self.letters, sep = letters, _separator(model, letters)
            self.sep, self.sep_id = ord(sep), model["vocab"][sep]
            self.known = pa.array([], pa.large_string())  # pre-tokens; their ids are runs of ``flat``
            self.flat, self.n = np.zeros(0, self.dtype), np.zeros(0, np.int64)
            self.met = np.zeros(0, np.int64)  # when each was met last

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (null: none), in the encoder's ``dtype``."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not self.by_word:
            return self._whole(column.to_pylist())
        return self._by_word(column)

    def _by_word(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        strange = pc.match_substring_regex(texts, _STRANGE)
        for s in self.specials:
            strange = pc.or_(strange, pc.match_substring(texts, s))
        plain = pc.if_else(strange, "", texts)
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", plain, ""), "\n", " \n")
        split = pc.split_pattern(lines, " ")
        del plain, lines
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        own = np.diff(split.offsets.to_numpy())
        last = np.cumsum(own)
        del split
        whole, flat, n = self._words(coded.dictionary)
        begin = np.cumsum(n) - n
        first = np.zeros(len(at), bool)
        first[last - own] = True  # what stands before the text's own line feed: nothing
        odd = np.logical_or.reduceat(whole[at] & ~first, last - own) | strange.to_numpy(zero_copy_only=False)
        count = np.where(first, 0, n[at])
        data = _gather(flat, begin[at], count).tobytes()
        until = np.cumsum(count)[last - 1] * self.dtype.itemsize
        since = np.append(0, until[:-1]) + self.newline
        odd &= (empty := pc.equal(texts, "").to_numpy(zero_copy_only=False)) == 0
        out = [data[a:b] for a, b in zip(since.tolist(), until.tolist())]
        for k in np.flatnonzero(empty).tolist():
            out[k] = b""
        if odd.any():
            again = np.flatnonzero(odd)
            for k, v in zip(again.tolist(), self._whole(texts.take(pa.array(again)).to_pylist())):
                out[k] = v
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words that follow a space or begin with a line feed: whether their texts must be encoded
        as a whole, the ids of all, and how many each has."""
        long = pc.greater(pc.binary_length(words), LONG_WORD)
        whole = pc.or_(long, pc.is_in(words, pa.array(["", "\n"], words.type))).to_numpy(zero_copy_only=False)  # runs of blanks are one pre-token
        words = pc.if_else(long, "", words).cast(pa.string())
        led = pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")
        raw, at = _bytes_of(led.cast(pa.large_string()))
        starts = _starts(raw, at[:-1])
        offsets = np.append(starts, len(raw))
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        place = self._met(parts.dictionary)[parts.indices.to_numpy()]
        n = self.n[place]
        flat = _gather(self.flat, (np.cumsum(self.n) - self.n)[place], n)
        if len(self.known) > self.cache_words:
            self._forget()
        return whole, flat, np.add.reduceat(n, np.searchsorted(starts, at[:-1]))

    def _met(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct pre-tokens among the known ones; new ones are encoded first."""
        place = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy().astype(np.int64)
        self.tick += 1
        self.met[place[place >= 0]] = self.tick
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = len(self.known) + np.arange(len(missing))
            new = parts.take(pa.array(missing))
            ids, n = zip(*[self._pretokens(new.slice(k, AT_ONCE)) for k in range(0, len(new), AT_ONCE)])
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.n = np.concatenate([self.flat, *ids]), np.concatenate([self.n, *n])
            self.met = np.append(self.met, np.full(len(missing), self.tick))
        return place

    def _forget(self) -> None:
        """Keep the half of the cache that was met last."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.cache_words // 2])
        self.known = self.known.take(pa.array(keep))
        self.flat = _gather(self.flat, (np.cumsum(self.n) - self.n)[keep], self.n[keep])
        self.n, self.met = self.n[keep], self.met[keep]

    def _pretokens(self, group: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and how many each has: ``JOINED`` at a time are one text, a separator before each."""
        raw, at = _bytes_of(group)
        letters = np.full(len(raw) + len(group), self.sep, "<u2")
        letters[np.arange(len(raw)) + np.repeat(np.arange(1, len(group) + 1), np.diff(at))] = self.letters[raw]
        text = letters.tobytes().decode("utf-16-le")
        cuts = [*(at[:-1] + np.arange(len(group)))[::JOINED].tolist(), len(text)]
        found = self.model.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, self.dtype) for e in found])
        begin = np.flatnonzero(ids == self.sep_id)
        return ids[ids != self.sep_id], np.diff(np.append(begin, len(ids))) - 1


def groups(sizes: np.ndarray, most: int = 1_500_000, rows: int = 250):
    """Runs of rows of about ``most`` bytes and at most ``rows`` rows, so that one batch's work stays small."""
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        total += n
        if total >= most or k - start + 1 >= rows:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
