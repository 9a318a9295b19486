"""Facets of endpoints and queries by keyword tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import all_matches, first_match, map_of, matches

# The four endpoint tables, the category map and the four query tables, in order of precedence.

CATEGORY_DOMAIN = {
    "shop": "commerce", "shopping": "commerce", "commerce": "commerce", "ai": "ai", "ai_ml": "ai", "data": "data", "web": "web",
    "comms": "comms", "messaging": "comms", "finance": "finance", "maps": "maps", "travel": "travel", "realestate": "realestate",
    "social": "social", "media": "media", "marketing": "commerce", "analyst": "commerce", "cloud": "cloud", "compute": "compute",
    "devtools": "devtools", "storage": "cloud", "search": "web", "crypto": "blockchain", "blockchain": "blockchain",
    "identity": "identity", "agent": "agent", "utility": "utility", "science": "science", "health": "science", "medical": "science",
    "pharma": "science", "gov": "gov", "government": "gov", "translation": "ai", "security": "devtools",
}

DOMAIN_KEYWORDS = [
    ("blockchain", r"\b(crypto|blockchain|onchain|on-chain|wallet|token|erc20|evm|solana|ethereum|rpc|web3|nft|airdrop|defi|gas price)\b"),
    ("finance", r"\b(stock|ticker|equity|forex|exchange[- ]?rate|quote|market|fmv|sec filing)\b"),
    ("identity", r"\b(company enrich|firmographic|people search|person lookup|contact enrich|kyc|kyb|entity resolution|business registry)\b"),
    ("gov", r"\b(government|\bgov\b|civic|voter|election|elected official|legislat|regulatory|\blei\b|legal entity identifier|public record)\b"),
    ("science", r"\b(scientific|research paper|genome|\bgene\b|protein|chemistry|compound|\bdrug\b|pharma|medication|clinical|agricultur|\bcrop\b|usda)\b"),
    ("commerce", r"\b(price|retail|product|sku|deal|cart|checkout|store|merchant|coupon|competitive|inflation|e-commerce)\b"),
    ("comms", r"\b(email|sms|fax|inbox|mailbox|voice call|messaging|send a message)\b"),
    ("maps", r"\b(map|geocode|geocoding|places?|route|directions|latitude|longitude|address lookup)\b"),
    ("travel", r"\b(travel|hotel|flight|reviews?|itinerary|booking)\b"),
    ("realestate", r"\b(real estate|property|listing|mls|rent|mortgage|zillow)\b"),
    ("social", r"\b(influencer|follower|social profile|instagram|tiktok|twitter|x\.com)\b"),
    ("media", r"\b(media|video|podcast|broadcast|streaming|anime|movie|book|isbn|news|headline|sports? score)\b"),
    ("web", r"\b(scrape|crawl|markdown|screenshot|webpage|render page|html|web page|serp|search engine|web search|results page)\b"),
    ("ai", r"\b(llm|completion|prompt|embedding|generate|ocr|transcribe|speech|text-to|image generat|chat model|translate|moderat)\b"),
    ("cloud", r"\b(domain register|dns|provision|hosting|deploy|nameserver|bucket|file upload|object store|cdn)\b"),
    ("compute", r"\b(compute|sandbox|execute code|serverless|function run|convert unit|calculator)\b"),
    ("utility", r"\b(validate (email|phone|address)|email valid|phone valid|\biban\b|vat number|format convert|checksum)\b"),
    ("devtools", r"\b(captcha|proxy|webhook|developer tool|api key|code repo|github|repository|ip address|ip lookup|whois)\b"),
    ("agent", r"\b(agent memory|agent marketplace|context store|agent registry)\b"),
    ("data", r"\b(lookup|enrich|weather|forecast|holiday|calendar|job|hiring)\b"),
]

OUTPUT_ENTITY_KEYWORDS = [
    ("PriceSignal", r"\b(price|deal|cheapest|lowest price|inflation|price history)\b"),
    ("MarketQuote", r"\b(stock quote|spot price|exchange rate|ticker|market quote)\b"),
    ("CitedAnswer", r"\b(cited|citation|with sources|research answer)\b"),
    ("SearchResults", r"\b(serp|search results|results page|web search)\b"),
    ("WebContent", r"\b(scrape|markdown|html|page content|article text)\b"),
    ("Image", r"\b(screenshot|image|render|png|jpeg|photo generat)\b"),
    ("AudioClip", r"\b(speech|tts|text-to-speech|audio|voice synth)\b"),
    ("Text", r"\b(transcribe|speech-to-text|ocr|translate|extract text)\b"),
    ("StructuredRecord", r"\b(document extract|structured|fields|parse|json output)\b"),
    ("Embedding", r"\b(embedding|vector|embed text)\b"),
    ("Message", r"\b(send (an )?(email|sms|fax)|deliver message|outbound)\b"),
    ("Place", r"\b(places?|local business|reviews?|venue)\b"),
    ("Company", r"\b(company|organization|firm|business enrich)\b"),
    ("Person", r"\b(person|people search|contact enrich)\b"),
    ("SocialProfile", r"\b(influencer|social profile|follower)\b"),
    ("DnsRecord", r"\b(whois|dns|nameserver|domain record)\b"),
    ("Answer", r"\b(answer|compute answer|llm|completion|chat)\b"),
]

PRIMARY_ENTITY_KEYWORDS = [
    ("Webpage", r"\b(url|webpage|web page|website|scrape|crawl|render)\b"),
    ("Document", r"\b(document|pdf|file extract|invoice)\b"),
    ("Image", r"\b(image|photo|ocr|screenshot input)\b"),
    ("AudioClip", r"\b(audio|speech|recording|transcribe)\b"),
    ("Product", r"\b(product|sku|item|airpods|asin)\b"),
    ("Ticker", r"\b(ticker|symbol|stock)\b"),
    ("CryptoAsset", r"\b(coin|crypto|token symbol)\b"),
    ("WalletAddress", r"\b(wallet|address balance|0x)\b"),
    ("Currency", r"\b(currency|exchange rate|fx)\b"),
    ("Contact", r"\b(email address|phone number|recipient)\b"),
    ("Location", r"\b(location|address|geocode|lat|lng|coordinates)\b"),
    ("Domain", r"\b(domain|whois|dns)\b"),
    ("IpAddress", r"\bip\b|\bip address\b"),
    ("Company", r"\b(company|organization|firm)\b"),
    ("Person", r"\b(person|people|name lookup)\b"),
    ("Query", r"\b(query|search|q=|keyword|prompt)\b"),
]

MODALITY_KEYWORDS = [
    ("markdown", r"\bmarkdown\b"),
    ("html", r"\bhtml\b"),
    ("image", r"\b(image|screenshot|png|jpeg|photo)\b"),
    ("audio", r"\b(audio|speech|voice|tts)\b"),
    ("citations", r"\b(citation|cited|sources)\b"),
    ("vector", r"\b(embedding|vector)\b"),
    ("timeseries", r"\b(history|time series|timeseries|historical|trend)\b"),
    ("json", r"\b(json|structured|fields)\b"),
    ("text", r"\b(text|markdown|transcribe|translate)\b"),
]

DOMAIN_CUES = [
    ("maps", r"\b(near[ ]?by|nearby|near me|near downtown|points? of interest|\bpoi\b|coffee shop|restaurant|cafe|open now|street address|geocod|lat(itude)?\b|directions?)\b"),
    ("blockchain", r"\b(crypto|on.?chain|onchain|wallet address|token balance|erc-?20|blockchain|defi)\b"),
    ("commerce", r"\b(cheapest|best price|on sale|discount|coupon|deal|clearance|retailer)\b"),
    ("comms", r"\b(send (an )?(email|sms|text|fax)|outbound (email|sms|call)|voice call|cold email)\b"),
]
ENTITY_CUES = [
    ("Ticker", r"\b(stock|equity|equities|shares?|ticker|nasdaq|nyse|\bnvda\b|\baapl\b|\btsla\b|\bspy\b|s&p)\b"),
    ("CryptoAsset", r"\b(bitcoin|\bbtc\b|ethereum|\beth\b|solana|\bsol\b|crypto(currency)?|coin|altcoin|token price|spot price for)\b"),
    ("Domain", r"\b(domain( name)?|corporate domain|\.com\b|registrar|whois|nameserver)\b"),
    ("Document", r"\b(pdf|document|invoice|receipt|contract|spreadsheet)\b"),
    ("Image", r"\b(photo|picture|image|\bjpe?g\b|\bpng\b|screenshot|scanned)\b"),
    ("Webpage", r"\b(url|web ?page|website|web site)\b"),
]
OUTPUT_CUES = [
    ("StructuredRecord", r"\b(structured (data|json|output|record)|extracted fields?|json output|key.?value|line items|extract .*fields)\b"),
    ("CitedAnswer", r"\b(citation|sources?|cited|grounded|with references)\b"),
    ("SearchResults", r"\b(serp|organic results|search results|google results|ranked links)\b"),
    ("PriceSignal", r"\b(price history|price drop|price trend|cheapest)\b"),
]
MODALITY_CUES = [
    ("markdown", r"\b(markdown|clean text|readable text|md format)\b"),
    ("citations", r"\b(citation|sources?|cited|grounded|with references)\b"),
    ("json", r"\b(serp|organic results|json output|structured json)\b"),
    ("image", r"\b(screenshot|png|render the page|visual snapshot|capture the page)\b"),
    ("html", r"\b(raw html|full html|page html)\b"),
    ("audio", r"\b(audio|mp3|spoken|text.?to.?speech|narration)\b"),
    ("timeseries", r"\b(time series|historical (data|prices)|over time|trend over)\b"),
]

GENERIC_SUMMARY = r"(?i)^(authenticate|prove action|delete a memory|get mcp|api info|free health|x402 defi)"
GENERIC_PATH = r"(?i)/(health|authenticate|auth|prove|memory|mcp-tools|api-info|defi-nontokenized)(/|$)"
GENERIC_HIT = r"(?i)^(authenticate|prove action|delete a memory|get mcp|api info|free health|purchase |buy )"


def endpoint_corpus(path: Column, summary: Column, description: Column, inputs: Column, category: Column) -> Column:
    none = F.lit("")
    return F.lower(F.concat(F.coalesce(path, none), F.lit(" "), F.coalesce(summary, none), F.lit(" "), F.coalesce(description, none), F.lit(" "), F.coalesce(F.array_join(inputs, " "), none), F.lit(" "), F.coalesce(category, none)))


def endpoint_facets(corpus: Column, category: Column) -> Column:
    """(domain, primary_entity, output_entity, modality) of an endpoint's corpus; a known category gives the domain."""
    return F.struct(
        F.coalesce(F.element_at(map_of(CATEGORY_DOMAIN), F.lower(category)), first_match(corpus, DOMAIN_KEYWORDS)).alias("domain"),
        first_match(corpus, PRIMARY_ENTITY_KEYWORDS).alias("primary_entity"),
        first_match(corpus, OUTPUT_ENTITY_KEYWORDS).alias("output_entity"),
        all_matches(corpus, MODALITY_KEYWORDS).alias("modality"),
    )


def query_facets(query: Column) -> Column:
    q = F.lower(query)
    return F.struct(
        first_match(q, DOMAIN_CUES).alias("domain"),
        first_match(q, ENTITY_CUES).alias("primary_entity"),
        first_match(q, OUTPUT_CUES).alias("output_entity"),
        all_matches(q, MODALITY_CUES).alias("modality"),
    )


def is_generic(summary: Column, path: Column) -> Column:
    return matches(F.coalesce(summary, F.lit("")), GENERIC_SUMMARY) | matches(F.coalesce(path, F.lit("")), GENERIC_PATH)
