"""Amounts of money in the forms that registries use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import map_of

#: Decimals of token contracts (USD coins on three chains).
TOKEN_DECIMALS = {
    "0x833589fcd6edb6e08f4c7c32d4f71b54bda02913": 6,
    "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48": 6,
    "0x3c499c542cef5e3811e1192ce70d8cc03d5c3359": 6,
}
DEFAULT_DECIMALS, FIAT_DECIMALS = 6, 2


def amount_hint(hint: Column) -> Column:
    """USD of a hint such as ``$ 0.20/page``."""
    return F.regexp_extract(hint, r"\$[ \t\n\r]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def decimals(explicit: Column, asset: Column, currency: Column) -> Column:
    """Decimals of an amount: as given, else the token's, else 2 for a three-letter currency, else 6."""
    token = F.coalesce(asset, F.when(currency.rlike("^0[xX][0-9a-fA-F]{40}$"), currency))
    of_token = F.coalesce(F.element_at(map_of({k: str(v) for k, v in TOKEN_DECIMALS.items()}), F.lower(token)).cast("int"), F.lit(DEFAULT_DECIMALS))
    return F.when(explicit.isNotNull(), explicit).when(token.isNotNull() & (token != ""), of_token).when(currency.rlike("^[A-Za-z]{3}$"), FIAT_DECIMALS).otherwise(DEFAULT_DECIMALS)


def base_units_to_usd(amount: Column, explicit: Column, asset: Column, currency: Column) -> Column:
    """USD of a whole number of base units; null for anything else."""
    return F.when(amount.rlike("^[0-9]+$"), amount.try_cast("double") / F.pow(F.lit(10.0), decimals(explicit, asset, currency)))


def offer_usd(offer: Column) -> Column:
    none = F.lit(None)
    return base_units_to_usd(offer["amount"], none.cast("int"), none.cast("string"), offer["currency"])


def cheapest(offers: Column) -> Column:
    """(price, pos, currency) of the cheapest offer that has a price; the first of equal ones."""
    priced = F.transform(offers, lambda o, k: F.struct(offer_usd(o).alias("price"), k.alias("pos"), o["currency"].alias("currency")))
    return F.array_min(F.filter(priced, lambda x: x["price"].isNotNull()))


def rails(offers: Column) -> Column:
    """Protocols of offers: x402 for x402 and evm methods, mpp for any other, x402 first."""
    direct = lambda o: F.lower(o["method"]).isin("x402", "evm")
    both = F.array(F.when(F.exists(offers, direct), "x402"), F.when(F.exists(offers, lambda o: ~direct(o)), "mpp"))
    return F.filter(both, lambda x: x.isNotNull())
