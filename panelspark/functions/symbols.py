"""Ticker spellings: bare code, suffixed symbol, prefixed symbol.  All are idempotent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Market suffix and prefix of the two spellings.
SUFFIX = ".KL"
PREFIX = "MY."


def _clean(code: Column) -> Column:
    return F.upper(F.trim(code))


def to_symbol(code: Column, suffix: str = SUFFIX) -> Column:
    c = _clean(code)
    return F.when(c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def bare_code(code: Column, suffix: str = SUFFIX, prefix: str = PREFIX) -> Column:
    pattern = "^" + prefix.replace(".", r"\.") + "|" + suffix.replace(".", r"\.") + "$"
    return F.regexp_replace(_clean(code), pattern, "")


def to_prefixed(code: Column, suffix: str = SUFFIX, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), bare_code(code, suffix, prefix))


def pad_code(code: Column, width: int = 4) -> Column:
    """Left-pad with zeros; longer codes stay whole (lpad would cut them)."""
    c = F.trim(code)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)
