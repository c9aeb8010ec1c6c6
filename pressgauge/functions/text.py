"""Titles, tokens and search predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import listing_datetime
from .urls import strip


def strip_trailing_clock(title: Column) -> Column:
    return strip(F.regexp_replace(title, r"(?U)\s*\d{1,2}:\d{2}$", ""))


def split_datetime_prefix(title: Column, pattern: str) -> tuple[Column, Column]:
    """(title without the prefix, publish time), for a pattern whose group 1 is the datetime."""
    hit = F.regexp_extract(title, pattern, 0)
    rest = F.when(hit != "", strip(F.substring(title, F.length(hit) + 1, F.length(title)))).otherwise(title)
    return rest, F.when(hit != "", listing_datetime(F.regexp_extract(title, pattern, 1)))


def truncate_error(message: Column, limit: int = 2000) -> Column:
    return F.substring(message, 1, limit)


def tokens(segmented: Column) -> Column:
    """Lower-cased tokens of space-joined text; no stemming, no stop words."""
    return F.filter(F.split(F.lower(segmented), r"(?U)[^\w]+"), lambda t: t != "")


def matches_all(doc_tokens: Column, query_tokens: list[str]) -> Column:
    """Every query token occurs; an empty query matches nothing."""
    if not query_tokens:
        return F.lit(False)
    out = F.array_contains(doc_tokens, query_tokens[0])
    for t in query_tokens[1:]:
        out = out & F.array_contains(doc_tokens, t)
    return out


def term_score(doc_tokens: Column, query_tokens: list[str]) -> Column:
    """Share of a document's tokens that are query tokens (our own rank; ties to no other engine's formula)."""
    hits = F.size(F.filter(doc_tokens, lambda t: t.isin(*query_tokens))) if query_tokens else F.lit(0)
    return hits / F.greatest(F.size(doc_tokens), F.lit(1))


def query_tokens(text: str | None, terms: tuple[str, ...] = ()) -> list[str]:
    return [t.lower() for t in re.findall(r"\w+", segment(text, terms) or "")]


_CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


@lru_cache(maxsize=8)
def _matcher(terms: tuple[str, ...]) -> re.Pattern:
    known = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return re.compile((known + "|" if known else "") + rf"[{_CJK}]|[^\W_{_CJK}]+|[^\s]")


def segment(text: str | None, terms: tuple[str, ...] = ()) -> str | None:
    """Space-joined tokens: longest dictionary term first, single CJK characters, runs of other letters. Falsy gives None."""
    if not text:
        return None
    return " ".join(_matcher(terms).findall(text))


def segment_udf(terms: Iterable[str] = ()):
    """Arrow UDF over ``segment``; the dictionary is compiled once per worker."""
    fixed = tuple(terms)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: segment(v, fixed), na_action="ignore")

    return run


def load_terms(path: str) -> tuple[str, ...]:
    """Terms of a user dictionary file: first field of each line that is not a comment."""
    with open(path, encoding="utf-8") as f:
        return tuple(x.split()[0] for x in f if x.strip() and not x.startswith("#"))


def bands(h: Column, n: int = 4) -> Column:
    """The hash cut into ``n`` equal bands of 64/n bits."""
    width = 64 // n
    return F.array(*[F.shiftrightunsigned(h, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(n)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences, split after a terminator or at a line end."""
    lines = F.split(F.regexp_replace(text, r"([.!?。!?])\s+", "$1\n"), r"\n+")
    return F.filter(F.transform(lines, strip), lambda s: s != "")
