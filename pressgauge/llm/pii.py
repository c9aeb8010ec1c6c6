"""Personal data by built-in functions only: patterns propose, checksums confirm, context words move the score.

Kinds, in order: email, ip, card, phone (the base kinds, always reported), then iban, ssn and secret (a key or token: a long
run of letters and digits), reported from a score of 0.5. The last two need a context word to reach it.
Matches are leftmost and do not overlap within a kind. ``start`` and ``end`` are code points, end exclusive. A match that
fails its check is dropped without another try. Patterns use possessive repeats, so a long run of digits or letters takes
linear time and no recursion. Null text is empty; repeated rows and null ids stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    # A run of local characters can match from its start, or from where the last match ended, or not at all.
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: Cheap tests that rule a kind out before its pattern runs.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-", "secret": r"[A-Za-z0-9+/_-]{20}"}
# Score of a kind, and words that raise it within CONTEXT characters before the match.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.3, "secret": 0.3}
WORDS = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer", "ssn": "ssn|social|security",
    "secret": "token|secret|password|passwd|api|key|bearer|auth|credential",
}
CONTEXT, BONUS, MIN_SCORE = 40, 0.3, 0.5


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def iban_remainder(c: Column) -> Column:
    """Remainder by 97 of an IBAN: first four characters to the end, letters as two digits."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    moved = F.filter(F.split(F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4)), ""), lambda x: x != "")
    value = lambda x: F.ascii(x) - F.when(x >= "A", 55).otherwise(48)
    return F.aggregate(moved, F.lit(0), lambda acc, x: (acc * F.when(x >= "A", 100).otherwise(10) + value(x)) % 97)


def confirmed(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return n.between(12, 19) & F.coalesce(F.call_function("luhn_check", digits(m)), F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return iban_remainder(m) == 1
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


def _proposed(text: Column, kind: str) -> Column:
    """All matches with their places: lengths of the pieces between matches and of the matches, summed along the text."""
    pattern = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.expr("cast(array() as array<struct<at:int,m:string>>)")
    placed = F.aggregate(
        F.filter(pairs, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["gap"])).alias("at"), x["m"].alias("m"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(NEEDS[kind]), placed).otherwise(empty)


def _kept(text: Column, kind: str, placed: Column) -> Column:
    def span(x):
        before = F.lower(F.substring(text, F.greatest(x["at"] - CONTEXT, F.lit(0)) + 1, F.least(x["at"], F.lit(CONTEXT))))
        score = F.round(F.lit(SCORES[kind]) + F.when(before.rlike(rf"\b(?:{WORDS[kind]})"), BONUS).otherwise(0.0), 3)
        return F.struct(
            x["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (x["at"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
        )

    spans = F.transform(F.filter(placed, lambda x: confirmed(kind, x["m"])), span)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)


def spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (start, kind_no, end, kind, score) in order of start, then kind. No shuffle.

    Every row passes each pattern once; the matches of a kind are kept in their own step so that none is computed twice.
    """
    cols = docs.columns
    t = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    t = t.withColumns({f"__p_{k}": _proposed(F.col("__t"), k) for k in KINDS})
    found = F.array_sort(F.concat(*[F.when(F.size(f"__p_{k}") > 0, _kept(F.col("__t"), k, F.col(f"__p_{k}"))).otherwise(F.expr(f"cast(array() as {_SPAN})")) for k in KINDS]))
    return t.select(*[c for c in cols if c != out], found.alias(out))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, wins.

    ``n_chars`` follows the text where there is such a column; null texts stay null.
    """
    s = spans(docs, text_col, "__spans")
    zero = F.expr("cast(array() as array<string>)")
    piece = lambda acc, x: F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"])
    done = F.aggregate(
        F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"], -x["end"], x["kind"]))).cast("array<struct<start:int,minus_end:int,kind:string>>"),
        F.struct(F.lit(0).alias("at"), zero.alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct((-x["minus_end"]).alias("at"), F.concat(acc["out"], F.array(piece(acc, x), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    text = F.when(F.size("__spans") > 0, done).otherwise(F.col(text_col))
    got = s.withColumn("__new", text)
    cols = [F.col("__new").alias(c) if c == text_col else F.when(F.size("__spans") > 0, F.length("__new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return got.select(*cols)


def joined(spans_col: str, only: tuple[str, ...] = KINDS) -> Column:
    kept = F.filter(spans_col, lambda s: s["kind"].isin(*only))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans_col: str) -> Column:
    """Scores of the spans, in their order."""
    return F.array_join(F.transform(spans_col, lambda s: F.format_number(s["score"], 2)), ",")
