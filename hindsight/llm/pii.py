"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for bank account numbers), words around a span raise or lower its score.
Base kinds are always kept once confirmed; the method's own kinds need the score.

Null and empty texts have no spans. Offsets count code points, the end is
exclusive. Possessive quantifiers keep the matcher from backtracking or
recursing on very long runs. The text is split at the matches once; places are
running sums of lengths, taken in blocks, and context is read off the pieces
beside a match, so a text with very many spans stays near linear. Repeated rows
each get their own result, extra columns are carried by :func:`find_pii` unless
they clash, when the result wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_MAIL = "A-Za-z0-9._%+-"
#: The span kinds in the order results list them, with their patterns.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Words that make a neighbouring number more or less likely to be personal.
CONTEXT_FOR = {"iban": "iban|bic|swift|account|konto|compte|cuenta|bank", "ssn": "ssn|social|security|sozial|sécurité|seguridad"}
CONTEXT_AGAINST = "version|isbn|part|serial|model|order"
CONTEXT_CHARS = 48
KEEP_SCORE = 0.5
#: Numbers that a running sum takes at a time.
BLOCK = 64


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        letter = code >= 65
        return F.when(letter, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(match) > 37, False).otherwise(let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    """Prior of the kind, moved by words within CONTEXT_CHARS code points, no further than the next match of the kind."""
    near = F.lower(F.concat(F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS), F.lit(" "), F.substring(after, 1, CONTEXT_CHARS)))
    prior = {"iban": 0.6, "ssn": 0.3}.get(kind, 0.9)
    for_it = F.when(near.rlike(CONTEXT_FOR[kind]), 0.4).otherwise(0.0) if kind in CONTEXT_FOR else F.lit(0.0)
    against = F.when(near.rlike(rf"\b(?:{CONTEXT_AGAINST})\b"), 0.3).otherwise(0.0)
    return F.lit(prior) + for_it - against


def sums_before(lengths: Column) -> Column:
    """For each of an array's whole numbers the sum of those before it.

    Arrays only grow within blocks of BLOCK numbers and over the list of blocks, not number by number over all.
    """
    ints, lists = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def within(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), ints.alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def over(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: x + acc["at"])
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(F.transform(blocks, within), F.struct(F.lit(0).alias("at"), lists.alias("out")), over, lambda a: a["out"]))


def _spans(kind: str, text: Column) -> Column:
    """array<struct<start,end,score>> of confirmed spans of one kind, in text order."""
    pattern = PATTERNS[kind]
    empty = F.array().cast("array<struct<start:int,end:int,score:double>>")

    def located(found: Column, gaps: Column, before: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            score = _score(kind, F.get(gaps, i), F.get(gaps, i + 1))
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), score.alias("score"))

        spans = F.transform(found, lambda match, i: F.when(_confirmed(kind, match), span(match, i)))
        return F.filter(spans, lambda s: s.isNotNull())

    def steps(found: Column, gaps: Column) -> Column:
        return F.transform(found, lambda match, i: F.length(match) + F.length(F.get(gaps, i)))

    def locate(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(sums_before(steps(found, gaps)), lambda before: located(found, gaps, before)))

    matches = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, locate(found)).otherwise(empty))
    return F.when(text.rlike(pattern), matches).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``pii_<kind>``: array of {start, end, score} per span kind."""
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    spans = {f"pii_{k}": _spans(k, F.col("body")) for k in PATTERNS}
    kept = [F.col(k) if k[4:] in BASE else F.filter(k, lambda s: s["score"] >= KEEP_SCORE).alias(k) for k in spans]
    return held.withColumns(spans).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in spans], *kept)


def span_string(kinds: tuple[str, ...] | list[str]) -> Column:
    """kind:start:end of every span, by kind as listed and then by start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "<{}>") -> DataFrame:
    """Texts with every confirmed span replaced by its kind; overlapping spans become one mask of the first."""
    found = find_pii(docs, text)

    def masked(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mask.format(kind)).alias("mask")))

    every = F.array_sort(F.concat(*[masked(k) for k in PATTERNS]))
    body = F.coalesce(F.col(text), F.lit(""))

    def cut(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        more = F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), s["mask"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], more)).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body)))
    cleaned = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), cut, rest)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), cleaned)).drop(*[f"pii_{k}" for k in PATTERNS])


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document: counts, digest of the base spans, all spans and their number."""
    found = find_pii(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(span_string(BASE).cast("binary"), 256).alias("base_sha256"),
        span_string(list(PATTERNS)).alias("spans"),
        sum(F.size(f"pii_{k}") for k in PATTERNS).cast("long").alias("n_spans"),
    )
