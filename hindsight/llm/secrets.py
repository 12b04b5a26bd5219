"""Secret scans: fixed patterns, and a randomness test battery for what they miss.

Candidates are long tokens of one inferred encoding (hex, base32, base64). '=' is padding at
a token's end only, so it parts a name from its value. A run that no alphabet holds falls
apart into its longest stretches of one alphabet; of those that overlap, the one least like
text stands. The battery tests the hypothesis "drawn evenly from the encoding's alphabet":
a chi-squared test of symbol counts, a runs test of symbols above and below the alphabet's
middle and a test of serial correlation. Its statistic is the sum of the three squared
normal scores, small for random tokens; above EVEN (the 0.999 quantile of chi-squared with
three degrees) a candidate is no random token.

A candidate that passes may still be ordinary text that is too short to show. What the same
statistic is for text is measured on the table itself: all text outside candidates and
base spans, reduced to an alphabet and cut into tokens of every length class, goes through the same battery, and
mean and variance of the statistic's logarithm are summed per encoding and length class.
Small tables lean on PRIOR pseudo-tokens, whose mean follows from English letter shares.
That gives each candidate a p-value for "ordinary text" of its length, and the
Benjamini-Hochberg rule over all candidates of an encoding and length class bounds the share
of false finds.

Candidates are counted in a fixed grid of (encoding, length class, step of the statistic),
so measures and thresholds come from tables of bounded size whatever the corpus.

Null and empty texts have no spans. Spans count code points, ends are exclusive. Base
spans always stay; a random token that overlaps one is not reported again. Repeated rows
are scanned one by one. Runs of digits alone, or of letters alone in hex and base32, are no
encoding of their own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: The base patterns, in the order results list kinds at equal starts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: What a candidate of no encoding falls apart into: its stretches of the two largest alphabets.
_STRETCHES = (re.compile(r"[A-Za-z0-9+/]{20,}=*"), re.compile(r"[A-Za-z0-9_-]{20,}=*"))

#: Alphabets by encoding, tried in order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Text is measured once for both forms of base64, which differ in two rare symbols.
MEASURED = ("hex", "HEX", "base32", "base64")
#: Shares of the letters a to z in English, in thousandths.
ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
EVEN = 16.27
FALSE_DISCOVERY = 0.01
#: Pseudo-tokens of the prior, and its spread of the statistic's logarithm.
PRIOR, PRIOR_SPREAD = 20, 0.35
#: Steps of the logarithm in the grid, and the score of a token that a test finds impossible.
STEPS, IMPOSSIBLE = 32, 30.0
#: Lower ends of the length classes after the first, and the length at which text is measured for each class.
_CLASSES = (24, 32, 48, 64, 128, 256)
_LENGTHS = (22, 28, 40, 56, 96, 192, 320)
_TABLES = {}
for _name, _letters in ALPHABETS.items():
    _TABLES[_name] = np.full(256, -1, np.int16)
    _TABLES[_name][[ord(c) for c in _letters]] = range(len(_letters))


def infer_encoding(token: str) -> str | None:
    """First alphabet that holds every character; hex and base32 need both digits and letters."""
    if token.isdigit():
        return None
    mixed = not token.isalpha()
    codes = np.frombuffer(token.encode("ascii"), np.uint8)
    for name, table in _TABLES.items():
        if (mixed or name.startswith("base64")) and (table[codes] >= 0).all():
            return name
    return None


def battery(x: np.ndarray, k: int) -> np.ndarray:
    """The statistic of every row of ``x``, symbols 0 to k - 1 of tokens of one length."""
    rows, n = x.shape
    counts = np.bincount((np.arange(rows)[:, None] * k + x).ravel(), minlength=rows * k).reshape(rows, k)
    df = k - 1
    chi = ((counts - n / k) ** 2).sum(1) * k / n
    # Wilson-Hilferty; counts that are too even are no evidence of text
    even = np.maximum(0.0, ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = x >= k // 2
    above = high.sum(1)
    mean = 1 + 2 * above * (n - above) / n
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    runs = np.where((above > 0) & (above < n), np.abs(1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean) / spread, IMPOSSIBLE)
    c = x - x.mean(1, keepdims=True)
    square = (c * c).sum(1)
    serial = np.where(square > 0, np.abs((c[:, 1:] * c[:, :-1]).sum(1) / np.maximum(square, 1e-9) + 1 / n) * math.sqrt(n), IMPOSSIBLE)
    return even**2 + np.minimum(runs, IMPOSSIBLE) ** 2 + np.minimum(serial, IMPOSSIBLE) ** 2


def statistic(token: str) -> tuple[str, float] | None:
    """(encoding, statistic) of a candidate; null if it is of no encoding."""
    token = token.rstrip("=")
    if len(token) < 20 or (name := infer_encoding(token)) is None:
        return None
    x = _TABLES[name][np.frombuffer(token.encode("ascii"), np.uint8)]
    return name, float(battery(x[None, :].astype(np.int64), len(ALPHABETS[name]))[0])


def length_class(n: int) -> int:
    return sum(n >= c for c in _CLASSES)


def text_moments(text: bytes) -> list[tuple[str, int, int, float, float]]:
    """(encoding, length class, tokens, sum and square sum of the statistic's logarithm) of running text, every symbol used once per encoding."""
    out, codes = [], np.frombuffer(text, np.uint8)
    for name in MEASURED:
        x = _TABLES[name][codes]
        x, k = x[x >= 0], len(ALPHABETS[name])
        share, at = len(x) // len(_LENGTHS), 0
        for c, n in enumerate(_LENGTHS):
            rows = x[at : at + share // n * n].reshape(-1, n)
            at += share
            logs = [np.log1p(battery(rows[i : i + 20_000].astype(np.int64), k)) for i in range(0, len(rows), 20_000)]
            if logs:
                logs = np.concatenate(logs)
                out.append((name, c, len(logs), float(logs.sum()), float((logs * logs).sum())))
    return out


def prior_mean(encoding: str, n: int) -> float:
    """Logarithm of the statistic of English of n symbols, by its expected chi-squared."""
    letters = np.array([ENGLISH[ord(c) - 97] for c in "abcdefghijklmnopqrstuvwxyz" if {c, c.upper()} & set(ALPHABETS[encoding])], float)
    k, shares = len(ALPHABETS[encoding]), letters / letters.sum()
    df = k - 1
    chi = df + n * (k * float((shares * shares).sum()) - 1)
    return math.log1p((((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) ** 2 + 2)


def text_p(moments: dict[tuple[str, int], tuple[int, float, float]], encoding: str, size: int, log_statistic: float) -> float:
    """p-value of "ordinary text" for a candidate of this encoding and length class."""
    measured = "base64" if encoding == "base64url" else encoding
    n, s, ss = moments.get((measured, size), (0, 0.0, 0.0))
    prior = prior_mean(measured, _LENGTHS[size])
    n, s, ss = n + PRIOR, s + PRIOR * prior, ss + PRIOR * (prior**2 + PRIOR_SPREAD**2)
    spread = math.sqrt(max(1e-6, ss / n - (s / n) ** 2))
    return 0.5 * math.erfc((s / n - log_statistic) / spread / math.sqrt(2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _apart(spans: list[tuple[int, int, int]]):
    """Test whether a stretch of text meets none of the spans; they are merged where they overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(i: int, j: int) -> bool:
        at = bisect_right(starts, i)
        return not (at and ends[at - 1] > i) and not (at < len(starts) and starts[at] < j)

    return free


def candidates(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str, float]], list[str]]:
    """(start, end, encoding, statistic) of the candidates outside the base spans that may be random, in order; and the text around all of them."""
    out, taken, free = [], [(a, b) for a, _, b in spans], _apart(spans)
    for m in _CANDIDATE.finditer(text):
        taken.append(m.span())
        if infer_encoding(m.group().rstrip("=")):
            parts = [m.span()]
        else:
            parts = [(m.start() + x.start(), m.start() + x.end()) for stretch in _STRETCHES for x in stretch.finditer(m.group())]
        tested = [(t[1], i - j, i, j, t[0]) for i, j in parts if free(i, j) and (t := statistic(text[i:j])) and t[1] <= EVEN]
        kept: list[tuple[int, int, str, float]] = []
        for value, _, i, j, encoding in sorted(tested):
            at = bisect_right(kept, (i, j))  # those kept are apart and in order, so only two can overlap
            if not (at and kept[at - 1][1] > i) and not (at < len(kept) and kept[at][0] < j):
                kept.insert(at, (i, j, encoding, value))
        out += kept
    around, last = [], 0
    for a, b in sorted(taken):
        if a > last:
            around.append(text[last:a])
        last = max(last, b)
    around.append(text[last:])
    return out, around


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_RANDOM = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length_class", pa.int32()), ("step", pa.int32())]))
_MOMENTS = pa.list_(pa.struct([("encoding", pa.string()), ("length_class", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("ss", pa.float64())]))
_SCHEMA = (
    "doc_id long, base array<struct<start:long,kind:int,end:long>>, random array<struct<start:long,end:long,encoding:string,length_class:int,step:int>>, "
    "moments array<struct<encoding:string,length_class:int,n:long,s:double,ss:double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: doc_id, text -> _SCHEMA; the moments of a batch's text stand in its first row."""
    for batch in batches:
        base, random, moments, held, size = [], [], [], [], 0
        for value in batch.column(1):
            text = value.as_py() or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            found, around = candidates(text, spans)
            random.append([{"start": i, "end": j, "encoding": e, "length_class": length_class(j - i), "step": int(STEPS * math.log1p(x))} for i, j, e, x in found])
            held += [part.encode("utf-8", "replace") for part in around]
            size += len(text)
            if size >= 4_000_000:
                moments += text_moments(b"".join(held))
                held, size = [], 0
        moments += text_moments(b"".join(held))
        names = ("encoding", "length_class", "n", "s", "ss")
        rows = [[dict(zip(names, m, strict=True)) for m in moments]] + [None] * (batch.num_rows - 1)
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(random, _RANDOM), pa.array(rows, _MOMENTS)], ["doc_id", "base", "random", "moments"])


def discovery_steps(counts: list[tuple[str, int, int, int]], moments: dict[tuple[str, int], tuple[int, float, float]], rate: float = FALSE_DISCOVERY) -> dict[tuple[str, int], int]:
    """Largest step of the statistic that Benjamini-Hochberg admits per (encoding, length class).

    ``counts`` has (encoding, length class, step, candidates). A candidate counts with the p-value of its step's upper end, so the rule errs on the strict side.
    """
    out = {}
    for key in {(e, c) for e, c, _, _ in counts}:
        steps = {s: n for e, c, s, n in counts if (e, c) == key}
        total, at_most = sum(steps.values()), 0
        for s in sorted(steps):
            at_most += steps[s]
            if text_p(moments, *key, (s + 1) / STEPS) <= rate * at_most / total:
                out[key] = s
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and the random tokens that pass the false-discovery rule."""
    scanned = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_scan), _SCHEMA), "secrets")
    sums = scanned.select(F.inline("moments")).groupBy("encoding", "length_class").agg(F.sum("n"), F.sum("s"), F.sum("ss"))
    moments = {(r[0], r[1]): tuple(r[2:]) for r in sums.collect()}  # one row per encoding and length class
    grid = scanned.select(F.inline("random")).groupBy("encoding", "length_class", "step").agg(F.count("*").alias("n"))
    steps = discovery_steps([tuple(r) for r in grid.collect()], moments)  # at most encodings x classes x steps up to EVEN

    def passes(r: Column) -> Column:
        out = F.lit(False)
        for (encoding, size), step in sorted(steps.items()):
            out = out | ((r["encoding"] == encoding) & (r["length_class"] == size) & (r["step"] <= step))
        return out

    return scanned.drop("moments").withColumn("random", F.filter("random", passes))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    random = F.transform("random", lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", random))).alias("spans"),
    )
