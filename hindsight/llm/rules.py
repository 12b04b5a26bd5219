"""Quality rules as a short-circuit cascade, with built-in functions only.

Each rule is a Boolean expression over text measures. On a sample of rows, spread over the
table, the planner counts which rules reject together and how long texts are. From the
lengths and the fixed COST of a measure (passes over characters, words or lines) follows
what a rule would cost on a row that has come so far. The order is greedy: always the rule
that rejects most of the rows still left per unit of cost, where measures that an earlier
rule has taken are free. :func:`judge` evaluates rules in that order and stops at the first
that rejects, so the measures of later rules are not taken for that row. The verdict does
not depend on the order, nor on the sample; only the work and the rule named do.

The contract's query needs some measures of every row whatever the verdict. It takes them
first and hands them to the cascade as known, which leaves the others to be short-circuited.

Null text counts as empty: no words, so the base rule rejects it. Ties in the order go by
rule name. Repeated rows are judged one by one. An empty table has the order of the names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Rows, on average, that the estimates look at; the verdict never depends on them.
SAMPLE_ROWS, SEED = 1000, 11


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that occur twice or more in the array, the first included.

    Windows are compared by a 64-bit hash. Texts without a repeated window, nearly all,
    stop after the set test; the others sort (hash, position) pairs, so the work stays
    n log n however often a window repeats.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            n = F.size(s)

            def twin(i: Column) -> Column:
                h = F.get(s, i)["h"]
                return (F.get(s, i - 1)["h"] == h) | (F.get(s, i + 1)["h"] == h)

            hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(twin(i), F.lit(False)))
            return F.sort_array(F.transform(hits, lambda i: F.get(s, i)["i"]))

        def add(acc: Column, p: Column) -> Column:
            return F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))

        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(let(pairs, positions), start, add, lambda acc: acc["n"])

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    return F.when(F.size(words) <= width, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


#: Measure of a text (never null) by name.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words_of(t)),
    "word_chars": lambda t: _without(t, SPACES),
    "n_symbols": lambda t: F.length(t) - _without(t, SYMBOLS),
    "n_capitals": lambda t: F.length(t) - _without(t, CAPITALS),
    "n_lines": lambda t: F.size(_lines(t)),
    "n_dup_lines": lambda t: let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda t: repeated_words(words_of(t)),
}
#: What a measure costs per character, word and line of a text.
COST = {
    "n_words": (2, 4, 0),
    "word_chars": (3, 0, 0),
    "n_symbols": (3, 0, 0),
    "n_capitals": (3, 0, 0),
    "n_lines": (3, 0, 8),
    "n_dup_lines": (4, 0, 16),
    "n_repeat_words": (4, 60, 0),
}


class Rule:
    """Measures a rule reads and the condition, over those measures, under which it rejects."""

    def __init__(self, condition: Callable[..., Column], *reads: str):
        self.condition, self.reads = condition, reads

    def rejects(self, of: Callable[[str], Column]) -> Column:
        return self.condition(*map(of, self.reads))


#: Whole-number comparisons only.
RULES = {
    "too_few_words": Rule(lambda n: n < 20, "n_words"),
    "repeated_windows": Rule(lambda r, n: 100 * r > 30 * n, "n_repeat_words", "n_words"),
    "symbol_heavy": Rule(lambda s, n: 100 * s > 10 * n, "n_symbols", "n_words"),
    "shouting": Rule(lambda c, w: 100 * c > 40 * w, "n_capitals", "word_chars"),
    "duplicate_lines": Rule(lambda d, n: 100 * d > 30 * n, "n_dup_lines", "n_lines"),
    "word_length": Rule(lambda w, n: (w < 2 * n) | (w > 14 * n), "word_chars", "n_words"),
}
BASE_RULES = ("too_few_words", "repeated_windows")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all measures; they replace columns of the same name."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(F.struct("*").alias("row"), body.alias("body")).withColumns({"words": words_of(F.col("body")), "lines": _lines(F.col("body"))})
    shared = {
        "n_words": F.size("words"),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
    }
    found = [shared.get(n, of(F.col("body"))).cast("long").alias(n) for n, of in MEASURES.items()]
    return held.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in MEASURES], *found)


def plan_order(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None, known: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in order: rule, cost (of what it adds per row), rejects (sampled rows left that it rejects)."""
    rules = rules or RULES
    total = docs.count()
    sample = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / max(1, total)), seed=SEED)
    measured = measures(sample).withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    each = [r.rejects(F.col).alias(f"r{i}") for i, r in enumerate(rules.values())]
    sums = [F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("chars", "n_words", "n_lines")]]
    # at most one row for each combination of rejecting rules
    seen = measured.select(*each, "chars", "n_words", "n_lines").groupBy(*[f"r{i}" for i in range(len(rules))]).agg(*sums).collect()
    left, free, out = seen, set(known), []
    while len(out) < len(rules):
        rows = sum(r["rows"] for r in left)
        per_row = [sum(r[c] for r in left) / rows if rows else 0.0 for c in ("chars", "n_words", "n_lines")]
        options = []
        for i, (name, rule) in enumerate(rules.items()):
            if name not in {o["rule"] for o in out}:
                cost = 1 + sum(w * x for m in set(rule.reads) - free for w, x in zip(COST[m], per_row, strict=True))
                rejects = sum(r["rows"] for r in left if r[f"r{i}"])
                options.append((-rejects / cost, name, i, cost, rejects))
        _, name, i, cost, rejects = min(options)
        out.append({"rule": name, "cost": cost, "rejects": rejects})
        free |= set(rules[name].reads)
        left = [r for r in left if not r[f"r{i}"]]
    return out


def cascade(order: list[str], text: Column, rules: dict[str, Rule] | None = None, known: tuple[str, ...] = ()) -> Column:
    """Name of the first rule, in this order, that rejects; null if none does.

    Measures in ``known`` are columns; any other is taken when the first rule that reads it is reached, and kept for later ones.
    """
    rules = rules or RULES

    def from_rule(at: int, have: dict[str, Column]) -> Column:
        if at == len(order):
            return F.lit(None).cast("string")
        rule = rules[order[at]]
        missing = [m for m in dict.fromkeys(rule.reads) if m not in have]

        def bound(have: dict[str, Column], missing: list[str]) -> Column:
            if missing:
                return let(MEASURES[missing[0]](text), lambda value: bound(have | {missing[0]: value}, missing[1:]))
            return F.when(rule.rejects(have.__getitem__), F.lit(order[at])).otherwise(from_rule(at + 1, have))

        return bound(have, missing)

    return from_rule(0, {m: F.col(m) for m in known})


def judge(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``rejected_by`` (first rule of the chosen order that rejects) and ``kept``; they replace columns of the same name."""
    order = [r["rule"] for r in plan_order(docs, text, rules, known)]
    verdict = cascade(order, F.coalesce(F.col(text), F.lit("")), rules, known)
    out = docs.select(*[c for c in docs.columns if c not in ("rejected_by", "kept")], verdict.alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def rules_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    contract = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    body = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", "text", words_of(body).alias("words"))
    of = {"n_words": F.size("words"), "n_repeat_words": repeated_words(F.col("words"))}
    known = words.select("doc_id", "text", *[of.get(n, MEASURES[n](body)).cast("long").alias(n) for n in contract])
    base = RULES[BASE_RULES[0]].rejects(F.col) | RULES[BASE_RULES[1]].rejects(F.col)
    return judge(known, known=contract).select("doc_id", *contract, base.alias("base_failed"), "kept")


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8
), keyed AS (SELECT r, i, words[i:i+7] AS k FROM win),
twice AS (SELECT r, k FROM keyed GROUP BY r, k HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + unnest(range(0, 8)) AS p FROM keyed JOIN twice USING (r, k)),
rep AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_capitals > 40 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM m
"""
