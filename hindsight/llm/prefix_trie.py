"""Prefix trie of conversations by prefix doubling.

A turn gets a dense name, then aligned blocks of 2, 4, 8 ... turns get one from the names of
their halves. A prefix of d turns is its longest blocks in order, as the binary digits of d
say; it is named from the prefix without its last block and that block, longest last blocks
first. Both take a logarithm of the longest conversation in rounds. Equal names of one depth
are one node. Sums over subtrees take as many rounds again: what lies within 2^k turns below a
node is added to its ancestor 2^k turns up, which the node's smallest member names.

A round joins its rows with the table of its names. Names that hold more than a thousandth of
the rows, fewer than a thousand by that, are broadcast; the others are joined by shuffle, so a
turn or conversation that a third of all share lands in no single task. Turns are told apart
by 128-bit hashes of role and text; no text is shuffled. A conversation of very many turns is
numbered in buckets of turns. Digests of the conversations that end in a node need them in
order: they stream, sorted, past one running hash; no list of them is made.

Null roles and texts are empty ones; a null turn comes first; equal turns go by the hash of
role and text, repeated rows are turns of their own. Rows without a conv_id are in no
conversation. No conversations give no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

#: Shared first turns: conversations are dealt in families of FAMILY, at most HEADS - 1 turns are shared.
FAMILY, HEADS = 20, 4
#: Turns of a bucket when a conversation's turns are numbered; a name is hot above one in HOT_ONE_IN rows.
BUCKET_TURNS, HOT_ONE_IN = 4096, 1000


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ordinal from 1, h1, h2 (hashes of role and text) and words, for the turns of every conversation."""
    role, text = _text("role"), _text("text")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("turn"), text, role).alias("h2"),
        F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long").alias("words"),
    )
    turns = materialise(turns.withColumn("bucket", F.floor(F.col("turn") / BUCKET_TURNS)), "trie-turns")
    counts = turns.groupBy("c", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("c").orderBy(F.col("bucket").asc_nulls_first())
    before = counts.select("c", "bucket", (F.sum("n").over(order) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("c", "bucket").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2"))
    placed = turns.withColumn("place", place)
    first = placed.join(before.where("before = 0").select("c", F.col("bucket").alias("first")), "c").where(F.col("bucket").eqNullSafe(F.col("first"))).drop("first").withColumn("before", F.lit(0).cast("long"))
    later = placed.join(before.where("before > 0"), ["c", "bucket"])  # a null bucket is a first one
    keep = ["c", (F.col("before") + F.col("place")).alias("i"), "h1", "h2", "words"]
    return first.select(*keep).unionByName(later.select(*keep))


def share_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: their turns (c, i, h1, h2, words) and all conversations (c, n turns, with 0 for none).

    The first h turns come from conversation c - c % FAMILY, h = crc32(c) % HEADS; c's own turns after its first h follow.
    """
    turns = materialise(turns, "trie-numbered")
    sizes = turns.groupBy("c").agg(F.count("*").alias("own"))
    base, h = F.col("c") - F.col("c") % FAMILY, (F.crc32(F.col("c").cast("string")) % HEADS).cast("long")
    heads = turns.where((F.col("c") % FAMILY == 0) & (F.col("i") < HEADS)).select(F.col("c").alias("base"), "i", "h1", "h2", "words")
    given = sizes.select(base.alias("base"), F.least("own", F.lit(HEADS - 1)).alias("has"), "c").where("c = base").drop("c")
    convs = sizes.select("c", "own", base.alias("base"), h.alias("h")).join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = materialise(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("c", "base", "h", "taken", "n"), "trie-conversations")
    borrowed = convs.join(heads, "base").where("i <= taken").select("c", "i", "h1", "h2", "words")
    kept = turns.where(F.col("i") > h)
    # what the first h turns of a conversation give way to is known from its own row
    moved = kept.join(convs.select("c", "h", "taken"), "c").select("c", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "h1", "h2", "words")
    return materialise(borrowed.unionByName(moved), "trie-rebuilt"), convs.select("c", "n")


def _named(rows: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the dense name of their keys, the smallest c that has it (rep), and the table of names (keys, name, rep, n)."""
    found = rows.groupBy(*keys).agg(F.min("c").alias("rep"), F.count("*").alias("n"))
    found = materialise(found.withColumn("at", F.monotonically_increasing_id()), f"{label}-groups")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts, before, total = [], 0, 0
    for r in sorted(found.groupBy(part.alias("part")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()):  # a row per partition
        counts.append((r["part"], before))
        before, total = before + r["k"], total + r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(counts, "part long, before long"))
    names = found.withColumn("part", part).join(offsets, "part").select(*keys, (F.col("before") + within + 1).alias("name"), "rep", "n")
    hot = names.where(F.col("n") > total / HOT_ONE_IN).drop("n")  # fewer than HOT_ONE_IN by that
    joined = rows.join(F.broadcast(hot), keys, "left")
    rest = joined.where("name is null").drop("name", "rep").join(names.drop("n"), keys)
    return materialise(joined.where("name is not null").unionByName(rest), label), names


def name_prefixes(turns: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(c, d, name, rep) for every prefix of d turns of every conversation, and the nodes below the root (d, name, rep, n)."""
    blocks, _ = _named(turns.select("c", F.col("i").alias("j"), "h1", "h2"), ["h1", "h2"], "trie-blocks-0")
    levels = [blocks.select("c", (F.col("j") - 1).alias("j"), F.col("name").alias("b"))]
    while 2 ** len(levels) <= longest:
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("b")))
        pairs = levels[-1].groupBy("c", F.floor(F.col("j") / 2).alias("k")).agg(half(0).alias("x"), half(1).alias("y")).where("x is not null and y is not null")
        blocks, _ = _named(pairs.withColumnRenamed("k", "j"), ["x", "y"], f"trie-blocks-{len(levels)}")
        levels.append(blocks.select("c", "j", F.col("name").alias("b")))
    prefixes, nodes = None, None
    for k in reversed(range(len(levels))):
        # with 2^k the lowest digit of d, what comes before has longer last blocks: it is named already
        last = levels[k].where("j % 2 = 0").select("c", ((F.col("j") + 1) * 2**k).alias("d"), (F.col("j") * 2**k).alias("d0"), "b")
        if prefixes is None:
            rows = last.withColumn("a", F.lit(0).cast("long"))
        else:
            known = prefixes.select("c", F.col("d").alias("d0"), F.col("name").alias("a"))
            rows = last.join(known, ["c", "d0"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
        rows, names = _named(rows.select("c", "d", "a", "b"), ["d", "a", "b"], f"trie-prefixes-{k}")
        rows, names = rows.select("c", "d", "name", "rep"), names.select("d", "name", "rep", "n")
        prefixes = rows if prefixes is None else prefixes.unionByName(rows)
        nodes = names if nodes is None else nodes.unionByName(names)
    return prefixes, nodes


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, name, c) sorted by all three -> d, name and the digest of the c's, joined by commas."""
    node, running, rows = None, None, []
    for batch in batches:
        d, name, c = (batch.column(i).to_pylist() for i in range(3))
        begin = 0
        while begin < len(c):
            end, here = begin, (d[begin], name[begin])
            while end < len(c) and (d[end], name[end]) == here:
                end += 1
            said = ",".join(map(str, c[begin:end])).encode()
            if here == node:
                running.update(b"," + said)
            else:
                if node is not None:
                    rows.append((*node, running.hexdigest()))
                node, running = here, hashlib.sha256(said)
            begin = end
        if len(rows) >= 10_000:
            yield _digest_batch(rows)
            rows = []
    if node is not None:
        yield _digest_batch([*rows, (*node, running.hexdigest())])


def _digest_batch(rows: list) -> pa.RecordBatch:
    d, name, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(name, pa.int64()), pa.array(ends, pa.string())], ["d", "name", "ends_sha256"])


def _subtree_sums(nodes: DataFrame, prefixes: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """``nodes`` with ``values`` summed over subtrees, tops included."""
    known = prefixes.select(F.col("c").alias("rep"), F.col("d").alias("up"), F.col("name").alias("up_name"))
    step = 1
    while step <= deepest:
        rows = nodes.where(F.col("d") >= step).select("rep", (F.col("d") - step).alias("up"), *values)
        below = rows.join(known, ["rep", "up"], "left").groupBy(F.col("up").alias("d"), F.coalesce("up_name", F.lit(0)).alias("name")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        sums = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        kept = [c for c in nodes.columns if c not in values]
        last, nodes = nodes, materialise(nodes.join(below, ["d", "name"], "left").select(*kept, *sums), f"trie-sums-{step}")
        discard(last)
        step *= 2
    return nodes


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = share_heads(hashed_turns(conversations))
    every = convs.agg(F.count("*").alias("n"), F.min("c").alias("rep"), F.coalesce(F.max("n"), F.lit(0)).alias("deepest")).first()
    spark = conversations.sparkSession
    root = spark.createDataFrame([(0, 0, every["rep"], every["n"])] if every["n"] else [], "d long, name long, rep long, n long")
    prefixes, nodes = name_prefixes(turns, every["deepest"])
    root_prefix = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"), F.lit(every["rep"]).cast("long").alias("rep"))
    prefixes = prefixes.unionByName(root_prefix)
    spoken = turns.select(F.col("c").alias("rep"), F.col("i").alias("d"), "words")
    up = prefixes.select(F.col("c").alias("rep"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("rep").alias("parent_conv_id"))
    nodes = nodes.unionByName(root).join(spoken, ["rep", "d"], "left").join(up, ["rep", "d"], "left")
    nodes = materialise(nodes.withColumn("words", F.coalesce("words", F.lit(0))), "trie-nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["d", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n") - 1) * F.col("words")
    nodes = materialise(nodes.select("d", "name", "rep", "n", "parent_conv_id", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens")), "trie-sums")
    nodes = _subtree_sums(nodes, prefixes, every["deepest"], ["n_leaves", "saved_tokens"])
    ends = prefixes.join(convs.withColumnRenamed("n", "d"), ["c", "d"]).select("d", "name", "c")
    ends = ends.repartition("d", "name").sortWithinPartitions("d", "name", "c").mapInArrow(tidy(_digests), "d long, name long, ends_sha256 string")
    out = nodes.join(ends, ["d", "name"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


#: crc32 bit by bit, as DuckDB has no such function.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)))"""
ORACLE_SQL = f"""WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT c, l, {_CRC} % {HEADS} AS h FROM own),
  built AS (SELECT h.c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.c = h.c - h.c % {FAMILY}),
  members AS (SELECT c, d, l[1:d] AS p, len(l) = d AS ends FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM built)),
  nodes AS (SELECT p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
  kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
  valued AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[depth].t, '[^ \\t-\\r]+')) END AS own FROM nodes LEFT JOIN kids USING (p)),
  sums AS (SELECT p[1:k] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS k FROM valued) GROUP BY 1)
  SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, sums.n_leaves, sums.saved_tokens, v.ends_sha256
  FROM valued v JOIN sums ON sums.p = v.p LEFT JOIN nodes u ON v.depth > 0 AND u.p = v.p[1:v.depth - 1]"""
