"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

Inner products become distances: a row x gets one more component, sqrt(M^2 - |x|^2) with M the
largest norm, and a query q gets a zero, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The best rows are
the nearest ones, and a window of scores is an annulus around the query.

Trees are grown level by level as Spark jobs. A node with more than LEAF_ROWS rows fits a small
binary tree of vantage points (at most 2^FAN_LEVELS children) on its SAMPLE_ROWS rows of smallest
hash; all rows of the node go to a child by their distances, and each child keeps, exactly and
over all its rows, the least and largest distance to the vantage points above it. Levels repeat
until nodes are small, so the depth grows with the logarithm of the table. There are two indexes:
a tree for every label, in which the positives are looked for, and one of all rows for negatives.

A search goes down the levels by joins. It visits the PROBED nearest children first; the k-th
hit so far shrinks the annulus; then all children whose bounds meet what is left. Leaves
are compared in blocks of bounded size, so results are exact whatever the sample or the shape
of the data; the bounds only save visits. Nothing is dropped or capped.

Rows of equal label and vector are one point that keeps its smallest ids (as many as a result
can show); each point is searched once, however many anchors share it. Rows without an id, a
label, a vector, or with null or non-finite components take no part. An empty vector has score
0 with other empty ones. Vectors of different lengths have no score with each other. Repeated
rows count once; a row is never its own positive, nor is a row that repeats its id. Fewer hits
than asked for give what there is; no anchors give no rows. Scores are exact up to 2^53.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rows of a leaf, levels of one node's binary tree, rows it is fitted on, and levels of nodes at most (leaves beyond are compared in more blocks).
LEAF_ROWS, FAN_LEVELS, SAMPLE_ROWS, MOST_LEVELS = 2048, 6, 1024, 8
#: Rows and queries of one block, children visited first, slices of a point's anchors.
BLOCK_ROWS, PROBED, SLICES = 2048, 2, 16
EVERY, SHIFT_EVERY, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES = 5, 3

_POINT = "tree long, node long, pid string, label int, v array<double>, ids array<long>"
_QUERY = "tree long, node long, pid string, label int, v array<double>, lo array<double>, hi array<double>, rows long"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that makes all norms ``sqrt(most)``."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _fit(most: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sampled rows of a node -> tree, node, depth, its vantage points in heap order and their radii."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["place", "pid"])
        x = _lifted(_matrix(sample["v"]), most)
        depth = int(np.clip(np.ceil(np.log2(sample["rows"].iloc[0] * 2 / LEAF_ROWS)), 1, FAN_LEVELS))
        points, radii, held = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1), {0: np.arange(len(x))}
        for i in range(2**depth - 1):
            mine = held.pop(i)
            if len(mine):
                tried = mine[:8]
                away = _apart(x[tried], x[mine])
                best = away.std(1).argmax()
                points[i], radii[i] = x[tried[best]], np.median(away[best])
                near = away[best] <= radii[i]
            else:
                near = np.zeros(0, bool)
            held[2 * i + 1], held[2 * i + 2] = mine[near], mine[~near]
        first = sample.iloc[0]
        return pd.DataFrame({"tree": [first["tree"]], "node": [first["node"]], "depth": [depth], "points": [points.ravel()], "radii": [radii]})

    return run


def _route(most: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A block of a node's rows and its tree -> the rows in their children, with their distances to the points passed."""

    def run(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or tree.empty:
            return pd.DataFrame({c: [] for c in ("tree", "node", "pid", "label", "v", "ids", "passed")})
        radii, depth = tree["radii"].iloc[0], int(tree["depth"].iloc[0])
        points = np.asarray(tree["points"].iloc[0]).reshape(len(radii), -1)
        away = _apart(_lifted(_matrix(rows["v"]), most), points)
        at, every, passed = np.zeros(len(rows), np.int64), np.arange(len(rows)), []
        for _ in range(depth):
            passed.append(away[every, at])
            at = 2 * at + 1 + (passed[-1] > radii[at])
        child = rows["node"].to_numpy() * 2**FAN_LEVELS + at - (2**depth - 1) + 1
        return pd.DataFrame({"tree": rows["tree"], "node": child, "pid": rows["pid"], "label": rows["label"], "v": rows["v"], "ids": rows["ids"], "passed": list(np.stack(passed, 1))})

    return run


def _blocked(rows: DataFrame, n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "pid"), F.ceil(F.col(n) / BLOCK_ROWS)).cast("int")


def _each_block(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.ceil(n / BLOCK_ROWS).cast("int") - 1))


def _anew(frame: DataFrame, *without: str) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup may come from one table."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns if c not in without])


class Index:
    """Levels of nodes (tree, node, depth, points, radii, children with bounds) and the rows in their leaves."""

    def __init__(self, points: DataFrame, most: float):
        """``points``: tree, pid, label, v, ids, and width; most: the largest squared norm."""
        self.most, self.levels = most, []
        rows = materialise(points.withColumn("node", F.lit(0).cast("long")).select(*[c.split()[0] for c in _POINT.split(", ")]), "vantage-rows")
        settled = []
        for _ in range(MOST_LEVELS):
            fill = materialise(rows.groupBy("tree", "node").agg(F.count("*").alias("rows")), "vantage-fill")
            large = fill.where(F.col("rows") > LEAF_ROWS)
            if large.isEmpty():
                break
            settled.append(rows.join(fill.where(F.col("rows") <= LEAF_ROWS), ["tree", "node"]).drop("rows"))
            split = rows.join(large, ["tree", "node"])
            place = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.xxhash64("pid"), "pid"))
            sample = split.select("tree", "node", "pid", "v", "rows", place.alias("place")).where(F.col("place") <= SAMPLE_ROWS)
            trees = materialise(sample.groupBy("tree", "node").applyInPandas(_fit(self.most), "tree long, node long, depth int, points array<double>, radii array<double>"), "vantage-trees")
            sided = _anew(trees.join(large, ["tree", "node"]).withColumn("block", _each_block(F.col("rows"))), "rows")
            split = split.withColumn("block", _blocked(split, "rows", 1)).groupBy("tree", "node", "block")
            split = split.cogroup(sided.groupBy("tree", "node", "block")).applyInPandas(_route(self.most), _POINT + ", passed array<double>")
            rows = materialise(split, "vantage-rows")
            bounds = [f(F.get("passed", F.lit(i))).alias(f"{name}{i}") for i in range(FAN_LEVELS) for f, name in ((F.min, "lo"), (F.max, "hi"))]
            listed = lambda name: F.array_compact(F.array(*[F.col(f"{name}{i}") for i in range(FAN_LEVELS)])).alias(name)
            children = rows.groupBy("tree", "node").agg(F.count("*").alias("rows"), *bounds)
            parent = F.shiftright(F.col("node") - 1, FAN_LEVELS)
            children = children.groupBy("tree", parent.alias("parent")).agg(F.collect_list(F.struct("node", "rows", listed("lo"), listed("hi"))).alias("children"))  # at most 2^FAN_LEVELS
            joined = trees.join(children.withColumnRenamed("parent", "node"), ["tree", "node"])
            self.levels.append(materialise(joined, "vantage-level"))
            rows = rows.drop("passed")
        for part in settled:
            rows = rows.unionByName(part)
        self.leaves = materialise(rows, "vantage-leaves") if settled else rows
        self.fill = materialise(self.leaves.groupBy("tree", "node").agg(F.count("*").alias("rows")), "vantage-fill")

    def _down(self, queries: DataFrame, probe: bool) -> DataFrame:
        """(query, leaf) pairs: all whose bounds meet a window of the query, or the nearest few at each node."""
        here, arrived = queries, None
        for depth, level in enumerate(self.levels):
            inner = F.col("rows") > LEAF_ROWS
            done, here = here.where(~inner), here.where(inner)
            arrived = done if arrived is None else arrived.unionByName(done)
            asked = here.groupBy("tree", "node").agg(F.count("*").alias("asked"))
            sided = _anew(level.join(asked, ["tree", "node"]).withColumn("block", _each_block(F.col("asked"))), "asked")
            here = here.join(asked, ["tree", "node"])
            here = here.withColumn("block", _blocked(here, "asked", 2)).groupBy("tree", "node", "block")
            here = materialise(here.cogroup(sided.groupBy("tree", "node", "block")).applyInPandas(_descend(self.most, PROBED if probe else None), _QUERY), f"vantage-visits-{depth}")
        return here if arrived is None else here.unionByName(arrived)

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """``queries(tree, pid, label, v, lo, hi)`` -> pid, j, score, id: the first k rows of each window j, higher scores, then smaller ids first."""
        held = ["tree", "node", "pid", "label", "v", "lo", "hi", "rows"]
        roots = self.levels[0].select("tree", F.aggregate("children", F.lit(0).cast("long"), lambda a, c: a + c["rows"]).alias("rows")) if self.levels else None
        small = self.fill.where("node = 0").select("tree", "rows")
        roots = small if roots is None else roots.unionByName(small)
        queries = materialise(queries.join(roots, "tree").withColumn("node", F.lit(0).cast("long")).select(*held), "vantage-queries")
        if self.levels:  # a first look shrinks the windows
            first = self._compared(self._down(queries, True), k, same_label).where(F.col("place") == k)
            least = first.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("least"))  # one entry per window
            lo = F.transform("lo", lambda x, j: F.greatest(x, F.coalesce(F.try_element_at("least", j), x)))
            queries = materialise(queries.join(least, "pid", "left").withColumn("lo", lo).select(*held), "vantage-queries")
        return self._compared(self._down(queries, False), k, same_label)

    def _compared(self, visits: DataFrame, k: int, same_label: bool) -> DataFrame:
        visits = materialise(visits.drop("rows"), "vantage-visits")
        counts = visits.groupBy("tree", "node").agg(F.count("*").alias("asked")).join(self.fill, ["tree", "node"])
        keys = ["tree", "node", "rb", "qb"]
        rows = self.leaves.join(counts, ["tree", "node"])
        rows = rows.withColumn("rb", _blocked(rows, "rows", 3)).withColumn("qb", _each_block(F.col("asked"))).select(*keys, "pid", "label", "v", "ids")
        asked = visits.join(counts, ["tree", "node"])
        asked = asked.withColumn("qb", _blocked(asked, "asked", 4)).withColumn("rb", _each_block(F.col("rows"))).select(*keys, "pid", "label", "v", "lo", "hi")
        found = _anew(asked).groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_hits(k, same_label), "pid string, j int, score double, id long")
        place = F.row_number().over(Window.partitionBy("pid", "j").orderBy(F.col("score").desc(), "id"))
        out = materialise(found.withColumn("place", place).where(F.col("place") <= k), "vantage-hits")
        discard(visits)
        return out


def _descend(most: float, probed: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A block of queries at a node and the node -> the queries at the children they visit."""

    def run(queries: pd.DataFrame, level: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _QUERY.split(", ")]
        if queries.empty or level.empty:
            return pd.DataFrame({c: [] for c in names})
        node = level.iloc[0]
        depth, children = int(node["depth"]), node["children"]
        q = _matrix(queries["v"])
        points = np.asarray(node["points"]).reshape(2**depth - 1, -1)
        square = (q * q).sum(1)
        away = np.sqrt(np.maximum(square[:, None] + most - 2 * q @ points[:, :-1].T, 0))
        slack = 1e-7 * (1 + np.sqrt(square + most))
        out = []
        radius = lambda s: np.sqrt(np.maximum(square[:, None] + most - 2 * s, 0))
        outer, inner = radius(_matrix(queries["lo"])), radius(_matrix(queries["hi"]))
        outer[np.isnan(outer)], inner[np.isnan(inner)] = np.inf, 0
        wanted = _matrix(queries["lo"]) <= _matrix(queries["hi"])
        nearest, farthest = np.zeros((len(q), len(children))), np.zeros((len(q), len(children)))
        for c, child in enumerate(children):
            at, path = int(child["node"] - node["node"] * 2**FAN_LEVELS - 1 + 2**depth - 1), []
            while at:
                at = (at - 1) // 2
                path.append(at)
            d = away[:, path[::-1]]
            lo, hi = np.asarray(child["lo"]), np.asarray(child["hi"])
            nearest[:, c] = np.maximum(np.maximum(d - hi, lo - d).max(1), 0) - slack
            farthest[:, c] = (d + hi).min(1) + slack
        meets = (wanted[:, :, None] & (nearest[:, None, :] <= outer[:, :, None]) & (farthest[:, None, :] >= inner[:, :, None])).any(1)
        if probed is not None:  # nearest first, seen from the innermost edge of the windows
            first = np.where(meets, np.maximum(nearest, inner.min(1)[:, None]), np.inf)
            order = np.lexsort((np.broadcast_to(farthest, first.shape), first), axis=1)
            chosen = np.zeros_like(meets)
            np.put_along_axis(chosen, order[:, :probed], True, 1)
            meets &= chosen
        for c, child in enumerate(children):
            part = queries[meets[:, c]]
            if len(part):
                out.append(part.assign(node=np.int64(child["node"]), rows=np.int64(child["rows"]))[names])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    return run


def _hits(k: int, same_label: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A block of queries and one of rows -> for each query and window the rows that may be among its first k."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"pid": pd.Series([], dtype=str), "j": pd.Series([], dtype="int32"), "score": pd.Series([], dtype=float), "id": pd.Series([], dtype="int64")})
        if queries.empty or rows.empty:
            return none
        rows = rows.assign(first=[i[0] for i in rows["ids"]]).sort_values("first", kind="stable")  # of equal scores argmax takes the smallest id
        scores = _matrix(queries["v"]) @ _matrix(rows["v"]).T
        ok = queries["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]
        scores[~ok if same_label else ok] = -np.inf
        lo, hi = _matrix(queries["lo"]), _matrix(queries["hi"])
        pids, ids, every, out = queries["pid"].to_numpy(), rows["ids"].to_numpy(), np.arange(len(queries)), []
        for j in range(lo.shape[1]):
            left = np.where((scores >= lo[:, j, None]) & (scores <= hi[:, j, None]), scores, -np.inf)
            for _ in range(min(k, len(rows))):
                at = left.argmax(1)
                best = left[every, at]
                on = np.flatnonzero(best > -np.inf)
                if not len(on):
                    break
                out.append(pd.DataFrame({"pid": pids[on], "j": np.int32(j), "score": best[on], "id": [i[:k] for i in ids[at[on]]]}).explode("id"))
                left[every, at] = -np.inf
        return pd.concat(out, ignore_index=True).astype({"id": "int64"}) if out else none

    return run


def _padded(values: Column, n: int, fill: float) -> Column:
    return F.slice(F.concat(values.cast("array<double>"), F.array_repeat(F.lit(fill), n)), 1, n)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors(vec_id, embedding, label)`` whose id ``every`` divides."""
    raw = F.col("embedding").cast("array<double>")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & raw.isNotNull() & ~F.coalesce(bad, F.lit(True))
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("int")
    sound = vectors.where(valid).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(raw, lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    key = F.concat(F.hex(F.xxhash64("v", "label")), F.lit("-"), F.hex(F.xxhash64(F.lit("point"), "label", "v")))
    sound = materialise(sound.withColumn("pid", key), "mining-rows")
    members = materialise(sound.select("pid", "vec_id").distinct(), "mining-members")
    kept = max(positives + 1, negatives)
    place = F.row_number().over(Window.partitionBy("pid").orderBy("vec_id"))
    smallest = members.withColumn("place", place).where(F.col("place") <= kept).groupBy("pid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most kept ids
    points = sound.groupBy("pid").agg(F.first("label").alias("label"), F.first("v").alias("v")).join(smallest, "pid")
    points = materialise(points.withColumn("width", F.size("v")), "mining-points")
    discard(sound)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = points.agg(F.max(square)).first()[0] or 0.0
    asked = points.join(members.where(F.col("vec_id") % every == 0).select("pid").distinct(), "pid", "left_semi")
    infinite = lambda sign: F.array(F.lit(sign * float("inf")))
    # vectors of another length are in other trees
    own = F.col("label").cast("long") * 1_000_003 + F.col("width")
    wanted = asked.select(own.alias("tree"), "pid", "label", "v", infinite(-1).alias("lo"), infinite(1).alias("hi"))
    best = Index(points.withColumn("tree", own), most).search(wanted, positives + 1, True)
    ranked = best.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("place", F.col("score").cast("long").alias("score"), "id"))).alias("best"))  # positives + 1 at most
    ranked = materialise(ranked.withColumn("scores", F.array_sort(F.array_distinct(F.transform("best", lambda b: b["score"])))), "mining-positives")
    n = positives + 1
    windows = ranked.withColumn("scores", F.filter("scores", lambda p: p >= 0)).where(F.size("scores") > 0)
    low, high = F.transform("scores", lambda p: F.floor((p + 1) / 2)), F.transform("scores", lambda p: F.floor(p * 95 / 100))
    windows = windows.select("pid", _padded(low, n, 1.0).alias("lo"), _padded(high, n, 0.0).alias("hi"))
    wanted = asked.join(windows, "pid").select(F.col("width").cast("long").alias("tree"), "pid", "label", "v", "lo", "hi")
    hard = Index(points.withColumn("tree", F.col("width").cast("long")), most).search(wanted, negatives, False)
    hard = hard.groupBy("pid", "j").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").cast("long").alias("negative_score")))).alias("hard"))  # negatives at most
    hard = hard.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("j", "hard"))).alias("hard"))  # one entry per window
    results = ranked.join(hard, "pid").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    anchors = members.where(F.col("vec_id") % every == 0).select("pid", F.col("vec_id").alias("anchor_id"), F.pmod(F.xxhash64("vec_id"), F.lit(SLICES)).cast("int").alias("slice"))
    shown = anchors.join(results, ["pid", "slice"])
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("anchor_id")), 1, positives)
    shown = shown.select("anchor_id", F.explode(others).alias("p"), F.filter("scores", lambda p: p >= 0).alias("scores"), "hard")
    at = (F.array_position("scores", F.col("p.score")) - 1).cast("int")
    shown = shown.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.inline(F.try_element_at("hard", at)))
    return shown.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
  positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""
