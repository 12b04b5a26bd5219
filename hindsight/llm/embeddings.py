"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector kept per group.

Equal vectors become one with a weight. Cells are made level by level: a cell of many residents
fits centroids, one for every CELL_VECTORS residents and FAN at most, on a bounded sample of
them, in a task of its own; all its vectors go on to the new cells. Levels repeat until cells
are small, so their number follows the table however large it is, and vectors of a rare length
are divided like any other. A vector has a home cell, its most similar centroid, and
visits each cell whose centroid is nearly as similar, because a near copy may be at home there.
How nearly: along any direction a near copy of d components at the threshold is off by about
sqrt((2 - 2 * threshold) / d), and REACH times that is the margin, at every level. A cell
compares its residents with its residents and visitors in double precision. Cells larger than
a block are split into a grid of blocks, so no task holds more than two blocks, however full a
cell is. Each block reports link counts and a spanning forest of its links; pairs never leave
a block. A pair that meets in one of its two home cells only is counted there for both.

A pair is missed only if neither vector is within the margin of the other's home; the tests
and the README measure recall against brute force. Nothing below the threshold is linked.
Vectors of different lengths link with nothing.

Vectors that are null, empty, zero, or have null or non-finite components link with nothing.
Null ids are kept as rows that link with nothing. Rows with equal ids are vectors of their
own, which share the smallest component. Labels are never read. No valid vector: everything
is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise

#: A cell's centroids are fitted on at most so many of its residents, the ones of smallest id hash.
SAMPLE_VECTORS = 20_000
#: Residents a cell is meant to hold, fewest and most cells one is divided into, levels at most (cells beyond are compared in more blocks), vectors of a block.
CELL_VECTORS, LEAST_CELLS, FAN, MOST_LEVELS, BLOCK_VECTORS = 500, 8, 1024, 6, 2048
REACH = 2.2
ITERATIONS = 12


def spherical_kmeans(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; empty cells are given a row each."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(iterations):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-9
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.linalg.norm(sums, axis=1)[:, None]
    return c


_PLACED = "width int, cell long, resident boolean, rep long, weight long, v array<double>, home long, visits array<long>"


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    """A cell's sampled residents -> width, cell, its centroids."""
    sample = sample.sort_values("place")
    x, first = _unit(sample["v"]), sample.iloc[0]
    return pd.DataFrame({"width": [first["width"]], "cell": [first["cell"]], "centroids": [spherical_kmeans(x, int(first["parts"])).ravel()]})


def _spread(threshold: float):
    """A block of a cell's vectors and its centroids -> _PLACED, one row per new cell visited; a resident's home is the most similar."""

    def run(rows: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        names = [n.split()[0] for n in _PLACED.split(", ")]
        if rows.empty or cell.empty:
            return pd.DataFrame({n: [] for n in names})
        x = _unit(rows["v"])
        near = x @ np.asarray(cell["centroids"].iloc[0]).reshape(-1, x.shape[1]).T
        home = near.argmax(1)
        row, to = np.nonzero(near >= near.max(1)[:, None] - REACH * np.sqrt((2 - 2 * threshold) / x.shape[1]))
        base = rows["cell"].to_numpy() * FAN + 1
        visits = np.split(to + base[row], np.flatnonzero(np.diff(row)) + 1)
        out = rows.iloc[row][["width", "rep", "weight", "v"]]
        return out.assign(
            cell=base[row] + to, resident=rows["resident"].to_numpy(bool)[row] & (to == home[row]), home=(base + home)[row], visits=[visits[r] for r in row]
        )[names]  # every row visits one cell at least, so visits follow the rows

    return run


def _forest(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row and column id with the smallest id its links in this block lead to."""
    row_label, col_label = rows.copy(), cols.copy()
    linked = near.any(1)
    sub, cols_on = near[linked], near.any(0)
    sub = sub[:, cols_on]
    r, c = row_label[linked], col_label[cols_on]
    big = np.iinfo(np.int64).max
    while len(r):
        new_r = np.minimum(r, np.where(sub, c[None, :], big).min(1))
        new_c = np.minimum(c, np.where(sub, new_r[:, None], big).min(0))
        if (new_r == r).all() and (new_c == c).all():
            break
        r, c = new_r, new_c
    row_label[linked], col_label[cols_on] = r, c
    return row_label, col_label


def _compare(threshold: float):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        x = _unit(table["v"])
        ids, weight, home = (table[c].to_numpy() for c in ("rep", "weight", "home"))
        row, col = np.flatnonzero(table["is_row"].to_numpy(bool)), np.flatnonzero(~table["is_row"].to_numpy(bool))
        rows, cols = ids[row], ids[col]
        near = (x[row] @ x[col].T >= threshold) & (rows[:, None] != cols[None, :])
        links = near @ weight[col]
        # visitors whose home a resident does not visit count the link here
        foreign = near & (home[col] != table["cell"].iloc[0])[None, :]
        back, visits = np.zeros(len(col), np.int64), table["visits"].to_numpy()
        for r in np.flatnonzero(foreign.any(1)):
            c = np.flatnonzero(foreign[r])
            back[c[~np.isin(home[col[c]], visits[row[r]])]] += weight[row[r]]
        row_label, col_label = _forest(near, rows, cols)
        on = np.concatenate([row_label != rows, col_label != cols])
        counted = pd.DataFrame({"rep": np.concatenate([rows, cols]), "links": np.concatenate([links, back]), "to": np.int64(-1)})
        counted = counted[counted["links"] > 0]
        forest = pd.DataFrame({"rep": np.concatenate([rows, cols])[on], "links": np.int64(0), "to": np.concatenate([row_label, col_label])[on]})
        return pd.concat([counted, forest], ignore_index=True).assign(joins=lambda t: t["links"] == 0)

    return run


def _dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / BLOCK_VECTORS)).cast("int")


def place(reps: DataFrame, threshold: float) -> DataFrame:
    """_PLACED for ``reps(rep, weight, v)``: each vector once in its home cell, as a resident, and once in every other cell it visits."""
    rows = reps.select(F.size("v").alias("width"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("resident"), "rep", "weight", "v")
    rows = materialise(rows.withColumns({"home": F.lit(0).cast("long"), "visits": F.array(F.lit(0).cast("long"))}), "vector-cells")
    settled: list[DataFrame] = []
    for level in range(MOST_LEVELS):
        fill = rows.groupBy("width", "cell").agg(F.count_if("resident").alias("residents"), F.count("*").alias("members"))
        # the first level divides every table that can be, later ones cells that came out too full
        parts = F.least(F.greatest(F.floor(F.col("residents") / CELL_VECTORS), F.lit(LEAST_CELLS if level == 0 else 2)), F.lit(FAN)).cast("int")
        least = 2 * LEAST_CELLS if level == 0 else 4 * CELL_VECTORS
        fill = materialise(fill.withColumn("parts", F.when(F.col("residents") >= least, parts)), "vector-fill")
        large = fill.where("parts is not null").select("width", "cell", "members", "parts")
        if large.isEmpty():
            break
        settled.append(rows.join(fill.where("parts is null").select("width", "cell"), ["width", "cell"]))
        split = rows.join(large, ["width", "cell"])
        number = F.row_number().over(Window.partitionBy("width", "cell").orderBy(F.xxhash64("rep"), "rep"))
        sample = split.where("resident").select("width", "cell", "parts", "v", number.alias("place")).where(F.col("place") <= SAMPLE_VECTORS)
        centroids = materialise(sample.groupBy("width", "cell").applyInPandas(_fit, "width int, cell long, centroids array<double>"), "vector-centroids")
        each = F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / BLOCK_VECTORS).cast("int") - 1))
        sided = centroids.join(large, ["width", "cell"]).select(F.col("width").alias("width"), F.col("cell").alias("cell"), each.alias("block"), "centroids")
        sided = sided.select(*[F.col(c).alias(c) for c in sided.columns])
        split = split.withColumn("block", _dealt("members")).groupBy("width", "cell", "block")
        rows = materialise(split.cogroup(sided.groupBy("width", "cell", "block")).applyInPandas(_spread(threshold), _PLACED), "vector-cells")
    out = rows
    for part in settled:
        out = out.unionByName(part)
    if len(settled) > 1:  # with several levels a vector's home and visits are known only when all cells are
        out = materialise(out.drop("home", "visits"), "vector-leaves")
        known = out.groupBy("rep").agg(F.max(F.when(F.col("resident"), F.col("cell"))).alias("home"), F.collect_list("cell").alias("visits"))  # the few cells of one vector
        out = out.join(materialise(known, "vector-visits"), "rep")
    return out.select(*[n.split()[0] for n in _PLACED.split(", ")])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    valid = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & (square > 0)
    keyed = vectors.select("vec_id", v.alias("v"), F.when(F.coalesce(valid, F.lit(False)), F.xxhash64(v)).alias("h1"), F.xxhash64(F.lit("v"), v).alias("h2"))
    keyed = materialise(keyed, "vectors")
    good = keyed.where("h1 is not null")
    reps = materialise(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")), "vector-classes")
    if reps.isEmpty():
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = place(reps, threshold)
    fill = placed.groupBy("width", "cell").agg(F.count_if("resident").alias("residents"), F.count("*").alias("members"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_VECTORS).cast("int")
    fill = fill.select("width", "cell", blocks("residents").alias("rb"), blocks("members").alias("cb")).where("rb > 0")
    sided = placed.join(fill, ["width", "cell"])
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), n).cast("int")
    keep = ["home", "rep", "weight", "v"]
    as_row = sided.where("resident").select("width", "cell", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("c"), spread(F.col("rb"), 1).alias("r"), F.lit(True).alias("is_row"), *keep, "visits")
    none = F.lit(None).cast("array<long>").alias("visits")
    as_col = sided.select("width", "cell", spread(F.col("cb"), 2).alias("c"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"), F.lit(False).alias("is_row"), *keep, none)
    compared = as_row.unionByName(as_col).groupBy("width", "cell", "c", "r").applyInPandas(_compare(threshold), "rep long, links long, to long, joins boolean")
    compared = materialise(compared, "vector-links")
    links = compared.where("not joins").groupBy("rep").agg(F.sum("links").alias("links"))
    label = connected_components(compared.where("joins").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    label = label.withColumnRenamed("id", "rep")
    classes = reps.select("h1", "h2", "rep", "weight").join(links, "rep", "left").join(label, "rep", "left")
    classes = classes.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
