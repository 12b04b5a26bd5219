"""N-gram Jaccard self-join: universe-partition pigeonhole with one-deletion neighbourhoods.

Shingles are hashed into m segments. Two sets of Jaccard at least t differ in at most
H = floor((1-t)/(1+t) * (|x|+|y|)) shingles, so among any H + 1 segments at least one is the
same on both sides. The hashing depends on the size band; a set is indexed for its own band
and, if it can have partners there, for the one below.

Cost-based allocation: a set has one exact key for each of the first H + 1 + a segments, where
H is what it can differ by from any partner and a, the allowance, is the band's. In the first
u segments it has the keys of the one-deletion neighbourhood too (all variants that lack one
shingle). An exact key costs an opponent one difference, a segment with its neighbourhood two,
so a set may go without its dearest keys, up to a + u differences' worth. How many sets share
a key is counted over all sets. A set leaves out all keys above the lowest of LEVELS that it
can afford: one is lost for a segment whose exact key goes (two with a neighbourhood), one for
a neighbourhood that is not whole. Segments that lie within a common passage, and empty ones,
are so left out except by sets that consist of little else.

Why no pair is lost: whether a key is above a level is the same for all sets. Of two sets take
the one of the lower level; of the segments both index, H + 1 + a at least for the H of one of
them, it has lost a + u at most, so the other, which has all its keys there, must differ in
more than H to avoid it.

Sets that meet are compared twice over. First every member of a bucket with the bucket's
smallest (a stream past one set). Then, where a bucket still holds several components,
its members are compared by parity bitmaps: a bitmap has one bit per cell, set if the cell
holds an odd number of shingles, so the bits in which two bitmaps differ are at most the
shingles in which the sets differ. Members close by bitmap make families; in a family each
pair of different components is verified at most once, exactly, in blocks of BLOCK sets,
and a block reports a spanning forest of its links. Pairs never leave a task: what is
shuffled is linear in the members, and no task holds more than two blocks.

Buckets with equal smallest set count as one, so sets that share many segments meet once.
Equal sets are one class from the start, so copies cost nothing. No link that joins
components is lost.

Null and empty texts have an empty set and link with nothing. Ties cannot arise: ids
decide. Rows that repeat a doc_id are texts of their own, each with the smallest doc_id
its own text leads to; a null doc_id never names a component unless nothing else can.
Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, tidy
from .textstats import WordHashes, mix64, shingle_set

#: Numbers of sets that share a key up to which a set of that level uses it; the last level uses all.
LEVELS = (32, 1024, (1 << 63) - 1)
#: Fewest bits of a bitmap, bits per shingle, and sets of a block.
BITMAP, PER_SHINGLE, BLOCK = 256, 2, 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT_BITS, _SEGMENT_MASK = np.uint64(20), np.uint64((1 << 20) - 1)


class Bands:
    """Size bands for t = num/den, grown as larger sets come: lowest and highest size and most differences in the band's hashing.

    A band reaches from a size to the largest partner of its largest partner. Where larger
    sets meet those of the band, the differences are those of its highest size and a partner.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.rows, self.starts = num, den, [], np.empty(0, np.int64)

    def differences(self, x: int, y: int) -> int:
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> int:
        while not self.rows or size > self.rows[-1][1]:
            lo = self.rows[-1][1] + 1 if self.rows else 1
            hi = max(lo, lo * self.den**2 // self.num**2)
            self.rows.append((lo, hi, self.differences(hi, hi * self.den // self.num)))
            self.starts = np.asarray([r[0] for r in self.rows])
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def plans(self, size: int) -> list[tuple[int, int, int, int, int]]:
        """(band, segments, segments used, of these with neighbourhoods, allowance) of a set's own band and the one below.

        A band whose sets admit no difference links equal sets only, which are one class already: no segments.
        """
        own, out = self.of(size), []
        for band, largest in ((own, size * self.den // self.num), (own - 1, None)):
            most = self.rows[band][2] if band >= 0 else 0
            if largest is None:
                largest = self.rows[band][1]
                most = most if self.num * size <= self.den * largest else 0
            spare = (most + 1) // 16 + 1
            segments = most + 1 + spare
            used = self.differences(size, largest) + 1 + spare
            out.append((band, segments, used, segments // 50 + 1, spare) if most else (band, 0, 0, 0, 0))
        return out


def segment_keys(h: np.ndarray, band: int, segments: int, used: int, around: int) -> tuple[np.ndarray, int]:
    """Keys of a set (sorted distinct hashes) in one band: of the first ``used`` segments, then the variants of the first ``around``; and the number of variants.

    The low bits of a variant's key are its segment's number, which fits: texts of a string's greatest length have no 2^20
    segments with neighbourhoods. Keys that collide bring candidates too many and none too few.
    """
    seg = ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.uint16 if segments < 65536 else np.int64)
    mixed, counts = mix64(h)[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=segments)[:used]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    ends = np.cumsum(counts)
    sums = upto[ends] - upto[ends - counts]
    ids = np.arange(used, dtype=np.uint64)
    lacking = np.repeat(ids[:around], counts[:around])
    content = np.concatenate([sums, np.repeat(sums[:around], counts[:around]) - mixed[: len(lacking)]])
    ids = np.concatenate([ids, lacking])
    mixed = mix64(mix64(content) + ids * _STEP + np.uint64(band * 2 + 1))
    return (mixed << _SEGMENT_BITS) | (ids & _SEGMENT_MASK), len(lacking)


def bitmap(h: np.ndarray) -> bytes:
    """One bit per cell, set if an odd number of hashes falls there; a power of two of cells."""
    bits = BITMAP
    while bits < PER_SHINGLE * len(h):
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


_INDEXED = "doc_id long, h long, n long, sid long, check long, bits binary, keys array<long>, layout array<int>"


def _lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0 if r is None else len(r) for r in rows])
    held = [r for r in rows if r is not None]
    values = pa.array(np.concatenate(held), kind) if held else pa.array([], kind)
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=missing)


def _index(width: int, num: int, den: int):
    """Task body: doc_id, hash of the text, text -> _INDEXED; a set this task has met before brings its identity only.

    layout tells the keys apart: for the own band and then the one below, numbers of segments and of variants, segments with neighbourhoods, allowance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHashes(), Bands(num, den), set()
        for batch in batches:
            n, sid, check, bits, keys, layout, held, begun = [], [], [], [], [], [], 0, 0
            for at, text in enumerate(batch.column(2)):
                h = shingle_set(text.as_py(), width, hashes)
                digest = xxhash.xxh3_128_intdigest(h)
                n.append(len(h))
                sid.append((digest >> 64) - (1 << 63))
                check.append((digest & (1 << 64) - 1) - (1 << 63))
                if len(h) and digest not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(digest)
                    own, numbers = [np.empty(0, np.uint64)], []
                    for band, segments, used, around, spare in bands.plans(len(h)):
                        variants = 0
                        if segments:
                            found, variants = segment_keys(h, band, segments, used, around)
                            own.append(found)
                        numbers += [used, variants, around, spare]
                    bits.append(bitmap(h))
                    keys.append(np.concatenate(own).view(np.int64))
                    layout.append(np.asarray(numbers))
                    held += len(keys[-1])
                else:
                    for column in (bits, keys, layout):
                        column.append(None)
                if held >= 500_000 or at + 1 == batch.num_rows:
                    ids = [pa.array(x, pa.int64()) for x in (n, sid, check)]
                    lists = [_lists(keys, pa.int64()), _lists(layout, pa.int32())]
                    columns = [batch.column(0).slice(begun, len(n)), batch.column(1).slice(begun, len(n)), *ids, pa.array(bits, pa.binary()), *lists]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "sid", "check", "bits", "keys", "layout"])
                    begun = at + 1
                    n, sid, check, bits, keys, layout, held = [], [], [], [], [], [], 0

    return run


def allocate(indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, sid for every key a set indexes, of keys that two sets or more share; and the table to discard when these are read.

    ``indexed`` (sid, keys, layout) may hold a set once per task that met it; a key's rows are
    counted map-side. The count is one number per key for all sets, which is all the guarantee needs.
    """
    shared = indexed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    rows = indexed.select("sid", F.posexplode("keys").alias("at", "key")).join(shared, "key").select("key", "sid", "sets", "at")
    rows = materialise(rows, "jaccard-keys")
    # a set's dear keys, as many as it has keys at most, decide its level in either band
    dear = rows.where(F.col("sets") > LEVELS[0]).groupBy("sid").agg(F.collect_set(F.struct("key", "sets", "at")).alias("dear"))
    layouts = indexed.select("sid", "layout").join(dear.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])
    names = [f"{band}_{what}" for band in ("own", "low") for what in ("used", "variants", "around", "spare")]
    dear = dear.join(layouts, "sid").select("sid", "dear", *[F.get("layout", F.lit(i)).alias(n) for i, n in enumerate(names)])
    begins = {"own": F.lit(0), "low": F.col("own_used") + F.col("own_variants")}

    def level(band: str) -> Column:
        begin, used, variants, around, spare = begins[band], *[F.col(f"{band}_{what}") for what in ("used", "variants", "around", "spare")]

        def lost(level: int) -> Column:
            def gone(lo: Column, hi: Column, segment: Callable[[Column], Column]) -> Column:
                found = F.filter("dear", lambda k: (k["sets"] > level) & (k["at"] >= lo) & (k["at"] < hi))
                return F.array_distinct(F.transform(found, segment))

            # an exact key's place is its segment; those with neighbourhoods are the first fiftieth, so their numbers fit the bits
            exact = gone(begin, begin + used, lambda k: (k["at"] - begin).cast("long"))
            near = gone(begin + used, begin + used + variants, lambda k: k["key"].bitwiseAND(int(_SEGMENT_MASK)))
            return F.size(exact) + F.size(F.filter(exact, lambda s: s < around)) + F.size(F.array_except(near, exact))

        out = F.lit(LEVELS[-1])
        for x in reversed(LEVELS[:-1]):
            out = F.when(lost(x) <= spare + around, F.lit(x)).otherwise(out)
        return out

    dear = dear.select("sid", "dear", begins["low"].alias("begin"), level("own").alias("own_level"), level("low").alias("low_level"))
    used = F.filter("dear", lambda k: k["sets"] <= F.when(k["at"] < F.col("begin"), F.col("own_level")).otherwise(F.col("low_level")))
    used = dear.select("sid", F.explode(used).alias("used")).select("used.key", "sid")
    return rows.where(F.col("sets") <= LEVELS[0]).select("key", "sid").unionByName(used), rows


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each begins, from batches sorted by the first ``by`` columns; a group is two blocks at most."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        if not table.num_rows:
            continue
        marks = np.stack([np.asarray(table.column(c)) for c in range(by)])
        starts = np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(0)]))
        rest = table.slice(int(starts[-1]))
        if starts[-1]:
            yield table.slice(0, int(starts[-1])), starts[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


class Bitmaps:
    """Bitmaps of several sets, folded to a common width where two are compared."""

    def __init__(self, blobs: pa.ChunkedArray, n: np.ndarray, num: int, den: int):
        self.rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in blobs]
        self.words = np.fromiter(map(len, self.rows), np.int64, len(self.rows))
        self.n, self.num, self.den = n, num, den
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps at least so wide, folded, and the place of each set among them."""
        if words not in self.folded:
            wide = self.words >= words
            maps = np.stack([np.bitwise_xor.reduce(self.rows[r].reshape(-1, words), 0) for r in np.flatnonzero(wide)])
            self.folded[words] = maps, np.cumsum(wide) - 1
        return self.folded[words]

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets a and b can link as far as their bitmaps tell."""
        width, out = np.minimum(self.words[a], self.words[b]), np.zeros(len(a), bool)
        for words in np.unique(width):
            chosen, step = np.flatnonzero(width == words), max(1, 500_000 // int(words))
            maps, place = self.at(int(words))
            for lo in range(0, len(chosen), step):
                x = chosen[lo : lo + step]
                apart = np.bitwise_count(maps[place[a[x]]] ^ maps[place[b[x]]]).sum(1, dtype=np.int64)
                out[x] = apart <= (self.n[a[x]] + self.n[b[x]]) * (self.den - self.num) // (self.den + self.num)
        return out


def _spanning(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index each of ``count`` nodes reaches over the links a - b."""
    label = np.arange(count)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _families(num: int, den: int):
    """Task body: rows sorted by pivot, i, j, sid (with group, side, n, bits) -> a, b: a forest over the close members of different groups.

    On the diagonal of the grid all members meet; elsewhere those of side 1 meet those of side 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, 3):
            sid, n, group, side = (np.asarray(table.column(c)) for c in ("sid", "n", "group", "side"))
            maps = Bitmaps(table.column("bits"), n, num, den)
            size = np.diff(np.append(starts, len(sid)))
            first, second = [], []

            def meet(a: np.ndarray, b: np.ndarray) -> None:
                keep = (group[a] != group[b]) & ((side[a] == 0) | (side[a] != side[b]))  # noqa: B023
                a, b = a[keep], b[keep]
                keep = maps.close(a, b)  # noqa: B023
                first.append(a[keep])  # noqa: B023
                second.append(b[keep])  # noqa: B023

            # small groups side by side, large ones row by row
            bucket = np.repeat(np.where(size <= 64, np.arange(len(size)), -1), size)
            for step in range(1, int(size[size <= 64].max(initial=1))):
                meet(*(lambda x: (x, x + step))(np.flatnonzero((bucket[step:] == bucket[:-step]) & (bucket[step:] >= 0))))
            for k in np.flatnonzero(size > 64):
                for r in range(starts[k], starts[k] + size[k] - 1):
                    meet(np.full(starts[k] + size[k] - 1 - r, r), np.arange(r + 1, starts[k] + size[k]))
            a, b = np.concatenate(first or [np.empty(0, np.int64)]), np.concatenate(second or [np.empty(0, np.int64)])
            label = _spanning(len(sid), a, b)
            on = np.flatnonzero(label != np.arange(len(sid)))
            yield pa.RecordBatch.from_arrays([pa.array(sid[label[on]]), pa.array(sid[on])], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs: one merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(both) - common)


def _links(num: int, den: int):
    """Task body: rows sorted by family, i, j, sid (with group, side, n, bits, members) -> a, b: links that join groups, one per join at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, 3):
            sid, n, group, side = (np.asarray(table.column(c)) for c in ("sid", "n", "group", "side"))
            maps, blobs = Bitmaps(table.column("bits"), n, num, den), table.column("members")
            first, second = [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(sid)), strict=True):
                root = np.unique(group[lo:hi], return_inverse=True)[1]
                sets = [np.frombuffer(blobs[int(r)].as_buffer(), np.uint64) for r in range(lo, hi)]
                for r in range(hi - lo - 1):
                    b = np.flatnonzero((root[r + 1 :] != root[r]) & ((side[lo + r] == 0) | (side[lo + r + 1 : hi] != side[lo + r]))) + r + 1
                    for c in b[maps.close(np.full(len(b), lo + r), lo + b)]:
                        if root[c] != root[r] and _linked(sets[r], sets[c], num, den):
                            root[root == root[c]] = root[r]
                            first.append(sid[lo + r])
                            second.append(sid[lo + c])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    return run


def _past_pivot(column: str, test: Callable[[bytes, int, bytes, int], bool]):
    """Task body: rows sorted by pivot and block, the pivot itself first -> pivot, sid of the members that pass the test with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own, size = None, b"", 0
        for batch in batches:
            names = batch.schema.names
            rows = [batch.column(names.index(c)) for c in ("pivot", "sid", "n", column)]
            a, b = [], []
            for p, s, n, blob in zip(rows[0].to_pylist(), rows[1].to_pylist(), rows[2].to_pylist(), rows[3], strict=True):
                if p == s:
                    pivot, own, size = p, blob.as_buffer().to_pybytes(), n
                elif p == pivot and test(own, size, blob.as_buffer(), n):
                    a.append(p)
                    b.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bits_close(num: int, den: int):
    def test(x: bytes, n: int, y: bytes, m: int) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) != len(y):
            words = min(len(x), len(y))
            x, y = np.bitwise_xor.reduce(x.reshape(-1, words), 0), np.bitwise_xor.reduce(y.reshape(-1, words), 0)
        return int(np.bitwise_count(x ^ y).sum()) <= (n + m) * (den - num) // (den + num)

    return test


def _grid(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (by, sid, group, ...) of the ``by`` with several groups, dealt over a grid of blocks: by, i, j, sid, group, side, ..."""
    split = rows.groupBy(by).agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count("*").alias("members"))
    split = split.where("g1 < g2").select(by, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(split, by).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side")
    return placed.select(by, i, j, "sid", "group", side)


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, "sid")


def _sets(width: int):
    """Task body: text -> sid, its whole set; a set this task has met before brings nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            sids, members, held = [], [], 0
            for at, text in enumerate(batch.column(0)):
                h = shingle_set(text.as_py(), width, hashes)
                sid = (xxhash.xxh3_128_intdigest(h) >> 64) - (1 << 63)
                if sid not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(sid)
                    sids.append(sid)
                    members.append(h.tobytes())
                    held += len(h)
                if held >= 2_000_000 or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(members, pa.binary())], ["sid", "members"])
                    sids, members, held = [], [], 0

    return run


def component_links(texts: DataFrame, signed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b: links that connect the sets as all links would.

    ``signed`` is what :func:`_index` makes of ``texts(doc_id, h, text)``.
    """
    kept, shared = allocate(signed.where("keys is not null").select("sid", "keys", "layout"))
    least = kept.groupBy("key").agg(F.min("sid").alias("pivot"), F.max("sid").alias("last")).where("pivot < last").drop("last")
    met = materialise(kept.join(least, "key").where("sid <> pivot").select("pivot", "sid").distinct(), "jaccard-met")
    discard(shared)
    every = met.unionByName(met.select("pivot", F.col("pivot").alias("sid")).distinct())
    bits = signed.where("bits is not null").select("sid", "n", "bits").join(every.select("sid").distinct(), "sid", "left_semi")
    bits = materialise(bits.dropDuplicates(["sid"]), "jaccard-bits")

    def members(sids: DataFrame) -> DataFrame:
        """Whole sets again from one text of each."""
        homes = signed.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("h").alias("h"), F.min("n").alias("n"))
        homes = materialise(homes, "jaccard-homes")
        found = texts.join(homes.select("h").distinct(), "h", "left_semi").select("text").mapInArrow(tidy(_sets(width)), "sid long, members binary")
        found = materialise(found.dropDuplicates(["sid"]).join(homes.select("sid", "n"), "sid"), "jaccard-members")
        discard(homes)
        return found

    def past_pivots(pairs: DataFrame, body: DataFrame, column: str, test: Callable) -> DataFrame:
        """The (pivot, sid) of ``pairs`` that pass the test, a pivot's members dealt over blocks."""
        blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block")
        dealt = pairs.join(blocks, "pivot").select("pivot", block, "sid").join(body, "sid")
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        pivots = blocks.select("pivot", each, F.col("pivot").alias("sid")).join(body, "sid")
        names = ["pivot", "block", "sid", "n", column]
        rows = dealt.select(*names).unionByName(pivots.select(*names)).repartition("pivot", "block")
        rows = rows.sortWithinPartitions("pivot", "block", F.col("sid") != F.col("pivot"))
        found = materialise(rows.mapInArrow(tidy(_past_pivot(column, test)), "a long, b long"), "jaccard-past")
        return found.select(F.col("a").alias("pivot"), F.col("b").alias("sid"))

    close = past_pivots(met, bits, "bits", _bits_close(num, den))
    whole = members(close.select("sid").union(close.select("pivot")).distinct())
    exact = lambda x, _n, y, _m: _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)
    links = past_pivots(close, whole, "members", exact).select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    discard(whole)
    label = materialise(connected_components(links), "jaccard-labels").withColumnsRenamed({"id": "sid", "component": "group"})

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(label, "sid", "left").withColumn("group", F.coalesce("group", "sid"))

    # where several components are left: families of members close by bitmap, then exact links within them
    near = _grid(grouped(every), "pivot").join(bits, "sid").select("pivot", "i", "j", "sid", "group", "side", "n", "bits")
    near = materialise(_sorted(near, "pivot", "i", "j").mapInArrow(tidy(_families(num, den)), "a long, b long").distinct(), "jaccard-near")
    family = materialise(connected_components(near), "jaccard-families").withColumnsRenamed({"id": "sid", "component": "family"})
    placed = materialise(_grid(grouped(family), "family"), "jaccard-placed")
    whole = members(placed.select("sid").distinct())
    inside = placed.join(bits, "sid").join(whole.drop("n"), "sid")
    inside = inside.select("family", "i", "j", "sid", "group", "side", "n", "bits", "members")
    more = materialise(_sorted(inside, "family", "i", "j").mapInArrow(tidy(_links(num, den)), "a long, b long"), "jaccard-links")
    for done in (met, bits, near, placed, whole):
        discard(done)
    return links.unionByName(more)


def jaccard_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of ``docs(doc_id, text)``.

    Documents link when den * |x & y| >= num * |x | y| over sets of ``width``-word shingles;
    class_id is the smallest doc_id with the same set, component_id the smallest reachable.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    signed = materialise(texts.mapInArrow(tidy(_index(width, num, den)), _INDEXED), "jaccard-sets")
    classes = signed.where("n > 0").groupBy("sid", "check").agg(F.min("doc_id").alias("class_id"))
    label = materialise(connected_components(component_links(texts, signed, width, num, den)), "jaccard-components")
    # sets to documents: a component's id is its smallest document
    home = classes.join(label, F.col("sid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = home.groupBy("component").agg(F.min("class_id").alias("component_id"))
    home = home.join(smallest, "component").select("sid", "check", "class_id", "component_id")
    out = signed.select("doc_id", "n", "sid", "check").join(home, ["sid", "check"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, 90 percent."""
    return jaccard_groups(docs, width=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Rows of ``docs`` that stand for their group: those of the smallest doc_id of each component.

    Of rows that repeat a doc_id, all stay if one does. Documents without words and rows without a doc_id stay.
    """
    groups = jaccard_groups(docs, width, num, den)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
