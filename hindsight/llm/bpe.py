"""Byte-level BPE: ranked merges folded by higher-order functions over distinct words.

Texts are cut into words by the tokenizer's pattern. A task remembers the words it has met,
so each is encoded once in a task, however many texts hold it, and nothing is shuffled. Words
that are pieces themselves need no merge. For any other the task lists the ranks of the pieces
that occur in its bytes, in order; a higher-order fold goes through them and replaces the pair
each rank stands for, leftmost first, in the word's byte tokens. The pairs by rank are a
literal of the plan. Every piece is merged from two earlier ones (other vocabularies are
refused), so a merge never opens one of lower rank, and two neighbours that make up a piece
are the two its bytes merge to on their own: one pass in rank order is the whole merging. A token is one character of a string there,
its id moved by SHIFT. Decoding concatenates the pieces of the ids. The last step strings words
together to texts by their numbers.

A task forgets its words when it holds MOST_WORDS and starts afresh; both sides of the fold
do so at the same row, and rows are cut by texts and new words, so memory is bounded by
these figures and the longest text.

Null and empty texts have no tokens. Words are limited by nothing; the fold's cost grows
with the square of a single word's length. Repeated rows are encoded each, extra columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, tidy

#: A token id plus SHIFT is its character; all stay below the surrogates.
SHIFT, STOP = 256, 0xD800 - 256
#: Words a task remembers, and new words and code points of text that make up one row between the steps.
MOST_WORDS, ROW_WORDS, ROW_CHARS = 250_000, 4_096, 1_000_000


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[bytes, ...]:
    """Pieces in rank order."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    if len(out) > STOP:
        raise ValueError(f"{path}: more than {STOP} pieces")
    return tuple(out)


def _halves(piece: bytes, rank_of: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two pieces a piece is merged from: its bytes merged by the ranks before its own."""
    parts, own = [piece[i : i + 1] for i in range(len(piece))], rank_of[piece]
    while len(parts) > 2:
        rank, at = min((rank_of.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"{piece!r} is not merged from two earlier pieces")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def _tables(path: str) -> tuple[str, str, str]:
    """JSON of the pairs by the rank of their merge, of the tokens' characters, and of the pieces by id in hex."""
    vocabulary = _vocabulary(path)
    rank_of = {p: i for i, p in enumerate(vocabulary) if p}
    pairs = ["".join(chr(rank_of[x] + SHIFT) for x in _halves(p, rank_of)) if len(p) > 1 else "" for p in vocabulary]
    tokens = [chr(i + SHIFT) for i in range(len(vocabulary))]
    return tuple(json.dumps(x, separators=(",", ":")) for x in (pairs, tokens, [p.hex().upper() for p in vocabulary]))


def encode_word(word: Column, ranks: Column, pairs: Column, tokens: Column) -> Column:
    """Tokens of one word, a character each: a fold over the ranks that can occur in it, in order."""
    return F.aggregate(ranks, word, lambda parts, rank: F.replace(parts, F.get(pairs, rank), F.get(tokens, rank)))


def decode_word(word: Column, pieces: Column) -> Column:
    """Bytes of a word's tokens."""
    return F.unhex(F.array_join(F.transform(F.split(word, ""), lambda t: F.get(pieces, F.ascii(t) - SHIFT)), ""))


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _trie(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The beginnings of pieces, numbered from 0, the empty one, as a hash table of keys and values.

    A key is parent * 256 + byte; it stands in its slot or the first free place behind. The value
    is the child's number times 2 ** 16 and, in the low bits, 1 + the rank of the piece it is (0: none).
    """
    vocabulary = _vocabulary(path)
    number, children = {b"": 0}, {}
    for piece in vocabulary:
        for n in range(1, len(piece) + 1):
            if piece[:n] not in number:
                number[piece[:n]] = len(number)
                children[number[piece[: n - 1]] * 256 + piece[n - 1]] = number[piece[:n]] << 16
    for rank, piece in enumerate(vocabulary):
        if piece:
            children[number[piece[:-1]] * 256 + piece[-1]] += rank + 1
    keys, values = np.full((1 << 20) + 1024, -1), np.zeros((1 << 20) + 1024, np.int64)
    left, more = np.array(list(children), np.int64), np.array(list(children.values()), np.int64)
    place = _slot(left)
    while len(left):
        free = keys[place] < 0
        keys[place[free]], values[place[free]] = left[free], more[free]
        late = keys[place] != left
        left, more, place = left[late], more[late], place[late] + 1
    return keys, values


def _ranks_within(words: list[bytes], path: str) -> pa.ListArray:
    """For each word, the ranks of the pieces of two bytes or more that occur in it, each once, in order."""
    keys, values = _trie(path)
    flat, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum([len(w) for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    at, node, n, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0, [np.empty(0, np.int64)]
    while len(at):
        wanted = node * 256 + flat[at + n]
        place = _slot(wanted)
        while len(other := np.flatnonzero((keys[place] != wanted) & (keys[place] >= 0))):
            place[other] += 1
        is_there = keys[place] == wanted
        at, n, child = at[is_there], n + 1, values[place[is_there]]
        if n > 1:
            piece = child & 0xFFFF
            found.append((word[at] << 16 | piece)[piece > 0] - 1)
        inside = at + n < ends[word[at]]
        at, node = at[inside], child[inside] >> 16
    pairs = np.unique(np.concatenate(found))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs >> 16, minlength=len(words)))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((pairs & 0xFFFF).astype(np.int32)))


class _Words(dict):
    """Word to number: a piece's is its rank, others follow in order of first sight and wait in ``new``."""

    def __init__(self, path: str):
        super().__init__()
        pieces = _vocabulary(path)
        self.rank_of = {p: i for i, p in enumerate(pieces) if p}
        self.bytes = np.array([self.rank_of.get(bytes([b]), 0) + SHIFT for b in range(256)], "<u2")
        self.first = self.next = len(pieces)
        self.new: list[bytes] = []

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "replace")
        number = self.rank_of.get(raw)
        if number is None:
            number, self.next = self.next, self.next + 1
            self.new.append(raw)
        self[word] = number
        return number

    def as_tokens(self) -> list[str]:
        """The new words as byte tokens."""
        chars = self.bytes[np.frombuffer(b"".join(self.new), np.uint8)].tobytes().decode("utf-16-le")
        ends = np.cumsum([0, *map(len, self.new)]).tolist()
        return [chars[a:b] for a, b in itertools.pairwise(ends)]


def _rows(path: str, pattern: str) -> Callable:
    """Task body: doc_id, text -> rows of new words, the ranks within them, doc ids and word numbers of each text."""
    names = ["afresh", "words", "ranks", "ids", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(path)
        find, afresh, ids, rows, size = regex.compile(pattern).findall, True, [], [], 0

        def row() -> pa.RecordBatch:
            ranks = _ranks_within(words.new, path)
            ranks = pa.ListArray.from_arrays(pa.array([0, len(ranks)], pa.int32()), ranks)
            lists = [pa.array([words.as_tokens()], pa.list_(pa.string())), ranks, pa.array([ids], pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([afresh]), *lists], names)

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                ids.append(doc_id)
                found = find(text)
                rows.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)).tobytes())
                size += len(text)
                if size >= ROW_CHARS or len(words.new) >= ROW_WORDS:
                    yield row()
                    words.new, afresh, ids, rows, size = [], False, [], [], 0
                    if words.next - words.first >= MOST_WORDS:
                        words.clear()
                        words.next, afresh = words.first, True
            pa.default_memory_pool().release_unused()
        if ids:
            yield row()

    return run


def _texts(path: str) -> Callable:
    """Task body: rows with each new word's tokens and decoded bytes -> doc_id, token_ids (uint32, little-endian), decoded."""
    pieces = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [i.to_bytes(4, "little") for i in range(len(pieces))]
        packed, plain = list(first), list(pieces)
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column("afresh")[at].as_py():
                    packed, plain = list(first), list(pieces)
                for word in batch.column("tokens")[at].as_py():
                    packed.append((np.frombuffer(word.encode("utf-16-le"), "<u2").astype("<u4") - SHIFT).astype("<u4").tobytes())
                plain += batch.column("decoded")[at].as_py()
                ids, rows = batch.column("ids")[at].as_py(), batch.column("rows")[at].values
                for lo in range(0, len(ids), 1000):
                    out_ids, out_text = [], []
                    for row in rows[lo : lo + 1000]:
                        order = np.frombuffer(row.as_buffer(), np.uint32).tolist()
                        out_ids.append(b"".join(map(packed.__getitem__, order)))
                        out_text.append(b"".join(map(plain.__getitem__, order)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 1000], pa.int64()), pa.array(out_ids, pa.binary()), pa.array(out_text, pa.binary())], ["doc_id", "token_ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids (binary, little-endian unsigned 32-bit), decoded (binary) per row of ``docs(doc_id, text)``."""
    pairs, tokens, pieces = _tables(path)
    new = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_rows(path, pattern)), "afresh boolean, words array<string>, ranks array<array<int>>, ids array<long>, rows array<binary>")
    # each literal stands in the plan once
    maps = F.struct(F.from_json(F.lit(pairs), "array<string>").alias("pairs"), F.from_json(F.lit(tokens), "array<string>").alias("tokens"))
    new = new.withColumn("tokens", let(maps, lambda m: F.zip_with("words", "ranks", lambda w, r: encode_word(w, r, m["pairs"], m["tokens"]))))
    new = new.withColumn("decoded", let(F.from_json(F.lit(pieces), "array<string>"), lambda table: F.transform("tokens", lambda w: decode_word(w, table))))
    return new.select("afresh", "ids", "rows", "tokens", "decoded").mapInArrow(tidy(_texts(path)), "doc_id long, token_ids binary, decoded binary")


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns per document."""
    out = encode(docs, path, pattern)
    return out.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def reference_digest(text: str | None, path: str, pattern: str) -> tuple[int, str, str]:
    """The same digest of one text by the tokenizer's own library, for tests."""
    import tiktoken

    ranks = {p: i for i, p in enumerate(_vocabulary(path)) if p}
    ids = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")
    packed = np.asarray(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
