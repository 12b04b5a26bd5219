"""Hard negatives, the conversation trie and the license scan against brute force and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hindsight.llm import licenses, negatives, prefix_trie

VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn int, role string, text string"


def brute_negatives(rows):
    sound = [r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[1])]
    sound = [(i, np.floor(256 * np.array(v, float)).astype(np.int64), (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in sound]
    out = set()
    for a, v, k in sound:
        if a % 50 == 0:
            others = sorted((-int(v @ w), i, m) for i, w, m in sound if i != a and len(w) == len(v))
            for p, i, m in [o for o in others if o[2] == k][:5]:
                hard = [o for o in others if o[2] != k and 50 * -p <= 100 * -o[0] <= 95 * -p][:3]
                out |= {(a, i, rank, o[1], -p, -o[0]) for rank, o in enumerate(hard, 1)}
    return out


@pytest.mark.parametrize("leaf", [40, 2048])
def test_hard_negatives(spark, monkeypatch, leaf):
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "FAN_LEVELS", 2)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 0.3
    x = centres[rng.integers(0, 6, 500)] + rng.normal(size=(500, 8)) * 0.1
    x[100:260] = x[7]  # a third are copies of one row
    label = rng.integers(0, 4, 500)
    label[100:220] = 2
    rows = [(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    rows += [(600, None, 1), (601, [0.1] * 7 + [None], 1), (602, [float("nan")] * 8, 1), (603, [0.2] * 8, None), (None, [0.2] * 8, 1)]
    rows += [(650, [0.5, 0.5], 1), (651, [0.4, 0.5], 0), (652, [0.3, 0.5], 3), (700, [], 1), (750, [0.1] * 8, 99)]
    frame = spark.createDataFrame(rows + rows[150:200], VECTORS).selectExpr("*", "1 AS tree", "2 AS node", "'x' AS pid", "3 AS rows")
    got = [tuple(r) for r in negatives.hard_negatives(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)
    assert {a for a, *_ in got} >= {0, 150, 650}


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [0.1], 1), (2, [0.1], 1)], VECTORS)).count() == 0


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(re.findall(r"[^ \t-\r]+", p[-1][1])) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [2, 4096])
def test_prefix_trie(spark, monkeypatch, bucket):
    monkeypatch.setattr(prefix_trie, "BUCKET_TURNS", bucket)
    monkeypatch.setattr(prefix_trie, "HOT_ONE_IN", 20)
    dice = random.Random(2)
    rows = []
    for c in [*range(0, 60), 400, 407, 999_983]:
        for t in range(dice.choice([1, 2, 3, 5, 9, 21])):
            rows.append((c, t, dice.choice(["user", "assistant"]) if t else "user", "a very common opening" if t == 0 and c % 3 else f"word {dice.randrange(2)} é😀\x85x"))
    rows += [(7, None, None, None), (8, None, "user", ""), (70, 1, None, "only"), (80, 3, "user", "x " * 5000), (None, 0, "user", "nobody's")]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS c", "2 AS d", "3 AS name", "4 AS rep", "5 AS words", "6 AS i")
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame).collect()]
    assert sorted(got, key=repr) == brute_trie(rows)
    assert sum(1 for r in got if r[1] == 0) == 1


def test_trie_of_nothing_and_of_ties(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    tied = [(4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    one, two = (sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr) for rows in (tied, tied[::-1]))
    assert one == two and max(r[1] for r in one) + zlib.crc32(b"4") % 4 == 3


def test_digests_across_batches():
    rows = [(1, 1, 5), (1, 1, 6), (1, 2, 7), (2, 1, 5), (2, 1, 10)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 1], strict=True)], ["d", "name", "c"]) for i in range(5)]
    got = {(r["d"], r["name"]): r["ends_sha256"] for b in prefix_trie._digests(iter(batches)) for r in b.to_pylist()}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in {(1, 1): b"5,6", (1, 2): b"7", (2, 1): b"5,10"}.items()}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_licenses(text, templates, threshold):
    words = brute_words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    lines = [brute_words(x) for x in (text or "").split("\n")]
    blocks = [x for x in lines if x]
    for i, x in enumerate(lines):
        if x and (i == 0 or not lines[i - 1]):
            end = next((j for j in range(i, len(lines)) if not lines[j]), len(lines))
            blocks.append([w for y in lines[i:end] for w in y])
    best, score = set(), 0.0
    for block in blocks:
        met = []
        for label, t in templates:
            t = set(brute_words(t))
            share = len(t & set(block)) / len(t)
            if share >= threshold - 1e-9:
                met.append((-share, -len(t), label))
        if met:
            best.add(min(met)[2])
            score = max(score, -min(met)[0])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | best)), 1.0 if places else score


def test_license_scan(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(120).collect()]
    texts += [None, "", " \n\n ", "cc by cc by cc by", "CC-BY\nGENERAL (public) license", "all rights\nreserved", "éall rights reserved", "x" * 300_000, "all rights reserved " * 3000]
    texts += ["Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files\n\nother", "Released under the Apache License", "MIT license the under released"]
    texts += [t for _, t in licenses.TEMPLATES] + ["\n".join(t for _, t in licenses.TEMPLATES)]
    frame = spark.createDataFrame([*enumerate(texts), (None, "cc by"), (3, texts[3])], "doc_id long, text string").selectExpr("*", "1 AS met", "2 AS n_words", "3 AS phrases")
    got = collections.defaultdict(list)
    for r in licenses.license_digest(frame).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert len(got[3]) == 2 and len(got[None]) == 1 and set(got) == {None, *range(len(texts))}
    for i, text in enumerate(texts):
        assert set(got[i]) == {brute_licenses(text, licenses.TEMPLATES, licenses.THRESHOLD)}, text
    assert licenses.license_digest(frame.limit(0)).count() == 0


def test_license_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK_WORDS", 12)  # several passes
    dice = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)]
    templates = [(f"t{i}", " ".join(dice.sample(vocabulary, dice.randrange(1, 9)))) for i in range(30)] + [("none", " .,")]
    texts = ["\n".join(" ".join(dice.choices(vocabulary, k=dice.randrange(0, 12))) for _ in range(dice.randrange(1, 6))) for _ in range(60)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for threshold in (0.6, 1.0):
        for r in licenses.scan_licenses(frame, templates, threshold).collect():
            want = set()
            blocks = list(licenses._blocks(texts[r.doc_id]))
            for place, block in enumerate(blocks):
                for label, t in templates[:-1]:
                    t = set(t.encode().split())
                    if len(t & set(block)) >= threshold * len(t) - 1e-9:
                        want.add((place, len(t), label, len(t & set(block)) / len(t)))
            assert {tuple(m) for m in r.met} == want


def test_places_are_counted_once_over():
    assert licenses._places(licenses.words_of("all rights reserved " * 40_000)) == ([3 * i for i in range(40_000)], {"reserved"})
