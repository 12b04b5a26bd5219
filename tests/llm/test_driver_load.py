"""What the driver is asked for: joins of small tables and passes, each of which costs it memory."""

import random

from hindsight.llm import common, mixing


def written_by(monkeypatch, module):
    """Label and number of joins in the plan of every table the module writes from now on."""
    seen, write = [], module.materialise

    def record(df, label):
        seen.append((label, df._jdf.queryExecution().analyzed().toString().count("Join ")))
        return write(df, label)

    monkeypatch.setattr(module, "materialise", record)
    return seen


def test_a_step_of_the_mix_joins_once(spark, monkeypatch):
    rows = [(i, f"s{i % 4}" if i % 5 else None, "w " * (i % 17)) for i in range(400)] + [(1000, "no words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    seen = written_by(monkeypatch, mixing)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert len([x for x in seen if x[0] == "mixing-dual"]) > 2
    assert len([x for x in seen if x[0] == "mixing-plan"]) == mixing.LEVELS + 2
    assert max(n for _, n in seen) == 1, seen
    assert [(r["target"], r["rate"], r["copies"]) for r in out if r["source"] == "no words"] == [(0.0, 0.0, 0)]


def test_texts_are_not_shuffled_to_be_mixed(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 9)) for i in range(90)], "doc_id long, source string, text string")
    plan = mixing.repeat_documents(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_links_that_are_stars_need_no_pass(spark, monkeypatch):
    seen = written_by(monkeypatch, common)
    links = spark.createDataFrame([(1, 5), (7, 1), (2, 9), (9, 2), (3, 3), (None, 4)], "a long, b long")
    assert sorted(map(tuple, common.connected_components(links).collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert len(seen) == 1


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    for n, m in ((2, 1), (60, 40), (60, 90), (200, 150)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(30)]
        least = {x: x for p in pairs if p[0] != p[1] for x in p}
        while True:
            before = dict(least)
            for a, b in pairs:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
            if before == least:
                break
        found = common.connected_components(spark.createDataFrame(pairs, "a long, b long"))
        assert sorted(map(tuple, found.collect())) == sorted(least.items())
    empty = spark.createDataFrame([], "a long, b long")
    assert common.connected_components(empty).collect() == []
