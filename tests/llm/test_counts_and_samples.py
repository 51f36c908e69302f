from collections import Counter

import numpy as np
import pytest

from tidewire.llm import reservoir
from tidewire.llm import term_counts as tc

SCHEMA = "dataset string, row_id bigint, col int, value double, n_records string, grp int"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def counts(spark, rows, heavy=2):
    e = entries(spark, rows)
    plain, none = tc.term_counts(e, "dataset", "row_id", "col", "value", ["a", "b"], most_heavy=heavy)
    by_place, totals = tc.term_counts(e, "dataset", "row_id", "col", "value", ["a", "b"], e.select("dataset", "row_id"), most_heavy=heavy)
    got = plain.collect()
    assert sorted(by_place.collect()) == sorted(got) and none == {}
    assert totals == {d: len({r for x, r, *_ in rows if x == d and r is not None}) for d in "ab" if any(x == d and r is not None for x, r, *_ in rows)}
    assert len(got) == len({(r["dataset"], r["col"]) for r in got})
    return {(r["dataset"], r["col"]): (r["n_entries"], r["n_records"]) for r in got}


def brute(rows):
    n, rec = Counter(), {}
    for d, r, c, v in rows:
        if d in ("a", "b") and r is not None and c is not None and v:
            n[d, c] += 1
            rec.setdefault((d, c), set()).add(r)
    return {k: (n[k], len(rec[k])) for k in n}


def test_nulls_zeros_repeats_and_names(spark):
    rows = [("a", 1, 5, 1.0), ("a", 1, 5, 1.0), ("a", 2, 5, 0.0), ("a", 2, 5, None), ("a", None, 5, 1.0), ("a", 3, None, 1.0), (None, 3, 5, 1.0), ("c", 3, 5, 1.0), ("b", 1, 5, 2.0), ("b", 1, 6, -1.0), ("a", 1, 5, 0.0)]
    assert counts(spark, rows) == brute(rows) == {("a", 5): (2, 1), ("b", 5): (1, 1), ("b", 6): (1, 1)}
    assert counts(spark, []) == {}


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_skew(spark, heavy):
    rng = np.random.default_rng(0)
    # A third of the entries are one column, a third one record, and one entry is sent often.
    rows = [("a", int(i), 0, 1.0) for i in range(300)] + [("a", 7, int(i), 1.0) for i in range(300)] + [("a", 9, 9, 1.0)] * 200
    rows += [("b", int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 50, 300), rng.zipf(1.5, 300) % 40, rng.integers(0, 2, 300))]
    assert counts(spark, rows, heavy) == brute(rows)


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_records_in_several_places(spark, monkeypatch, bits):
    # Runs of whole records, some sent again near or far, some cut by batches; the small filter is full.
    monkeypatch.setattr(tc, "FILTER_BITS", bits)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    rng = np.random.default_rng(4)
    runs = [[("a", r, int(c), 1.0) for c in rng.integers(0, 60, rng.integers(1, 9))] for r in range(200)]
    runs += [runs[i] for i in rng.integers(0, 200, 40)] + [runs[5][:1] * 3, [("a", 7, c, 1.0) for c in range(100)]]
    rows = [e for i in rng.permutation(len(runs)) for e in runs[i]]
    try:
        assert counts(spark, rows, 16) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks(spark):
    rows = [("a", r, c, 1.0) for r in range(10) for c in ([0] if r < 2 else []) + ([1] if r < 3 else []) + ([2] if r < 4 else [])]
    c, _ = tc.term_counts(entries(spark, rows), "dataset", "row_id", "col", "value", ["a"])
    totals = spark.createDataFrame([("a", 10)], "dataset string, n_all bigint")
    assert {r["col"]: r["mark"] for r in tc.marked(c, totals, "dataset").collect()} == {0: "rare", 1: None, 2: "common"}


def test_reservoir_is_uniform():
    hits = np.zeros(40)
    for seed in range(3000):
        pool = reservoir.Reservoir(8, np.random.default_rng(seed))
        items = [None] * 8
        for begin in (0, 3, 20):  # pieces of uneven size
            n = {0: 3, 3: 17, 20: 20}[begin]
            for slot, at in pool.chosen(n):
                items[slot] = begin + at
        assert len(set(items)) == 8 and pool.seen == 40
        hits[items] += 1
    # 600 expected each; the standard deviation is about 22.
    assert np.abs(hits - 600).max() < 5 * 22


def test_merge_is_hypergeometric():
    drawn = np.array([reservoir.allocate([10, 30, 60], 20, [s]) for s in range(4000)])
    assert (drawn.sum(axis=1) == 20).all()
    np.testing.assert_allclose(drawn.mean(axis=0), [2, 6, 12], atol=0.12)
    variance = 20 * 0.1 * 0.9 * 80 / 99
    assert drawn[:, 0].var() == pytest.approx(variance, rel=0.1)
    # The same draw at small and at huge populations, against numpy's and the normal limit.
    ours = np.array([reservoir.hypergeometric(np.random.default_rng(s), 40, 60, 30) for s in range(4000)])
    theirs = np.random.default_rng(0).hypergeometric(40, 60, 30, 4000)
    assert abs(ours.mean() - 12) < 0.15 and ours.var() == pytest.approx(theirs.var(), rel=0.1)
    huge = np.array([reservoir.hypergeometric(np.random.default_rng(s), 10**12, 3 * 10**12, 40_000) for s in range(300)])
    assert huge.mean() == pytest.approx(10_000, abs=20) and huge.std() == pytest.approx(86.6, rel=0.15)
    assert reservoir.hypergeometric(np.random.default_rng(0), 5, 0, 3) == 3 and reservoir.hypergeometric(np.random.default_rng(0), 0, 5, 3) == 0
    large = reservoir.allocate([2_000_000_000, 1_000_000_000], 3000, [1])
    assert sum(large) == 3000 and abs(large[0] - 2000) < 150
    assert reservoir.allocate([3, 4], 100, [0]) == [3, 4]


PLAN = "plan_id int, split string, k int"
REC = "row_id bigint, split string, piece int, cols array<int>, k string"


def draw(spark, rows, plans, seed=1):
    df = spark.createDataFrame([(*r, "clash") for r in rows], REC)
    return reservoir.sample(df, spark.createDataFrame(plans, PLAN), "row_id", ["piece"], ["cols"], ["split"], seed=seed).collect()


def test_sample_rules(spark):
    rows = [(i, "trn" if i % 2 else "tst", 0, [i]) for i in range(30)] + [(5, "trn", 3, [5])] * 20 + [(None, "trn", 0, [1]), (99, None, None, None)]
    got = draw(spark, rows, [(1, "trn", 4), (2, None, 1000), (3, "val", 5), (4, "tst", None), (5, "tst", -1), (None, "trn", 2)])
    by = Counter(r["plan_id"] for r in got)
    assert by == {1: 4, 2: 31, None: 2}
    assert all(r["split"] == "trn" for r in got if r["plan_id"] == 1)
    assert len({(r["plan_id"], r["row_id"]) for r in got}) == len(got)
    assert next(r for r in got if r["row_id"] == 99)["cols"] is None
    assert draw(spark, [], [(1, None, 3)]) == [] and draw(spark, rows, []) == []


def test_sample_gives_every_record_one_chance(spark):
    # Record 0 makes up a third of the rows; its chance must stay that of one.
    rows = [(0, "trn", p, [0]) for p in range(15)] + [(i, "trn", i % 3, [i]) for i in range(1, 31)]
    plans = [(p, None, 6) for p in range(400)]
    hits = Counter(r["row_id"] for r in draw(spark, rows, plans))
    expected = 400 * 6 / 31
    assert sum(hits.values()) == 2400
    assert max(abs(hits[i] - expected) for i in range(31)) < 5 * np.sqrt(expected)
