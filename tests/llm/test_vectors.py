import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import overlap
from tidewire.llm import permutation_index as pi

BITS = overlap.Spec(40, 3, 0.0, 8, 6)
REALS = overlap.Spec(12, 1, 0.01, 6, 6)
SCHEMA = "row_id bigint, split string, source string, label double, features array<double>, rep string, held string, h int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def differ(a, b, tol):
    return sum(x is None or y is None or x != x or y != y or abs(x - y) > tol for x, y in zip(a, b))


def brute(rows, spec, cls=lambda r: 0):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "trn" and b[1] in ("val", "tst") and all(r[4] is not None and len(r[4]) == spec.length and cls(r) is not None for r in (a, b)):
                if cls(a) == cls(b) and differ(a[4], b[4], spec.tol) <= spec.max_diff:
                    out.add((a[0], b[0]))
    return out


def found(spark, rows, spec, **options):
    pairs, members = overlap.overlaps(frame(spark, rows), spec, **options)
    got = [(r["trn"], r["other"]) for r in overlap.expanded(pairs, members).collect()]
    assert len(got) == len(set(got))
    return set(got), pairs, members


def planted(rng, spec, n, real):
    base = [rng.uniform(-1, 1, spec.length) if real else (rng.uniform(size=spec.length) < 0.3) * 1.0 for _ in range(n)]
    rows = []
    for i in range(20 * n):
        x = base[rng.integers(n)].copy()
        for j in rng.permutation(spec.length)[: rng.integers(0, spec.max_diff + 3)]:
            x[j] = rng.uniform(-1, 1) if real else 1 - x[j]
        if real:
            x = x + rng.uniform(-0.0055, 0.0055, spec.length) * (rng.uniform() < 0.5) + rng.choice([-0.0099, 0, 0.0099], spec.length) * (rng.uniform() < 0.2)
        x = [float(v) for v in x]
        if rng.uniform() < 0.1:
            x[int(rng.integers(spec.length))] = None if rng.uniform() < 0.7 else float("nan")
        rows.append((i, str(rng.choice(["trn", "val", "tst"])), "s", float(rng.choice([-1, 1])), x))
    return rows


@pytest.mark.parametrize(("spec", "real"), [(BITS, False), (REALS, True)])
@pytest.mark.parametrize("hot", [1 << 14, 0])
def test_no_pair_is_lost(spark, spec, real, hot):
    rows = planted(np.random.default_rng(5 + real), spec, 12, real)
    want = brute(rows, spec)
    assert len(want) > 20
    assert found(spark, rows, spec, hot=hot)[0] == want


def test_seeds_are_bounded_and_shared():
    # Every entry of the first record lies on an edge of some grid.
    edges = [0.0, 0.096 / 4, 0.096 / 2, 3 * 0.096 / 4]
    spec = overlap.Spec(22, 1, 0.0015, 12, 10)
    worst = np.array([0.048 - edges[i % 4] for i in range(22)])
    rng = np.random.default_rng(0)
    near = worst + rng.uniform(-0.0014, 0.0014, (200, 22))
    near[np.arange(200), rng.integers(0, 22, 200)] += 1  # one entry differs
    one, all_ = overlap._seed_rows(worst[None], spec, False), overlap._seed_rows(near, spec, True)
    assert len(one[0]) <= 32 * 22 and np.bincount(all_[0]).max() <= 4 * 22
    mine = set(one[3])
    assert all(mine & set(all_[3][all_[0] == i]) for i in range(200))


def test_walk_counts_from_any_beginning():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, (50, 40)) * 1.0
    b = np.where(rng.uniform(size=a.shape) < 0.07, 1 - a, a)
    n, got = (a != b).sum(1), overlap._walk(a, b, rng.integers(0, 40, 50), BITS, step=7)
    assert (np.where(n <= 3, n, 4) == np.minimum(got, 4)).all()


def test_classes_copies_and_odd_rows(spark):
    x = [0.0] * 12
    y = [0.0] * 11 + [None]
    two = [None, None] + [0.0] * 10
    rows = [(i, "trn", None, 1.0, x) for i in range(8)] + [(10 + i, "tst", "s", -1.0 if i % 2 else 1.0, x) for i in range(4)]
    rows += [(20, "val", "s", 1.0, y), (21, "val", "s", None, x), (22, None, "s", 1.0, x), (23, "val", "s", 1.0, None), (24, "val", "s", 1.0, x[:5]), (25, "val", "s", 1.0, two), (26, "trn", "s", 1.0, []), (27, "val", None, 1.0, [-0.0] * 12)]
    df = frame(spark, rows)
    pairs, members = overlap.overlaps(df.withColumn("c", (df["label"] > 0).cast("tinyint")), REALS, cls="c")
    got = {(r["trn"], r["other"]) for r in overlap.expanded(pairs, members).collect()}
    assert got == brute(rows, REALS, lambda r: None if r[3] is None else r[3] > 0)
    said = {(r["split"], r["source"]): r for r in overlap.report(df, pairs, members).collect()}
    assert said["tst", "s"]["n_overlapping"] == 2 and said["tst", "s"]["n_exact"] == 2
    assert said["val", None]["n_exact"] == 1
    assert found(spark, [], REALS)[0] == set()
    with pytest.raises(ValueError):
        overlap.Spec(12, 1, 0.01, 8, 6)


def near(spark, rows, k, **options):
    df = spark.createDataFrame([(i, x, 1, 2, 3.0) for i, x in rows], "row_id bigint, features array<double>, pivot int, rank int, dist double")
    return {(r["row_id"], r["rank"]): (r["neighbour"], r["dist"]) for r in pi.neighbours(df, k, length=4, **options).collect()}


def brute_near(rows, k, ask=None, radius=np.inf):
    ok = [(i, np.array(x, float)) for i, x in rows if x is not None and len(x) == 4 and all(v is not None and v == v for v in x)]
    out = {}
    for i, x in ok:
        if ask is None or i in ask:
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in ok if j != i)
            for rank, (v, j) in enumerate([e for e in d if e[0] <= radius][:k], 1):
                out[i, rank] = (j, v)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key in got:
        assert got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], abs=1e-9)


def vectors(rng):
    rows = [(i, [float(v) for v in rng.uniform(size=4)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 4) for i in range(30)] + [(300 + i, rows[i][1]) for i in range(5)] + [(320, [-0.0, 0.0, 0.0, 0.0]), (321, [0.0] * 4)]
    return [*rows, (400, None), (401, [1.0]), (402, [None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [])]


def test_exact_where_lists_are_full(spark):
    rows = vectors(np.random.default_rng(0))
    same(near(spark, rows, 5, post=16, probe=16, share=1.0), brute_near(rows, 5))
    same(near(spark, rows, 5, radius=0.3, share=0.0, least=1), brute_near(rows, 5, radius=0.3))
    ask = {0, 50, 200, 229, 300}
    queries = spark.createDataFrame([(i,) for i in [*ask, 402, 999]], "row_id bigint")
    same(near(spark, rows, 3, queries=queries, post=16, probe=16, share=1.0), brute_near(rows, 3, ask))
    assert near(spark, rows[-5:], 5) == {} and near(spark, rows[:1], 5) == {}


def recall(got, want, k):
    hit = sum(len({got.get((i, r), (None,))[0] for r in range(1, k + 1)} & {want[i, r][0] for r in range(1, k + 1)}) for i in {i for i, _ in want})
    return hit / len(want)


@pytest.mark.parametrize(("long", "block"), [(2048, 16), (60, 2048)])
def test_long_lists_blocks_and_recall(spark, monkeypatch, long, block):
    # Few pivots at first: lists are long, are cut into blocks, or get levels of pivots of their own.
    for name, v in (("BLOCK", block), ("PLACED", 32), ("_PAIRS", 64), ("FEWEST", 3 if long < 2048 else 16), ("LIST_SIZE", 20 if long < 2048 else 1000), ("LONG", long), ("MOST", 4 if long < 2048 else 16)):
        monkeypatch.setattr(pi, name, v)
    rng = np.random.default_rng(1)
    rows = vectors(rng) + [(500 + i, [float(v) for v in 0.3 + rng.normal(size=4) * 0.01]) for i in range(80)]  # and a dense ball
    assert recall(near(spark, rows, 5, post=2, probe=3, least=8), brute_near(rows, 5), 5) >= 0.9
    same(near(spark, rows, 5, radius=0.05), brute_near(rows, 5, radius=0.05))


def test_footrule_bound_keeps_what_is_near():
    rng = np.random.default_rng(2)
    p, x = rng.uniform(size=(40, 4)), rng.uniform(size=(300, 4))
    y = x + rng.normal(size=x.shape) * 0.02
    column = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
    args = (np.ones(300, np.int64), pa.array(np.arange(300)), column(x), p, 8, 1)
    q, v = pi._place(*args, 0.05, False), pi._place(*args[:2], column(y), *args[3:], None, False)
    places = lambda b: [{j: i for i, j in enumerate(r)} for r in b.column(2).to_pylist()]
    shared = np.array([sum(8 - max(i, b.get(j, 8)) for j, i in a.items()) for a, b in zip(places(q), places(v))])
    need = q.column(3).to_numpy()
    assert (shared[np.sqrt(((x - y) ** 2).sum(1)) <= 0.05] >= need[np.sqrt(((x - y) ** 2).sum(1)) <= 0.05]).all()
    others = np.array([sum(8 - max(i, b.get(j, 8)) for j, i in a.items()) for a, b in zip(places(q), places(v)[1:])])
    assert (others < need[:-1]).mean() > 0.3  # and it does sort out others


def test_contents_with_a_shared_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidewire.llm import contents

    df = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0]), (4, [2.0])], "row bigint, x array<double>")
    for same in (False, True):
        if same:
            monkeypatch.setattr(contents.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
        reps, members = contents.contents(df, [], "contents")
        assert reps.count() == 2
        assert {r["row"]: r["rep"] for r in members.collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
