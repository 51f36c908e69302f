import io
import tarfile

import numpy as np
import pytest

from tidewire.data import from_lists
from tidewire.functions import kernels as K
from tidewire.operators import hawkes, simulate
from tidewire.sources import arrays, svm_text
from tidewire.sources.svm_grammar import number, parse_record, parse_text
from tidewire.streaming.online import late_counts, late_events, online_intensities, windowed_counts


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("1 3:0.5 7:2 # n=2", None), ("-1.0", None), ("+1e0 1:.5\r", None), ("0 1:3. 2:1E-3#x", None), ("1\t3:1", None),
        ("2 1:1", "label"), ("x", "label"), ("nan 1:1", "label"), ("1e999", "label"), ("1 3", "pair"), ("1 :3", "pair"), ("1 3:", "pair"), ("1 3:4:5", "pair"),
        ("1 x:1", "index"), ("1 -3:1", "index"), ("1 3:1 3:1", "index"), ("1 3:1 2:1", "index"), ("1 0:1", "index"), ("1 11:1", "index"), ("1 ３:1", "index"),
        ("1 3:x", "value"), ("1 3:inf", "value"), ("1 3:1_0", "value"), ("1 3:１", "value"), ("1 3:1e999", "value"), ('1 3:1 # "a', "quote"), ("1 3:1 # n=2", "count"), ("1 3:1 #n=1", None), ("1 3:1 #xn=2", None),
        ("1 x:1 3", "pair"), ("9 3", "label"), ('1 3:x # "', "value"), ("1 3:1\r\r", "value"), ("1\xa03:1", "label"), ("1 " + "9" * 5000 + ":1", "index"), ("1 3:1 # n=" + "9" * 5000, "count"),
    ],
)
def test_reasons(line, reason):
    assert parse_record(line, 1, 10).reason == reason


def test_places_and_blanks():
    assert parse_record("1 3:1 5:x", 1, 10).errors == [(3, 8, "x")]
    assert parse_record(" \t", 1, 10).empty and parse_record("# only", 1, 10).comment == " only"
    assert number("+.5e1") == 5 and number(".") is None and number("") is None


def test_text_recovers():
    text = '1 1:1 # "open\n0 2:2\n1 3:3 # "two\nlines" n=1\n-1 4:4 # "never\nnot a record\n0 5:5'
    out = [(r.line, r.label, r.reason) for r in parse_text(text)]
    assert out[0] == (1, 1.0, "quote") and out[1] == (2, 0.0, None) and out[2][:2] == (3, 1.0) and out[2][2] is None
    assert (5, -1.0, "quote") in out and out[-1] == (7, 0.0, None)


def test_parse_lines(spark):
    rows = [(1, "f", "1 3:1", "x"), (2, "g", "1 30:1", "x"), (3, None, "1 30:1", None), (4, "f", None, "x"), (5, "f", "", "x"), (6, "f", "# c", "x"), (7, "f", "1 30:1", "x"), (8, "f", "1 3:1", "x"), (9, "f", "1 " + " ".join(f"{i}:1" for i in range(1, 2001)), "x")]
    lines = spark.createDataFrame(rows, "line_id bigint, file_name string, raw string, reason string")
    files = spark.createDataFrame([("f", 1, 10)], "file_name string, first_index int, n_features int")
    got = {r["line_id"]: r["reason"] for r in svm_text.parse_lines(lines, files).collect()}
    assert got == {1: None, 2: None, 3: None, 7: "index", 8: None, 9: "index"}
    assert svm_text.parse_lines(lines.limit(0), files).count() == 0
    assert svm_text.parse_lines(lines).where("reason is null").count() == 6


def test_whole_texts(spark, tmp_path):
    # Records with open, closed and running quotes, cut by bytes anywhere.
    rng = np.random.default_rng(0)
    kinds = ["1 1:0.5", "-1 2:1 3:x", '0 4:1 # "a" b', '1 5:1 # "open', '1 6:2 # "one\nmore: text\n"', "", "# only", "word", '1 1:1 # "so\n1 2:2', "1 7:1\r"]
    text = "\n".join(rng.choice(kinds, 400)) + "\n"
    want = [(r.line, r.label if not r.errors else None, r.reason) for r in parse_text(text, 1, 9) if not r.empty]
    (tmp_path / "t.svm").write_text(text, newline="")
    key = lambda r: (r["line_no"], r["label"], r["reason"])
    for size in ("400b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = svm_text.read_svm_text(spark, str(tmp_path / "t.svm"), 1, 9)
        assert sorted(map(key, got.collect())) == sorted(want, key=lambda x: x[0])
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    texts = spark.createDataFrame([("f", text, 1), ("g", None, 1), ("h", "", 1)], "file_name string, text string, line_no int")
    files = spark.createDataFrame([("f", 1, 9)], "file_name string, first_index int, n_features int")
    for piece in (50, 1 << 22):
        assert sorted(map(key, svm_text.parse_texts(texts, files, piece=piece).collect())) == sorted(want, key=lambda x: x[0])


def test_files(spark, tmp_path):
    (tmp_path / "a.svm").write_text('1 1:0.5 3:2 # "c"\n\n# none\n-1 2:1 word\n')
    got = svm_text.read_svmlight(spark, str(tmp_path / "a.svm")).orderBy("label").collect()
    assert [tuple(r) for r in got] == [(-1.0, [1], [1.0], 3), (1.0, [0, 2], [0.5, 2.0], 3)]
    assert svm_text.read_svm_text(spark, str(tmp_path / "a.svm")).count() == 2
    svm_text.write_svmlight(svm_text.read_svmlight(spark, str(tmp_path / "a.svm")), str(tmp_path / "out"))
    assert svm_text.read_svmlight(spark, str(tmp_path / "out")).orderBy("label").first()["idx"] == [1]
    np.savez(tmp_path / "e.npz", day1=np.array([[0.1, 0.2], [0.3, np.nan]]), day2=np.array([1.0]))
    ev = arrays.read_npz_events(spark, str(tmp_path / "e.npz"))
    assert sorted((r["key"], r["node"], r["t"]) for r in ev.collect()) == [("day1", 0, 0.1), ("day1", 0, 0.2), ("day1", 1, 0.3), ("day2", 0, 1.0)]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        for name in ("Day0.svm", "readme"):
            info = tarfile.TarInfo(name)
            info.size = 6
            tar.addfile(info, io.BytesIO(b"1 1:1\n"))
    lines = arrays.read_tar_lines(spark, str(tmp_path / "t.tar.gz"))
    assert [tuple(r) for r in lines.collect()] == [("Day0.svm", 1, "1 1:1")]
    assert len(arrays.checksums(spark, str(tmp_path / "a.svm")).first()["sha256"]) == 64
    arrays.write_matrix(spark, np.eye(2), str(tmp_path / "m"))
    assert arrays.read_matrix(spark, str(tmp_path / "m")).count() == 2
    c = arrays.Catalog({"a": {"format": "svmlight", "path": str(tmp_path / "a.svm")}})
    assert c.table(spark).count() == 1 and c.load(spark, "a").count() == 2


def test_kernels(spark):
    from pyspark.sql import functions as F

    f = K.TimeFunction(([0, 1, 2], [0, 2, 0]))
    assert f.values(0.5) == 1 and f.values(-1) == 0 and f.values(3) == 0 and f.primitive(2) == pytest.approx(2)
    x = np.array([-1, 0, 0.3, 1, 1.5, 2, 2.5, 4.7])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    made = [K.TimeFunction(([0.2, 1, 2], [1.0, 2, 5]), b, m, border_value=7.0) for b in (K.ZERO, K.CONSTANT, K.CONTINUE, K.CYCLIC) for m in (K.LINEAR, K.CONST_LEFT, K.CONST_RIGHT)]
    cols = [g.column(F.col("x")).alias(f"c{i}") for i, g in enumerate(made)]
    got = np.array([list(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()], float).T
    for a, g in zip(got, made):
        np.testing.assert_allclose(a, g.values(x), atol=1e-12)
    kernels = [K.Exponential(0.5, 2), K.ExponentialSum((0.2, 0.3), (1.0, 2.0)), K.PowerLaw(0.1, 0.5, 1.5, 10), K.TimeFunctionKernel(t=[0, 1, 2], y=[1.0, 0.5, 0]), K.Zero()]
    for k in kernels:
        a = np.array([r[0] for r in df.orderBy("i").select(k.value(F.col("x"))).collect()], float)
        np.testing.assert_allclose(a, k.values(x), atol=1e-12)
        grid = np.linspace(0, 1.7, 200001)
        assert k.primitive(1.7) == pytest.approx(np.trapezoid(k.values(grid), grid), abs=2e-2)
        assert k.future_bound(0.4) >= k.values(np.linspace(0.4, 3, 100)).max() - 1e-12
    assert kernels[0].norm() == 0.5 and kernels[1].norm() == pytest.approx(0.5) and str(kernels[0])
    np.random.seed(23982)
    np.random.rand(3)
    a = np.random.rand(3, 3) / 2
    a[0, 0] = a[2, 2] = 0
    assert K.spectral_radius(a) == pytest.approx(0.6645446549735008)
    v = df.select(K.piecewise_baseline(F.col("x"), [1.0, 2.0, 3.0], 1.5).alias("v"), "i").orderBy("i").collect()
    assert v[3]["v"] == 3 and K.piecewise_baseline_primitive(2.0, [1.0, 2.0, 3.0], 1.5) == pytest.approx(3 + 0.5)


def test_simulators(spark):
    k = simulate.exponential_kernels([[0.3, 0.1], [0.2, 0.2]], 2.0, radius=0.5)
    a = simulate.hawkes(spark, k, [0.5, 0.3], n=20, end_time=100, seed=3)
    b = simulate.hawkes(spark, k, [0.5, 0.3], n=20, end_time=100, seed=3)
    assert a.events.exceptAll(b.events).count() == 0 and a.checked()
    rate = np.array(a.node_counts) / a.total_time
    np.testing.assert_allclose(rate, K.stationary_intensity(K.norms(k), [0.5, 0.3]), rtol=0.15)
    with pytest.raises(ValueError):
        simulate.hawkes(spark, simulate.exponential_kernels([[2.0]], 1.0), [0.5], end_time=10)
    mixed = [[K.PowerLaw(0.05, 0.5, 1.5, 20), K.TimeFunctionKernel(t=[0, 1, 2], y=[0.1, 0.05, 0])], [K.Zero(), K.Exponential(0.2, 1)]]
    m = simulate.hawkes(spark, mixed, [K.TimeFunction(([0, 5, 10], [0.2, 0.6, 0.2]), K.CYCLIC), [0.2, 0.4]], period=3.0, n=2, max_jumps=30)
    assert m.n_jumps == 60
    more = simulate.hawkes(spark, mixed, [0.2, 0.4], n=2, max_jumps=10, history=m)
    assert more.n_jumps == 80
    p = simulate.poisson(spark, [1.0, 3.0], n=10, end_time=50)
    np.testing.assert_allclose(np.array(p.node_counts) / 500, [1, 3], rtol=0.15)
    assert simulate.poisson(spark, [1.0], n=2, max_jumps=5).n_jumps == 10
    q = simulate.inhomogeneous(spark, [K.TimeFunction(([0, 10], [0.0, 2.0]))], 10.0, n=20)
    assert q.n_jumps == pytest.approx(200, rel=0.25)
    for kind in ("linear", "logistic", "poisson"):
        assert simulate.glm_rows(spark, [0.5, -0.2], kind=kind, n=50).where("label is not null").count() == 50
    assert simulate.cox_rows(spark, [0.5, -0.2], n=60).where("time > 0").count() == 60
    assert simulate.cox_rows_with_cuts(spark, [[0.0]], [[0.0, 1.0]], n=30).count() == 30
    f, y, c = simulate.case_series(spark, 20, 10, [1, 2], [[0.5, 0.1], [0, 0.2, 0.3]])
    assert y.join(c, "case_id").where("interval < censoring").count() == 20 and f.columns[0] == "case_id"
    assert simulate.risk_curve(10, "early", 3.0).max() == pytest.approx(3)
    assert simulate.sparse_exponential(4, 2).tolist()[2:] == [0, 0] and (simulate.sparse_normal(9, 3) != 0).sum() == 3
    for kind in ("uniform", "gaussian", "exponential", "integer", "poisson"):
        assert simulate.random_numbers(spark, kind, 20).count() == 20
    assert simulate.random_numbers(spark, "discrete", 100, chances=[1, 1]).agg({"value": "max"}).first()[0] == 1


def test_stream_equals_batch(spark, tmp_path):
    p = hawkes.ExpParameters([0.4, 0.2], [[0.3, 0.2], [0.1, 0.4]], 0.7)
    rng = np.random.default_rng(0)
    data = from_lists(spark, [[np.sort(rng.uniform(0, 20, 15)).tolist() for _ in range(2)] for _ in range(3)], 20.0)
    for i in range(2):
        data.events.where(f"t >= {10 * i} and t < {10 * i + 10}").select("r", "node", "t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("r bigint, node int, t double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = online_intensities(stream, p).writeStream.format("memory").queryName("lam").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["r"], r["node"], r["t"]): r["intensity"] for r in spark.table("lam").collect()}
    for r in hawkes.intensities(data, p).collect():
        assert got[r["r"], r["node"], r["t"]] == pytest.approx(r["intensity"], rel=1e-10)
    assert late_events(spark.table("lam")).count() == 0
    # The same events in any order within the delay, and some far too late.
    rows = sorted([(r["r"], r["node"], r["t"]) for r in data.events.collect()], key=lambda x: x[2] + rng.uniform(0, 4))
    for i, part in enumerate([rows[:40], rows[40:], [(r, 0, 1e-9) for r in range(3)] + [(r, 0, 100.0) for r in range(3)]]):
        spark.createDataFrame(part, "r bigint, node int, t double").coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
    stream = spark.readStream.schema("r bigint, node int, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "mixed"))
    q = online_intensities(stream, p, delay=4.0).writeStream.format("memory").queryName("mixed").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    placed = {(r["r"], r["node"], r["t"]): r["intensity"] for r in spark.table("mixed").where("not late").collect()}
    assert placed == {k: pytest.approx(v, rel=1e-10) for k, v in got.items()}
    assert sorted(r["t"] for r in late_events(spark.table("mixed")).collect()) == [1e-9] * 3
    assert {r["node"]: r["late"] for r in late_counts(spark.table("mixed")).collect()}[0] == 3
    w = windowed_counts(spark.createDataFrame([(1, 0), (2, 0)], "s int, node int").selectExpr("timestamp_seconds(s) as s", "node"), "s", "node", "10 seconds", "1 minute")
    assert w.first()["n"] == 2
