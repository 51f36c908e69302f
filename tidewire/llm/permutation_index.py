"""Nearest neighbours of vectors by a permutation index of pivots in inverted files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.contents import contents
from tidewire.session import written

#: Vectors per pivot that the number of pivots aims at, and the bounds of that number per level.
LIST_SIZE, FEWEST, MOST = 256, 16, 1023
#: A list of more vectors gets pivots of its own.
LONG = 2048
#: Levels of pivots; a list's name holds 10 bits per level.
LEVELS = 6
#: Queries, and on the last level vectors, of a list that meet in one task; rows placed in one.
BLOCK, PLACED = 2048, 16384
#: Pairs that numpy handles at once.
_PAIRS = 1 << 21


def pivots_of(reps: DataFrame, count: int) -> np.ndarray:
    """The first level's pivots: a sample of distinct vectors, those of the smallest hashes of
    their keys. Its size is bounded by MOST; every vector is indexed, in the sample or not."""
    n = min(MOST, max(FEWEST, count // LIST_SIZE))
    # Only about four times as many rows as are wanted take part, whatever the number of tasks.
    some = reps if count <= 4 * n else reps.where(F.shiftrightunsigned(F.xxhash64("rep"), 11) < F.lit(int((1 << 53) * 4 * n / count)))
    rows = some.select("rep", "x").orderBy(F.xxhash64("rep"), "rep").limit(n).collect()
    return np.array([r["x"] for r in rows], np.float64)


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


_PLACED = "cell bigint, rep bigint, perm array<smallint>, need int, x array<double>"
_NAMES = ["cell", "rep", "perm", "need", "x"]


def _place(cell: np.ndarray, rep: pa.Array, column: pa.Array, p: np.ndarray, prefix: int, lists: int, radius: float | None, spread: bool) -> pa.RecordBatch:
    """Vectors with the order of their nearest pivots, once per list that they go to: the lists
    nearest ones, and if spread all that a vector within the radius may have as its nearest.

    need bounds the footrule: a vector within the radius of this one sees each pivot at a place
    no later than the count of pivots that are at most two radii farther than it from here.
    """
    x, keep = _vectors(column), min(prefix, len(p))
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0))
    order = np.argsort(d, axis=1, kind="stable")
    near = order[:, :keep]
    go = np.zeros(d.shape, bool)
    go[np.arange(len(x))[:, None], order[:, :lists]] = True
    need = np.zeros(len(x), np.int32)
    if radius is not None:
        # 1e-6 covers rounding.
        if spread:
            go |= d <= d.min(axis=1, keepdims=True) + 2 * radius + 1e-6
        first = np.take_along_axis(d, order[:, : keep + 1], 1)
        late = (first[:, None, :] <= first[:, :keep, None] + 2 * radius + 1e-6).sum(axis=2) - 1
        need = (keep - np.minimum(late, keep)).sum(axis=1).astype(np.int32)  # late is never before the own place
    r, to = np.nonzero(go)
    take = pa.array(r)
    perms = pa.FixedSizeListArray.from_arrays(pa.array(near[r].astype(np.int16).ravel()), keep).cast(pa.list_(pa.int16()))
    return pa.RecordBatch.from_arrays([pa.array(cell[r] << 10 | to), rep.take(take), perms, pa.array(need[r]), column.take(take)], _NAMES)


def _first(reps: DataFrame, pivots, *how) -> DataFrame:
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                # A 1 before the first level's number keeps names of different levels apart.
                yield _place(np.ones(part.num_rows, np.int64), part.column(0), part.column(1), pivots.value, *how)

    return reps.select("rep", "x").mapInArrow(placed, _PLACED)


def _again(rows: DataFrame, own: DataFrame, *how) -> DataFrame:
    """rows of long lists placed among their list's own pivots, some of a list per task."""

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            p = np.array(right["pivots"][0].as_py(), np.float64)
            for b in left.combine_chunks().to_batches(max_chunksize=BLOCK):
                out.append(_place(b.column(0).to_numpy(), b.column(1), b.column(2), p, *how))
        kinds = pa.schema(zip(_NAMES, [pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.int32(), pa.list_(pa.float64())], strict=True))
        return pa.Table.from_batches([b.cast(kinds) for b in out], kinds)

    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / PLACED).cast("int").alias("m"))
    parts = written(sizes.join(own, "cell"), "permutation-parts")  # a table of its own, as both sides below use it
    left = rows.join(parts.select("cell", "m"), "cell").select("cell", "rep", "x", F.pmod(F.xxhash64("rep"), "m").cast("int").alias("part"))
    right = parts.select("cell", "pivots", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"))
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(placed, _PLACED)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _refined(posted: DataFrame, asked: DataFrame, prefix: int, post: int, probe: int, radius: float | None) -> tuple[DataFrame, DataFrame]:
    """Give lists of more than LONG vectors pivots of their own, level by level.

    A list's pivots are a sample of its vectors by the hash of their keys, of bounded size, in
    one row. Nothing is sent to all tasks, so the number of lists may grow with the vectors.
    """
    done: list[tuple[DataFrame, DataFrame]] = []
    for _ in range(1, LEVELS):
        long = written(posted.groupBy("cell").count().where(F.col("count") > LONG), "permutation-long")
        if long.isEmpty():
            break
        wanted = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(F.col("count") / LIST_SIZE)))
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(1), "rep"), 11) / F.lit(float(1 << 53)) < wanted / F.col("count")
        drawn = posted.join(long, "cell").where(chance).groupBy("cell").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("rep").alias("h"), "x"))), 1, MOST).alias("s"))
        own = written(drawn.select("cell", F.col("s.x").alias("pivots")).where(F.size("pivots") > 1), "permutation-pivots")
        done.append((posted.join(own, "cell", "left_anti"), asked.join(own, "cell", "left_anti")))
        deep = [d.join(own, "cell", "left_semi") for d in (posted, asked)]
        one = radius is not None
        posted = written(_again(deep[0], own, prefix, 1 if one else post, radius, False), "permutation-posted")
        asked = written(_again(deep[1], own, prefix, 1 if one else probe, radius, True), "permutation-asked")
    done.append((posted, asked))
    return _united([p for p, _ in done]), _united([a for _, a in done])


def _blocked(posted: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of the blocks in which they meet."""
    sizes = [d.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias(n)) for d, n in ((posted, "nv"), (asked, "nq"))]
    many = written(sizes[0].join(sizes[1], "cell").where("nv > 1 or nq > 1"), "permutation-blocks")
    if many.isEmpty():
        return tuple(d.withColumns({"vb": F.lit(0).cast("bigint"), "qb": F.lit(0).cast("bigint")}) for d in (posted, asked))

    def cut(d: DataFrame, mine: str, theirs: str, own: str, other: str) -> DataFrame:
        j = d.join(many, "cell", "left").fillna(1, ["nv", "nq"])
        return j.withColumn(mine, F.pmod(F.xxhash64("rep"), own)).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop("nv", "nq")

    return cut(posted, "vb", "qb", "nv", "nq"), cut(asked, "qb", "vb", "nq", "nv")


def _search(k: int, share: float, least: int, radius: float | None):
    def searched(queries: pa.Table, posted: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and posted.num_rows:
            q, v = queries.combine_chunks(), posted.combine_chunks()
            qx, vx = _vectors(q["x"].combine_chunks()), _vectors(v["x"].combine_chunks())
            qp, vp = (t["perm"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).astype(np.int64) for t in (q, v))
            qid, vid, need = q["rep"].to_numpy(), v["rep"].to_numpy(), q["need"].to_numpy()
            size, m = qp.shape[1], len(vid)
            # place[p, v]: where pivot p stands in the order of vector v, size if it doesn't.
            used, code = np.unique(np.concatenate([qp.ravel(), vp.ravel()]), return_inverse=True)
            qp, vp = code[: qp.size].reshape(qp.shape), code[qp.size :].reshape(vp.shape)
            place = np.full((len(used), m), size, np.uint8)
            place[vp, np.arange(m)[:, None]] = np.arange(size, dtype=np.uint8)
            ranked = min(m, max(least, int(np.ceil(share * m))))
            for i in range(0, len(qid), step := max(1, _PAIRS // m)):
                part = slice(i, i + step)
                # Footrule of truncated orders: size * (size + 1) - 2 * shared.
                shared = np.zeros((len(qid[part]), m), np.int16)
                for j in range(size):
                    shared += size - np.maximum(place[qp[part, j]], j)
                if radius is not None:  # what has a larger footrule can't lie within the radius
                    r, c = np.nonzero(shared >= need[part, None])
                else:
                    c = np.argpartition(-shared, ranked - 1, axis=1)[:, :ranked].ravel()
                    r = np.repeat(np.arange(len(shared)), ranked)
                other = vid[c] != qid[part][r]
                r, c = r[other], c[other]
                d = np.concatenate([np.sqrt(((qx[part][r[a : a + _PAIRS // 64]] - vx[c[a : a + _PAIRS // 64]]) ** 2).sum(axis=1)) for a in range(0, len(r), _PAIRS // 64)] or [np.zeros(0)])
                if radius is not None:
                    near = d <= radius
                    r, c, d = r[near], c[near], d[near]
                order = np.lexsort((vid[c], d, r))
                r, c, d = r[order], c[order], d[order]
                begin = np.searchsorted(r, r)  # where the query's rows begin
                best = np.arange(len(r)) - begin < k
                out.append((qid[part][r[best]], vid[c[best]], d[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["q", "v", "dist"])

    return searched


def neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, radius: float | None = None, length: int = 54, prefix: int = 16, post: int = 4, probe: int = 16, share: float = 0.5, least: int = 512, key: str = "row_id", features: str = "features") -> DataFrame:
    """The k nearest other vectors of every query row: key, rank, neighbour, dist.

    queries has the keys that ask, each once; without it all rows ask. Distance is Euclidean,
    equal distances go by key. Rows take part if their array has length entries, none null or
    NaN; others neither ask nor are found. Equal vectors are neighbours at distance 0. Where
    fewer than k others exist or, with a radius, lie within it, there are fewer rows. Extra
    columns are ignored; an empty table gives no rows.

    Equal vectors are one content, found by their k + 1 least keys. Contents are posted in the
    lists of their nearest pivots (post of them, one with a radius) with the order of their
    prefix nearest pivots; a query goes to the lists of its probe nearest pivots or, with a
    radius, to all lists that can hold a vector within it. Long lists have pivots of their own.
    Within a list contents are ranked by footrule distance. With a radius those are compared
    whose footrule allows a vector within it, so nothing is lost at any size; otherwise the
    nearer share of the list, at least least of them.
    """
    x = F.transform(features, lambda v: v.cast("double") + F.lit(0.0))
    taken = vectors.select(F.col(key).alias("row"), x.alias("x")).where(F.col("row").isNotNull() & F.col("x").isNotNull() & (F.size("x") == length) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    reps, members = contents(taken, [], "permutation-contents")
    members = written(members, "permutation-members")
    spark = vectors.sparkSession
    count = reps.count()
    if not count:
        return spark.createDataFrame([], f"`{key}` bigint, rank int, neighbour bigint, dist double")
    pivots = spark.sparkContext.broadcast(pivots_of(reps, count))
    n_pivots = len(pivots.value)

    asking = members if queries is None else members.join(queries.select(F.col(key).alias("row")), "row")
    ask_reps = reps if queries is None else reps.join(asking.select("rep").distinct(), "rep", "left_semi")
    one = radius is not None
    posted = written(_first(reps, pivots, prefix, 1 if one else min(post, n_pivots), radius, False), "permutation-posted")
    asked = written(_first(ask_reps, pivots, prefix, 1 if one else min(probe, n_pivots), radius, True), "permutation-asked")
    posted, asked = _blocked(*_refined(posted, asked, prefix, post, probe, radius))
    met = asked.groupBy("cell", "qb", "vb").cogroup(posted.groupBy("cell", "qb", "vb")).applyInArrow(_search(k, share, least, radius), "q bigint, v bigint, dist double")
    best = met if one else met.groupBy("q", "v").agg(F.min("dist").alias("dist"))
    by_query = Window.partitionBy("q").orderBy("dist", "v")
    best = best.withColumn("rn", F.row_number().over(by_query)).where(F.col("rn") <= k).drop("rn")

    # Back from contents to rows: the k + 1 least keys of a content stand for it.
    least = members.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("row"))).where(F.col("at") <= k + 1)
    least = written(least, "permutation-least")
    cross = best.join(least.where(F.col("at") <= k).select(F.col("rep").alias("v"), "row"), "v").select(F.col("q").alias("rep"), "row", "dist")
    own = least.join(ask_reps.select("rep"), "rep", "left_semi").select("rep", "row", F.lit(0.0).alias("dist"))
    lists = own.unionByName(cross).withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("dist", "row"))).where(F.col("rn") <= k + 1)
    told = asking.join(least.select("row", F.col("at")), "row", "left")
    pairs = told.join(lists.select("rep", F.col("row").alias("neighbour"), "dist", "rn"), "rep").where("neighbour <> row")
    # A row in its own list leaves a gap at its place there; another row sees the first k.
    rank = F.when(F.col("at").isNotNull() & (F.col("rn") > F.col("at")), F.col("rn") - 1).otherwise(F.col("rn"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("row").alias(key), "rank", "neighbour", "dist")
