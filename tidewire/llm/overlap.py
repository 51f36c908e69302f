"""Same or nearly same records of fixed length across splits, by winnowed fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.contents import contents
from tidewire.session import written

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of _BASE modulo 2**64.
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Rows that numpy handles at once.
_BLOCK = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads symbols over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Spec:
    """What nearly same means: at most max_diff of length entries differ by more than tol.

    gram and window bound the guaranteed clean run: records that are nearly same share, read
    as circles, a run of at least (length - max_diff) / max_diff equal entries, and a run of
    gram + window - 1 entries always holds a fingerprint that both records select.

    With a tolerance, entries become symbols on grids shifted against one another. An entry
    within tol of an edge is open, having two symbols that near ones may share, and is open on
    one grid at most; so on a record's best grid at most length / grids entries are open.
    """

    length: int
    max_diff: int
    tol: float
    gram: int
    window: int
    grids: int = 4

    def __post_init__(self) -> None:
        run = self.length if self.max_diff == 0 else -(-(self.length - self.max_diff) // self.max_diff)
        if self.gram + self.window - 1 > run:
            raise ValueError(f"gram + window - 1 must be at most {run}")

    @property
    def order(self) -> np.ndarray:
        """Entries in strides, so that each run mixes all parts of a record."""
        step = next(s for s in range(max(1, round(self.length * 0.382)), self.length + 2) if math.gcd(s, self.length) == 1)
        return np.arange(self.length) * step % self.length

    @property
    def inner(self) -> tuple[int, int]:
        """gram and window for what is left beside a hot seed, a line of length - gram entries."""
        run = -(-(self.length - self.gram - self.max_diff) // (self.max_diff + 1))
        return max(1, (run + 1) // 2), max(1, run - max(1, (run + 1) // 2) + 1)

    def symbols(self, x: np.ndarray, grid: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of every entry on a grid, and the other one it may share if it is open."""
        if self.tol == 0:
            own = _mixed((x + 0.0).view(np.int64))
            return own, own
        cell, near = 64 * self.tol, self.tol * 1.001
        low, own, high = (np.floor((x + d) / cell + grid / self.grids + 0.5) for d in (-near, 0.0, near))
        other = np.where(low != own, low, high)
        with np.errstate(invalid="ignore"):
            return _mixed(own.astype(np.int64).view(np.uint64)), _mixed(other.astype(np.int64).view(np.uint64))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column as a matrix, nulls as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _grams(sym: np.ndarray, gram: int, count: int) -> np.ndarray:
    """Rolling hashes of the grams at positions 0 .. count-1 of every row."""
    m = sym.shape[1]
    powers = np.cumprod(np.r_[np.uint64(1), np.full(m - 1, _BASE)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(count - 1, _BACK)], dtype=np.uint64) if count > 1 else np.ones(1, np.uint64)
    run = np.concatenate([np.zeros((len(sym), 1), np.uint64), np.cumsum(sym * powers, axis=1, dtype=np.uint64)], axis=1)
    return _mixed((run[:, gram : gram + count] - run[:, :count]) * back)


def _good(bad: np.ndarray, gram: int, count: int) -> np.ndarray:
    """Which grams hold no missing entry."""
    run = np.concatenate([np.zeros((len(bad), 1), np.int32), np.cumsum(bad, axis=1, dtype=np.int32)], axis=1)
    return run[:, gram : gram + count] == run[:, :count]


def _selected(h: np.ndarray, good: np.ndarray, window: int, circle: bool) -> np.ndarray:
    """Winnowing: the least hash of every window of grams, the last one of equals."""
    top = np.where(good, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    n, count = h.shape
    if circle:
        top = np.concatenate([top, top[:, : window - 1]], axis=1)
    w = sliding_window_view(top, window, axis=1)[:, :, ::-1]
    at = np.arange(w.shape[1]) + window - 1 - w.argmin(axis=2)
    out = np.zeros((n, count), bool)
    out[np.repeat(np.arange(n), at.shape[1]), at.ravel() % count] = True
    return out & good


def _winnowed(sym: np.ndarray, bad: np.ndarray, spec: Spec, inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and hash of the selected grams of records read as circles, or as lines."""
    gram, window = spec.inner if inner else (spec.gram, spec.window)
    count = sym.shape[1] - gram + 1
    good, h = _good(bad, gram, count), _grams(sym, gram, count)
    r, p = np.nonzero(_selected(h, good, window, not inner))
    return r, p, h[r, p]


def _seed_rows(x: np.ndarray, spec: Spec, posts: bool, start: np.ndarray | None = None, grid: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, position, grid and key of the seeds of every record.

    The side that posts selects seeds on every grid. The other side takes each record's grid of
    fewest open entries and selects seeds under every mix of their symbols, 2 ** (length /
    grids) mixes at the most; one of these is how the other record reads there. With start and
    grid, the seeds on that grid of the line that is left when the gram at start is taken out.
    """
    n, m = x.shape
    if start is None:
        cols = np.tile(np.r_[spec.order, spec.order[: spec.gram - 1]], (n, 1))
    else:
        cols = spec.order[(start[:, None] + spec.gram + np.arange(m - spec.gram)) % m]
    at, bad = np.arange(n)[:, None], np.isnan(x)
    grids = range(spec.grids if spec.tol else 1)
    read = [spec.symbols(x, g) for g in grids]
    if grid is None and not posts:
        grid = np.argmin([((a != b) & ~bad).sum(axis=1) for a, b in read], axis=0)
    out = []
    for g in grids:
        rows = np.arange(n) if grid is None else np.flatnonzero(grid == g)
        if not len(rows):
            continue
        sym, other = (s[at[rows], cols[rows]] for s in read[g])
        gone = bad[at[rows], cols[rows]]
        if posts:
            r, p, h = _winnowed(sym, gone, spec, start is not None)
            out.append((rows[r], p, np.full(len(r), g), h))
            continue
        # The entries of a record in the places where the circle repeats them are open together.
        open_ = ((read[g][0] != read[g][1]) & ~bad)[rows]
        if start is not None:
            open_ &= (cols[rows][:, :, None] == np.arange(m)).any(axis=1)
        many = open_.sum(axis=1)
        for o in np.unique(many):
            own = np.flatnonzero(many == o)
            rank = np.cumsum(open_[own], axis=1) - 1
            for a in range(0, len(own), block := max(1, _BLOCK >> int(o))):
                k = own[a : a + block]
                bits = np.arange(1 << int(o))
                swap = open_[k][None] & (bits[:, None, None] >> np.maximum(rank[a : a + block], 0)[None] & 1 == 1)  # mix, record, entry
                c = np.broadcast_to(cols[rows[k]], (len(bits), *cols[rows[k]].shape))
                mixed = np.where(np.take_along_axis(swap, c, axis=2), other[k], sym[k]).reshape(-1, cols.shape[1])
                r, p, h = _winnowed(mixed, np.tile(gone[k], (len(bits), 1)), spec, start is not None)
                found = np.stack([(r % len(k)).astype(np.uint64), p.astype(np.uint64), h])
                r, p, h = np.unique(found, axis=1) if o else found
                out.append((rows[k[r.astype(np.int64)]], p.astype(np.int64), np.full(len(r), g), h))
    r, p, g, h = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return r, p, g, _mixed(h.astype(np.uint64) + (p * 64 + g).astype(np.uint64) * _BASE).view(np.int64)


_SEED = "rep bigint, cls tinyint, pos int, grid tinyint, seed bigint"
_SEED_NAMES = ["rep", "cls", "pos", "grid", "seed"]


def _seeds(reps: DataFrame, spec: Spec, posts: bool) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _BLOCK):
                part = b.slice(i, _BLOCK)
                r, p, g, key = _seed_rows(_matrix(part.column(2), spec.length), spec, posts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r)), pa.array(p, pa.int32()), pa.array(g.astype(np.int8)), pa.array(key)], _SEED_NAMES)

    return reps.select("rep", "cls", "x").mapInArrow(made, _SEED)


def _inner_seeds(hot: DataFrame, spec: Spec, posts: bool) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _BLOCK):
                part = b.slice(i, _BLOCK)
                pos, grid, outer = (part.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
                r, _, _, key = _seed_rows(_matrix(part.column(5), spec.length), spec, posts, pos, grid)
                both = _mixed(key.view(np.uint64) ^ _mixed(outer[r].view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(r)) for c in range(4)), pa.array(both)], _SEED_NAMES)

    return hot.select("rep", "cls", "pos", "grid", "seed", "x").mapInArrow(made, _SEED)


def _crowds(a: DataFrame, b: DataFrame, hot: int) -> DataFrame:
    """The seeds shared by more than hot pairs, with their records on both sides, as a table."""
    marked = [d.select("cls", "seed", F.lit(s).cast("long").alias("na"), F.lit(1 - s).cast("long").alias("nb")) for d, s in ((a, 1), (b, 0))]
    both = marked[0].unionByName(marked[1]).groupBy("cls", "seed").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return written(both.where(F.col("na") * F.col("nb") > hot), "overlap-hot")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """rep_a, rep_b, pos of the pairs that share a seed."""
    return a.select("cls", "seed", "pos", F.col("rep").alias("rep_a")).join(b.select("cls", "seed", F.col("rep").alias("rep_b")), ["cls", "seed"]).select("rep_a", "rep_b", "pos")


def _met_in_blocks(a: DataFrame, b: DataFrame, crowd: DataFrame, side: int) -> DataFrame:
    """_met for seeds of crowds: blocks of side records meet, so none gathers in one task."""
    cut = crowd.select("cls", "seed", F.ceil(F.col("na") / side).alias("ka"), F.ceil(F.col("nb") / side).alias("kb"))

    def spread(d: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return d.join(cut, ["cls", "seed"]).withColumn(i, F.pmod(F.xxhash64("rep"), own)).withColumn(j, F.explode(F.sequence(zero, F.col(other) - 1)))

    left, right = spread(a, "ka", "kb", "i", "j"), spread(b, "kb", "ka", "j", "i")
    return left.select("cls", "seed", "i", "j", "pos", F.col("rep").alias("rep_a")).join(right.select("cls", "seed", "i", "j", F.col("rep").alias("rep_b")), ["cls", "seed", "i", "j"]).select("rep_a", "rep_b", "pos")


def overlaps(records: DataFrame, spec: Spec, key: str = "row_id", split: str = "split", features: str = "features", cls: str | None = None, train: str = "trn", held: tuple[str, ...] = ("val", "tst"), hot: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """Overlapping contents between the training and the held-out splits.

    Returns (pairs, members). Equal feature arrays of a side and class are one content, named
    by its least key: rep. pairs has rep_a (training), rep_b (held out), n_seeds, first_seed,
    last_seed, n_diff and coverage, the share of entries within tol; members has key, held
    (0 or 1) and rep of every record that takes part. A null or NaN entry differs from
    everything, also from itself. Records with a null array, another length, a null split,
    another split or, where cls is given, a null class take no part; pairs are within a class.
    Extra columns are ignored; an empty table gives none.

    Seeds are winnowed minima of rolling hashes over the entries in a mixing order, on both
    sides; they are joined on hash, place and class. As records are aligned entry by entry, the
    seeds of a pair lie on one diagonal and chain into one; the pair is walked from the chain
    on around the record and given up once too much differs. A seed shared by more than hot
    pairs isn't joined: both sides select seeds once more among the remaining entries and join
    on both seeds together, which loses no pair, as the rest of nearly same records again holds
    a clean run. Seeds still shared by so many then meet in blocks.
    """
    side = F.when(F.col(split) == train, 0).when(F.col(split).isin(*held), 1)
    taken = records.select(F.col(key).alias("row"), side.cast("tinyint").alias("held"), (F.col(cls) if cls else F.lit(0)).cast("tinyint").alias("cls"), F.transform(features, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    taken = taken.where(f"held is not null and cls is not null and x is not null and size(x) = {spec.length} and row is not null")
    reps, members = contents(taken, ["held", "cls"], "overlap-reps")
    members = members.select(F.col("row").alias(key), "held", "rep")
    index, probe = reps.where("held = 0"), reps.where("held = 1")
    # The held-out side, the smaller one, posts on all grids.
    a, b = written(_seeds(index, spec, False), "overlap-index"), written(_seeds(probe, spec, True), "overlap-probe")
    crowd = _crowds(a, b, hot)
    if crowd.isEmpty():
        joined = _met(a, b)
    else:
        joined = _met(*(d.join(crowd, ["cls", "seed"], "left_anti") for d in (a, b)))
        inner = [written(_inner_seeds(d.join(crowd, ["cls", "seed"], "left_semi").join(r.select("rep", "x"), "rep"), spec, s), "overlap-inner") for d, r, s in ((a, index, False), (b, probe, True))]
        again = _crowds(*inner, hot)
        clear = inner if again.isEmpty() else [d.join(again, ["cls", "seed"], "left_anti") for d in inner]
        joined = joined.unionByName(_met(*clear))
        if not again.isEmpty():
            joined = joined.unionByName(_met_in_blocks(*inner, again, max(1, math.isqrt(hot))))
    chains = joined.groupBy("rep_a", "rep_b").agg(F.count_distinct("pos").alias("n_seeds"), F.min("pos").alias("first_seed"), F.max("pos").alias("last_seed"))
    both = chains.join(index.select(F.col("rep").alias("rep_a"), F.col("x").alias("xa")), "rep_a").join(probe.select(F.col("rep").alias("rep_b"), F.col("x").alias("xb")), "rep_b")
    return _extended(both, spec), members


def _walk(xa: np.ndarray, xb: np.ndarray, begin: np.ndarray, spec: Spec, step: int = 32) -> np.ndarray:
    """How many entries differ, walking from the beginning of the chain around the record; a
    pair is left, with a count above max_diff, once the count is above it."""
    m, differ, going = spec.length, np.zeros(len(xa), np.int64), np.arange(len(xa))
    for i in range(0, m, step):
        cols = spec.order[(begin[going, None] + np.arange(i, min(m, i + step))) % m]
        a, b = (x[going[:, None], cols] for x in (xa, xb))
        differ[going] += (~(np.abs(a - b) <= spec.tol)).sum(axis=1)
        going = going[differ[going] <= spec.max_diff]
    return differ


def _extended(both: DataFrame, spec: Spec) -> DataFrame:
    """Extend every chain over the whole record and keep those within max_diff."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = _walk(_matrix(b.column(5), spec.length), _matrix(b.column(6), spec.length), b.column(3).to_numpy().astype(np.int64), spec)
            keep = pa.array(np.flatnonzero(differ <= spec.max_diff))
            n = differ[differ <= spec.max_diff]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(keep) for i in range(5)), pa.array(n.astype(np.int32)), pa.array(1 - n / spec.length)], ["rep_a", "rep_b", "n_seeds", "first_seed", "last_seed", "n_diff", "coverage"])

    kept = both.select("rep_a", "rep_b", "n_seeds", "first_seed", "last_seed", "xa", "xb")
    return kept.mapInArrow(walked, "rep_a bigint, rep_b bigint, n_seeds bigint, first_seed int, last_seed int, n_diff int, coverage double")


def expanded(pairs: DataFrame, members: DataFrame, key: str = "row_id") -> DataFrame:
    """Every pair of records: trn, other, n_diff and coverage."""
    a = members.where("held = 0").select(F.col("rep").alias("rep_a"), F.col(key).alias("trn"))
    b = members.where("held = 1").select(F.col("rep").alias("rep_b"), F.col(key).alias("other"))
    return pairs.join(a, "rep_a").join(b, "rep_b").select("trn", "other", "n_diff", "coverage")


def report(records: DataFrame, pairs: DataFrame, members: DataFrame, key: str = "row_id", split: str = "split", source: str = "source") -> DataFrame:
    """Per held-out split and source: records, those with an overlap and an exact one, and the
    mean of the best coverage among the overlapping. Null sources are a source of their own."""
    best = pairs.groupBy("rep_b").agg(F.max("coverage").alias("coverage"))
    found = members.where("held = 1").join(best, members["rep"] == best["rep_b"]).select(F.col(key).alias("_row"), "coverage")
    held = records.join(members.where("held = 1").select(F.col(key).alias("_in")), F.col(key) == F.col("_in")).join(found, F.col(key) == F.col("_row"), "left")
    return held.groupBy(split, source).agg(F.count("*").alias("n_records"), F.count("coverage").alias("n_overlapping"), F.count_if(F.col("coverage") == 1).alias("n_exact"), F.avg("coverage").alias("mean_coverage"))
