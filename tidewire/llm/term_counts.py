"""Exact occurrence and record counts of every term, by heavy-light aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written

#: Light terms that a task gathers before it adds them up and hands them on.
_GATHERED = 1 << 18
#: Bits of the filter of records that may be delivered more than once.
FILTER_BITS = 1 << 24
#: A term is heavy if it makes up at least one of so many entries of its group, so no group has more heavy terms.
HEAVY = 4096


def heavy_terms(entries: DataFrame, most: int = HEAVY, tracked: int = 16384) -> dict[int, np.ndarray]:
    """The terms detected as heavy, sorted, by group: those of at least 1 / most of its entries.

    One pass with a mergeable frequent-items sketch over all entries. The sketch may miss or
    add a term without harm: being heavy only decides the way a term is counted.
    """
    top = entries.groupBy("grp").agg(F.expr(f"approx_top_k(term, {min(most, tracked)}, {tracked})").alias("top"), F.count("*").alias("n"))
    return {r["grp"]: np.sort(np.array([x["item"] for x in r["top"] if x["count"] * most >= r["n"]], np.int64)) for r in top.collect()}  # one row per group


def repeated_records(records: DataFrame) -> tuple[bytes, dict[int, int]]:
    """A Bloom filter of the records that stand in more than one place, and the number of
    distinct records by group. records has grp and rec in the order of delivery.

    A place is a run of rows of one record. The filter has FILTER_BITS bits at any number of
    records; the fuller it is, the more entries take the way of repeated ones, with the same
    result.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.take(pa.array(np.flatnonzero(_new(b.column(0), b.column(2)))))

    kinds = ", ".join(f"{n} {k}" for n, k in records.dtypes)
    per = records.withColumn("h", F.xxhash64("grp", "rec")).mapInArrow(runs, f"{kinds}, h bigint").groupBy("grp", "rec").agg(F.count("*").alias("n"), F.first("h").alias("h"))
    bit = "struct(cast(shiftright({0}, 6) as bigint) as w, shiftleft(1L, cast({0} & 63 as int)) as bits, 0L as c)"
    places = [f"(h & {FILTER_BITS - 1})", f"(shiftrightunsigned(h, 32) & {FILTER_BITS - 1})"]
    one = "struct(-1L - grp as w, 0L as bits, 1L as c)"
    marks = per.select(F.explode(F.expr(f"if(n > 1, array({one}, {', '.join(bit.format(p) for p in places)}), array({one}))")).alias("x"))
    rows = marks.groupBy("x.w").agg(F.bit_or("x.bits").alias("bits"), F.sum("x.c").alias("c")).collect()  # at most FILTER_BITS / 64, and one per group
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    totals = {}
    for r in rows:
        if r["w"] < 0:
            totals[-1 - r["w"]] = r["c"]
        else:
            out[r["w"]] = r["bits"]
    return out.tobytes(), totals


def _new(grp: pa.Array, h: pa.Array) -> np.ndarray:
    """Where a run of one record begins."""
    g, k = grp.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
    return np.r_[True, (np.diff(g) != 0) | (k[1:] != k[:-1])]


def _seen(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    rest = 8 * len(bits) - 1
    places = [h & rest, (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) & rest]
    return np.logical_and.reduce([bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in places]).astype(bool)


class _Counter:
    """Counts of one task: an array over the heavy terms of each group, light terms in turn."""

    def __init__(self, heavy: dict[int, np.ndarray]):
        self.heavy, self.light, self.held = heavy, [], 0
        self.arrays = {g: np.zeros((2, len(t)), np.int64) for g, t in heavy.items()}

    def add(self, grp: np.ndarray, term: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Terms of one record each, with their entries."""
        for g in np.unique(grp):
            own = slice(None) if (grp == g).all() else grp == g
            t, k, table = term[own], n[own], self.heavy.get(int(g), np.zeros(0, np.int64))
            hit = np.zeros(len(t), bool)
            if len(table):
                at = np.searchsorted(table, t)
                at[at == len(table)] = 0
                hit = table[at] == t
                # The counts of one task stay far below 2**53, so bincount's doubles are exact.
                self.arrays[int(g)] += np.stack([np.bincount(at[hit], k[hit], len(table)), np.bincount(at[hit], minlength=len(table))]).astype(np.int64)
            rest = ~hit
            self.light.append(np.stack([np.full(rest.sum(), g, np.int64), t[rest], k[rest], np.ones(rest.sum(), np.int64)]))
            self.held += self.light[-1].shape[1]
        if self.held >= _GATHERED:
            yield from self.flushed()

    def flushed(self) -> Iterator[pa.RecordBatch]:
        if self.light:
            yield from _added(self.light)
        self.light, self.held = [], 0

    def ended(self) -> Iterator[pa.RecordBatch]:
        yield from self.flushed()
        for g, (entries_, records) in self.arrays.items():
            some = records > 0
            yield _batch(np.full(some.sum(), g), self.heavy[g][some], entries_[some], records[some])


_COUNTS = "grp tinyint, term bigint, n_entries bigint, n_records bigint"


def term_counts(entries: DataFrame, group: str, record: str, term: str, value: str, groups: list[str], records: DataFrame | None = None, most_heavy: int = HEAVY) -> tuple[DataFrame, dict[str, int]]:
    """Count every term of every group: columns group, term, n_entries, n_records; also the
    number of distinct records by group, if records is given.

    n_entries counts the delivered entries whose value is neither null nor zero, n_records the
    distinct records with such an entry. NaN counts as a value. Entries without record or term
    count nowhere, those of a group not named in groups neither. Repeated deliveries of an
    entry count each in n_entries and once in n_records. An empty table gives no rows.

    records are the rows that entries come from, with group and record, in an order that is
    the same whenever they are read, as that of a table's files is. A record whose rows stand
    together in one place is counted where it lies: each task counts the detected heavy terms
    in a counter array of its own, which leaves it once, and the light terms row by row. Only
    the entries of records that stand in several places, or at the edge of a batch, are first
    made distinct by a shuffle, by the whole key, so that neither a much repeated entry nor a
    huge record gathers in one task; they are then counted the same way. The tables add up in
    one exchange. Without records all entries take the second way.
    """
    spark = entries.sparkSession
    code = (F.array_position(F.array(*(F.lit(g) for g in groups)), F.col(group)) - 1).cast("tinyint")
    kept = entries.select(code.alias("grp"), F.col(record).alias("rec"), F.col(term).cast("bigint").alias("term"), F.col(value).alias("v"))
    kept = kept.where("grp >= 0 and rec is not null and term is not null and v <> 0").drop("v")
    sent_heavy = spark.sparkContext.broadcast(heavy_terms(kept, most_heavy))
    bits, totals = repeated_records(records.select(code.alias("grp"), F.col(record).alias("rec")).where("grp >= 0 and rec is not null")) if records is not None else (None, {})
    sent_bits = spark.sparkContext.broadcast(bits)
    rec_kind = dict(kept.dtypes)["rec"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _Counter(sent_heavy.value), np.frombuffer(sent_bits.value, np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            grp, term_, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            run = np.cumsum(_new(b.column(0), b.column(3))) - 1
            order = np.lexsort((term_, run))
            run, grp, term_, h = run[order], grp[order], term_[order], h[order]
            first = np.flatnonzero(np.r_[True, (np.diff(run) != 0) | (np.diff(term_) != 0)])
            n = np.diff(np.r_[first, len(run)])
            run, grp, term_, h = run[first], grp[first], term_[first], h[first]
            again = _seen(seen, h) | (run == 0) | (run == run[-1])
            for x in counter.add(grp[~again], term_[~again], n[~again]):
                yield _with_record(x, b.schema.field(1).type)
            at = np.flatnonzero(again)
            kinds = [pa.int8(), b.schema.field(1).type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(grp[at].astype(np.int8)), b.column(1).take(pa.array(order[first[at]])), *(pa.array(c, k) for c, k in zip((term_[at], n[at], np.ones(len(at), np.int64)), kinds[2:], strict=True))], ["grp", "rec", "term", "n_entries", "n_records"])
        for x in counter.ended():
            yield _with_record(x, _REC_TYPES.get(rec_kind, pa.string()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sent_heavy.value)
        for b in batches:
            yield from counter.add(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        yield from counter.ended()

    local = None
    if bits is not None:
        both = kept.withColumn("h", F.xxhash64("grp", "rec")).mapInArrow(split, f"grp tinyint, rec {rec_kind}, term bigint, n_entries bigint, n_records bigint")
        both = written(both, "term-counts")
        local, kept = both.where("rec is null").drop("rec"), both.where("rec is not null").select("grp", "rec", "term", F.col("n_entries").alias("n"))
    else:
        kept = kept.withColumn("n", F.lit(1))
    distinct = kept.groupBy("grp", "rec", "term").agg(F.sum("n").alias("n")).select("grp", "term", "n")
    parts = distinct.mapInArrow(counted, _COUNTS)
    parts = parts if local is None else parts.unionByName(local)
    name = F.element_at(F.array(*(F.lit(g) for g in groups)), F.col("grp").cast("int") + 1)
    counts = parts.groupBy("grp", "term").agg(F.sum("n_entries").alias("n_entries"), F.sum("n_records").alias("n_records")).select(name.alias(group), F.col("term").alias(term), "n_entries", "n_records")
    return counts, {groups[g]: n for g, n in totals.items()}


_REC_TYPES = {"bigint": pa.int64(), "int": pa.int32()}


def _with_record(b: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, kind), *b.columns[1:]], ["grp", "rec", "term", "n_entries", "n_records"])


def _added(light: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Gathered light terms as one row per group and term."""
    a = np.concatenate(light, axis=1)
    a = a[:, np.lexsort((a[1], a[0]))]
    first = np.flatnonzero(np.r_[True, (np.diff(a[0]) != 0) | (np.diff(a[1]) != 0)][: a.shape[1]])
    if len(first):
        yield _batch(a[0][first], a[1][first], np.add.reduceat(a[2], first), np.add.reduceat(a[3], first))


def _batch(g: np.ndarray, t: np.ndarray, e: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int8)), pa.array(t, pa.int64()), pa.array(e, pa.int64()), pa.array(r, pa.int64())], ["grp", "term", "n_entries", "n_records"])


def marked(counts: DataFrame, totals: DataFrame, group: str, rare: int = 2, common_percent: int = 30) -> DataFrame:
    """Add mark: 'rare' for terms of at most rare records, 'common' for those in more than
    common_percent of the group's records, else null; rare goes first. totals has group and
    n_all with one row per group, which bounds what is broadcast."""
    m = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") * 100 > F.col("n_all") * common_percent, "common")
    return counts.join(F.broadcast(totals), group).withColumn("mark", m).drop("n_all")
