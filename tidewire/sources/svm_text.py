"""SVMlight lines and files as DataFrames: typed records beside located syntax errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import ship, written
from tidewire.sources.svm_grammar import REASONS, anchor, parse_record, parse_text

_OUT = "label double, idx array<bigint>, val array<double>, comment string, n_pairs int, reason string, error_at int, error_text string"
_ARROW = [
    ("label", pa.float64()),
    ("idx", pa.list_(pa.int64())),
    ("val", pa.list_(pa.float64())),
    ("comment", pa.string()),
    ("n_pairs", pa.int32()),
    ("reason", pa.string()),
    ("error_at", pa.int32()),
    ("error_text", pa.string()),
]


def _fields(r) -> tuple:
    """A record as the output columns: an erroneous one keeps no label or features."""
    if r.errors:
        rank, at, token = min(r.errors)
        return None, None, None, r.comment, r.n_pairs, REASONS[rank], at, token
    return r.label, r.index, r.value, r.comment, r.n_pairs, None, None, None


def parse_lines(lines: DataFrame, files: DataFrame | None = None, key: str = "line_id", raw: str = "raw", file: str = "file_name") -> DataFrame:
    """One row per record of the lines, valid or not.

    Columns: the key, label, idx, val, comment, n_pairs, reason, error_at, error_text. A valid
    record has label and features and a null reason; another has the first reason that holds,
    the offset in the line and the offending token, and neither label nor features. Null
    lines, blank lines and lines of a comment only are no records and give no row. Repeated
    lines stay, as each has its own key. A line of no known file has its indices checked for
    digits and order only. Other columns of either table are ignored. An empty table gives none.
    """
    ship(lines.sparkSession)
    source = lines.select(F.col(key).alias("_key"), F.col(raw).alias("_raw"), F.col(file).alias("_file") if files is not None else F.lit(None).cast("string").alias("_file")).where("_raw is not null")
    if files is not None:
        # Only names and bounds are joined; Spark broadcasts them when their size is under its threshold.
        bounds = files.groupBy(F.col(file).alias("_file")).agg(F.min("first_index").alias("_low"), F.max("n_features").alias("_n"))
        source = source.join(bounds, "_file", "left").select("_key", "_raw", "_low", "_n")
    else:
        source = source.select("_key", "_raw", F.lit(None).cast("int").alias("_low"), F.lit(None).cast("int").alias("_n"))
    kind = dict(lines.dtypes)[key]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for i, (text, low, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                r = parse_record(text, low, n)
                if not r.empty:
                    keep.append(i)
                    rows.append(_fields(r))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW, strict=True))], [key, *(n for n, _ in _ARROW)])

    return source.mapInArrow(parsed, f"`{key}` {kind}, {_OUT}")


#: Characters of a piece of a text, which one step parses.
PIECE = 1 << 22


def parse_texts(texts: DataFrame, files: DataFrame | None = None, key: str = "file_name", text: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per record of whole texts: the key, line_no from 1, and the columns of parse_lines.

    A quoted comment may run over line ends; where its end is missing before the next validated
    record start, the record ends with its line and parsing resumes there. files has first_index
    and n_features by key. Null and empty texts give no row. Texts are cut into pieces of about
    piece characters at validated record starts, and pieces are parsed apart from one another;
    line numbers are made whole afterwards from the pieces' numbers of lines.
    """
    ship(texts.sparkSession)
    source = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    pieces = source.mapInArrow(_cut(piece), f"_key {dict(texts.dtypes)[key]}, _piece int, _before bigint, _text string")
    return _parsed(pieces, files, key, dict(texts.dtypes)[key])


def _cut(piece: int):
    """Cuts texts at anchors, so that no record is torn: every anchor begins a record, as a
    quote that is still open before it would end there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                whole, at, n, lines = b.column(1)[i].as_py(), 0, 0, 0
                while at < len(whole):
                    near = whole.find("\n", at + piece)
                    to = anchor(whole, near + 1) if near >= 0 else None
                    part = whole[at : len(whole) if to is None else to]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([n], pa.int32()), pa.array([lines], pa.int64()), pa.array([part])], ["_key", "_piece", "_before", "_text"])
                    lines += part.count("\n")
                    at, n = at + len(part), n + 1

    return cut


def _parsed(pieces: DataFrame, files: DataFrame | None, key: str, kind: str) -> DataFrame:
    """The records of pieces (_key, _before, _text); _before is the number of lines before."""
    if "_low" in pieces.columns:
        pass
    elif files is not None:
        bounds = files.groupBy(F.col(key).alias("_key")).agg(F.min("first_index").alias("_low"), F.max("n_features").alias("_n"))
        pieces = pieces.join(bounds, "_key", "left")
    else:
        pieces = pieces.withColumns({"_low": F.lit(None).cast("int"), "_n": F.lit(None).cast("int")})

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (before, text, low, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                rows = []
                for r in parse_text(text, low, n):
                    if not r.empty:
                        rows.append((before + r.line, *_fields(r)))
                    if len(rows) >= 10_000:
                        yield _records(b.column(0), i, rows, key)
                        rows = []
                if rows:
                    yield _records(b.column(0), i, rows, key)

    return pieces.select("_key", "_before", "_text", "_low", "_n").mapInArrow(parsed, f"`{key}` {kind}, line_no bigint, {_OUT}")


def _records(keys: pa.Array, i: int, rows: list[tuple], key: str) -> pa.RecordBatch:
    kinds = [("line_no", pa.int64()), *_ARROW]
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(np.full(len(rows), i))), *columns], [key, *(n for n, _ in kinds)])


def read_svm_text(spark: SparkSession, paths: str | list[str], first_index: int | None = None, n_features: int | None = None) -> DataFrame:
    """Read SVMlight files of any size: path, line_no and the columns of parse_lines.

    A quoted comment may run over line ends. Spark's text source splits files by bytes into
    lines. Lines where a validated record start stands begin a piece, and the lines up to the
    next one belong to it, so a broken quote is resolved within its piece and no task needs a
    whole file. Lines keep their order by file and byte position. Compressed files are read as
    the text source reads them. Records with errors are returned with their reason and place.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(paths).select("_metadata.file_path", "_metadata.file_block_start", "value")
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a split come in order; a split's lines are numbered from 0 within the file's split.
        seen: dict[tuple, int] = {}
        for b in batches:
            spots = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            numbers, starts = [], []
            for spot, line in zip(spots, b.column(2).to_pylist(), strict=True):
                numbers.append(seen.get(spot, 0))
                seen[spot] = numbers[-1] + 1
                starts.append(anchor(line, 0) == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers, pa.int64()), pa.array(starts), b.column(2)], ["path", "start", "n", "anchor", "line"])

    marked = written(numbered.drop("_id").mapInArrow(placed, "path string, start bigint, n bigint, anchor boolean, line string"), "svm-lines")
    splits = marked.groupBy("path", "start").agg(F.max("n").alias("m"), F.max(F.when(F.col("anchor"), F.col("n"))).alias("last"))
    by_file = Window.partitionBy("path").orderBy("start")  # a row per split
    before = F.coalesce(F.sum(F.col("m") + 1).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = F.last(F.when(F.col("last").isNotNull(), F.struct("start", F.col("last").alias("n"))), True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "start", before.alias("before"), carried.alias("open"))
    within = Window.partitionBy("path", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("anchor"), F.struct("start", "n")), True).over(within)
    joined = marked.join(splits, ["path", "start"]).withColumn("_own", own)
    piece_ = F.coalesce("_own", "open", F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("n")))
    texts = joined.groupBy("path", piece_.alias("_piece")).agg(F.min(F.col("before") + F.col("n")).alias("_before"), F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), "n", "line"))).alias("x"))  # the lines from one record start to the next
    pieces = texts.select(F.col("path").alias("_key"), "_before", F.array_join("x.line", "\n").alias("_text"), F.lit(first_index).cast("int").alias("_low"), F.lit(n_features).cast("int").alias("_n"))
    return _parsed(pieces, None, "path", "string")


def read_svmlight(spark: SparkSession, paths: str | list[str], n_features: int | None = None) -> DataFrame:
    """Lenient scan, line by line, all in Spark expressions.

    Blank lines, comments and tokens without a colon are skipped. Indices are kept if the
    smallest of all is 0, else lowered by one. Columns: label, idx, val, width; width is
    n_features or the largest index plus one. An empty file gives no rows.
    """
    body = F.trim(F.regexp_replace(F.split("value", "#", 2)[0], r"[ \t\r]+", " "))
    tokens = F.split("body", " ")
    rows = spark.read.text(paths).select(body.alias("body")).where("body <> ''")
    pairs = F.transform(F.filter(F.slice(tokens, 2, 1 << 30), lambda t: t.contains(":")), lambda t: F.split(t, ":", 2))
    rows = rows.select(tokens[0].cast("double").alias("label"), pairs.alias("p"))
    rows = rows.select("label", F.transform("p", lambda x: x[0].cast("bigint")).alias("i"), F.transform("p", lambda x: x[1].cast("double")).alias("val"))
    ends = rows.agg(F.min(F.array_min("i")).alias("low"), F.max(F.array_max("i")).alias("high"))
    base = F.when(F.col("low") == 0, 0).otherwise(1)
    width = F.lit(n_features).cast("bigint") if n_features is not None else F.coalesce(F.col("high") - base + 1, F.lit(0))
    # One row of two numbers: the size of what is broadcast is fixed.
    return rows.join(F.broadcast(ends)).select("label", F.transform("i", lambda x: x - base).alias("idx"), "val", width.cast("bigint").alias("width"))


def write_svmlight(df: DataFrame, path: str, label: str = "label", idx: str = "idx", val: str = "val", first_index: int = 1) -> None:
    """Write label and sparse features as SVMlight text, one part file per partition."""
    pairs = F.transform(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v")), lambda x: F.concat((x["i"] + first_index).cast("string"), F.lit(":"), x["v"].cast("string")))
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)
