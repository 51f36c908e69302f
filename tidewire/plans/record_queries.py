"""Queries on delivered records, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import shared_dir, table
from tidewire.sources.svm_text import parse_lines, read_svm_text


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of svm_lines that break the format, with the first reason that holds."""
    return p3_records(spark, folder).where("reason is not null").select("line_id", "reason")


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of svm_lines: label and features, or the reason and place of its error."""
    return parse_lines(table(spark, folder, "svm_lines"), table(spark, folder, "svm_files"))


def p3_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The records of svm_lines without an error."""
    return p3_records(spark, folder).where("reason is null").select("line_id", "label", "idx", "val")


def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The features of the records of svm_lines without an error, entry by entry."""
    x = p3_valid(spark, folder).select("line_id", "label", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return x.select("line_id", "label", F.col("e.idx").alias("idx"), F.round("e.val", 9).alias("val"))


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files of orders as records, read again: every seventh has a quote that never ends,
    others a note in quotes that runs over a line end. Each record comes out with its reason."""
    k = F.col("o_orderkey")
    note = F.when(k % 7 == 0, ' # k=%s "open').when(k % 11 == 0, ' # k=%s "one\nmore # of it"').otherwise(" # k=%s")
    line = F.concat((k % 2).cast("string"), F.lit(" "), (k + 1).cast("string"), F.lit(":0.5"), F.replace(note, F.lit("%s"), k.cast("string")))
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    table(spark, folder, "orders").select(line.alias("value")).write.text(path)
    found = read_svm_text(spark, path)
    return found.select(F.regexp_extract("comment", "k=([0-9]+)", 1).cast("bigint").alias("o_orderkey"), "label", "n_pairs", "reason")


QUERIES = {"p3_found": p3_found, "p3_records": p3_records, "p3_valid": p3_valid, "p3_entries": p3_entries, "p3_texts": p3_texts}

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"

SQL = {
    "p3_found": rf"""
with l as (
  select line_id, file_name, case when right(raw, 1) = chr(13) then left(raw, length(raw) - 1) else raw end as r
  from svm_lines where raw is not null),
b as (
  select line_id, file_name, split_part(r, '#', 1) as body,
    case when contains(r, '#') then substr(r, instr(r, '#') + 1) end as com from l),
t as (select *, list_filter(string_split(replace(body, chr(9), ' '), ' '), lambda x: x <> '') as tok from b),
p as (
  select t.*, tok[2:] as pairs, f.first_index as lo, f.first_index + f.n_features - 1 as hi
  from t left join svm_files f on t.file_name = f.file_name where len(tok) > 0),
q as (
  select *, list_transform(pairs, lambda x: split_part(x, ':', 1)) as li, list_transform(pairs, lambda x: split_part(x, ':', 2)) as lv,
    list_transform(pairs, lambda x: try_cast(split_part(x, ':', 1) as bigint)) as ii from p),
r as (
  select line_id, case
    when not coalesce(regexp_full_match(tok[1], '{_NUMBER}') and try_cast(tok[1] as double) in (-1, 0, 1), false) then 'label'
    when len(list_filter(pairs, lambda x: not regexp_full_match(x, '[^:]+:[^:]+'))) > 0 then 'pair'
    when len(list_filter(li, lambda x: not regexp_full_match(x, '[0-9]+'))) > 0
      or len(list_filter(ii, lambda x: x is null or coalesce(x < lo or x > hi, false))) > 0
      or list_sort(list_distinct(ii)) <> ii then 'index'
    when len(list_filter(lv, lambda x: not coalesce(regexp_full_match(x, '{_NUMBER}') and isfinite(try_cast(x as double)), false))) > 0 then 'value'
    when com is not null and (length(com) - length(replace(com, '"', ''))) % 2 = 1 then 'quote'
    when com is not null and regexp_matches(com, '(^| )n=[0-9]+')
      and try_cast(regexp_extract(com, '(^| )n=([0-9]+)', 2) as bigint) is distinct from len(pairs) then 'count'
    end as reason from q)
select line_id, reason from r where reason is not null""",
    "p3_texts": "select o_orderkey, case when o_orderkey % 7 <> 0 then (o_orderkey % 2)::double end as label, 1::int as n_pairs, case when o_orderkey % 7 = 0 then 'quote' end as reason from orders",
}
_R = SQL["p3_found"].rindex("select line_id, reason from r")
_VALID = SQL["p3_found"][:_R].replace("select line_id, case", "select line_id, tok[1] as y, li, lv, case")
SQL["p3_entries"] = _VALID + "select line_id, y::double as label, unnest(li)::bigint as idx, round(unnest(lv)::double, 9) as val from r where reason is null"
