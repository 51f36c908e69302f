"""DuckDB SQL of the queries that SQL can express."""

_P1 = """
with e as (
  select 'url_svmlight' as dataset, row_id, col, value from url_svmlight_x
  union all
  select 'kdd2010', row_id, unnest(cols), unnest(vals) from kdd2010),
n as (
  select 'url_svmlight' as dataset, count(distinct row_id) as n_all from url_svmlight_x
  union all
  select 'kdd2010', count(distinct row_id) from kdd2010),
c as (
  select dataset, col, count(*) as n_entries, count(distinct row_id) as n_records
  from e where col is not null and row_id is not null and value <> 0 group by dataset, col),
m as (
  select c.*, case when n_records <= 2 then 'rare' when n_records * 100 > n_all * 30 then 'common' end as mark
  from c join n using (dataset))
"""

_P2 = """
with near as (
  select 'adult' as dataset, a.row_id as trn, b.row_id as other,
    list_sum(list_transform(range(1, 124), lambda i: case when coalesce(a.features[i] = b.features[i], false) then 0 else 1 end)) as n_diff,
    123 as n, 3 as most
  from adult a, adult b
  where a.split = 'trn' and b.split in ('val', 'tst') and len(a.features) = 123 and len(b.features) = 123
  union all
  select 'ijcnn1', a.row_id, b.row_id,
    list_sum(list_transform(range(1, 23), lambda i: case when coalesce(abs(a.features[i] - b.features[i]) <= 0.0015, false) then 0 else 1 end)), 22, 1
  from ijcnn1 a, ijcnn1 b
  where a.split = 'trn' and b.split in ('val', 'tst') and len(a.features) = 22 and len(b.features) = 22
    and (a.label > 0) = (b.label > 0)),
p as (select * from near where n_diff <= most)
"""

_P2_CONTENT = """,
c as (
  select 'adult' as dataset, row_id, (split <> 'trn')::int as held, features, true as cls from adult
  where split in ('trn', 'val', 'tst') and len(features) = 123
  union all
  select 'ijcnn1', row_id, (split <> 'trn')::int, features, label > 0 from ijcnn1
  where split in ('trn', 'val', 'tst') and len(features) = 22 and label is not null),
m as (select dataset, row_id, held, min(row_id) over (partition by dataset, held, cls, features) as rep from c)
"""

_P8 = """
with d as (
  select doc_id, text, lower(left(lang, 2)) as lang2,
    list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda x: x <> '') as w,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as ln
  from documents where text is not null),
c as (select lang, list(word) as words from common_words group by lang),
s as (
  select doc_id, lang2, len(w) as n_words,
    length(regexp_replace(text, '[^\\p{L}]', '', 'g')) as n_letters,
    length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) as n_visible,
    length(regexp_replace(text, '[\\p{L}\\p{Nd} \\t\\n\\r]', '', 'g')) as n_symbols,
    len(ln) as n_lines, len(list_filter(ln, lambda x: right(x, 1) in ('.', '!', '?'))) as n_ended,
    len(list_filter(w, lambda x: coalesce(list_contains(c.words, lower(x)), false))) as n_common
  from d left join c on d.lang2 = c.lang)
"""

SQL = {
    "p2_found": _P2 + "select dataset, least(trn, other) as row_a, greatest(trn, other) as row_b from p",
    "p2_report": _P2
    + """,
r as (
  select 'adult' as dataset, row_id, split, source from adult where split in ('val', 'tst') and len(features) = 123
  union all
  select 'ijcnn1', row_id, split, source from ijcnn1 where split in ('val', 'tst') and len(features) = 22 and label is not null),
c as (select dataset, other, max(1 - n_diff / n) as coverage from p group by dataset, other)
select r.dataset, split, source, count(*) as n_records, count(coverage) as n_overlapping,
  count(*) filter (coverage = 1) as n_exact, avg(coverage) as mean_coverage
from r left join c on r.dataset = c.dataset and r.row_id = c.other group by r.dataset, split, source""",
    "p2_members": _P2 + _P2_CONTENT + "select dataset, row_id, held, rep from m",
    "p2_pairs": _P2
    + _P2_CONTENT
    + """select distinct p.dataset, a.rep as rep_a, b.rep as rep_b, n_diff from p
join m a on a.dataset = p.dataset and a.row_id = trn join m b on b.dataset = p.dataset and b.row_id = other""",
    "p1_counts": _P1 + "select dataset, col, n_entries, n_records, mark from m",
    "p1_found": _P1 + "select dataset, col, mark from m where mark is not null",
    "p6_found": """
with w as (
  select doc_id as id, 0 as side, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') as w from documents
  union all
  select item_id, 1, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') from eval_items),
g as (
  select id, side, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) as gram
  from w where len(w) >= 10)
select distinct d.id as doc_id, i.id as item_id from g d join g i on d.gram = i.gram where d.side = 0 and i.side = 1""",
    "p6_kinds": """
with t as (
  select doc_id as id, 0 as side, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') as w from documents
  union all
  select item_id, 1, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') from eval_items),
dw as (select id as doc_id, unnest(w) as word, unnest(range(0, len(w))) as p from t where side = 0),
df as (select word, count(distinct doc_id) as df from dw group by word),
iw as (select id as item_id, unnest(w) as word, unnest(range(0, len(w))) as p, len(w) as n from t where side = 1 and len(w) >= 10),
win as (
  select b.item_id, b.p as a0, i.p, i.word, coalesce(df, 0) as df
  from iw b join iw i on b.item_id = i.item_id and i.p between b.p and b.p + 9 left join df on df.word = i.word where b.p <= b.n - 10),
rk as (
  select *, row_number() over (partition by item_id, a0 order by df, p) as r, min(df) over (partition by item_id, a0) as low from win),
pas as (
  select distinct item_id, max(word) filter (r = 1) as w1, max(word) filter (r = 2) as w2, max(word) filter (r = 3) as w3, max(word) filter (r = 4) as w4
  from rk where low > 0 group by item_id, a0),
h1 as (select pas.*, d.doc_id, d.p from pas join dw d on d.word = w1),
h2 as (select * from h1 where exists (select 1 from dw d where d.doc_id = h1.doc_id and d.word = w2 and d.p between h1.p - 20 and h1.p + 20)),
h3 as (select * from h2 where exists (select 1 from dw d where d.doc_id = h2.doc_id and d.word = w3 and d.p between h2.p - 20 and h2.p + 20)),
h4 as (select distinct doc_id, item_id from h3 where exists (select 1 from dw d where d.doc_id = h3.doc_id and d.word = w4 and d.p between h3.p - 20 and h3.p + 20)),
g as (
  select id, side, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) as gram from t where len(w) >= 10),
ph as (select distinct d.id as doc_id, i.id as item_id from g d join g i on d.gram = i.gram where d.side = 0 and i.side = 1)
select doc_id, item_id, 'phrase' as kind from ph
union all select doc_id, item_id, 'proximity' from h4 anti join ph using (doc_id, item_id)""",
    "p8_found": _P8
    + """
select doc_id, 'few_words' as failed from s where n_words < 25
union all select doc_id, 'word_length' from s where n_words > 0 and (n_letters / n_words < 3.5 or n_letters / n_words > 7.5)
union all select doc_id, 'symbols' from s where n_visible > 0 and n_symbols / n_visible > 0.2::double
union all select doc_id, 'line_ends' from s where n_lines > 0 and n_ended / n_lines < 0.2::double
union all select doc_id, 'common_words' from s where n_words > 0 and lang2 is not null and n_common / n_words < 0.25""",
    "p5_found": """
with v as (
  select row_id, features as f from covtype
  where len(features) = 54 and len(list_filter(features, lambda x: x is null or isnan(x))) = 0),
d as (
  select a.row_id as a, b.row_id as b, list_distance(a.f, b.f) as dist
  from v a join v b on a.row_id <> b.row_id),
n as (select *, row_number() over (partition by a order by dist, b) as rn from d)
select distinct least(a, b) as row_a, greatest(a, b) as row_b from n where rn <= 5 and dist <= 0.03""",
    "p5_neighbours": """
with v as (
  select row_id, features as f from covtype
  where len(features) = 54 and len(list_filter(features, lambda x: x is null or isnan(x))) = 0),
d as (
  select a.row_id, b.row_id as neighbour, list_distance(a.f, b.f) as dist
  from v a join v b on a.row_id <> b.row_id where a.row_id % 50 = 0),
n as (select *, row_number() over (partition by row_id order by dist, neighbour)::int as rank from d)
select row_id, rank, neighbour, round(dist, 9) as dist from n where rank <= 10""",
    "p8_counts": _P8 + "select doc_id, n_words, n_letters, n_visible, n_symbols, n_lines, n_ended, n_common from s",
    "p4_sizes": """
select plan_id, least(k, count(distinct row_id)) as n, least(k, count(distinct row_id)) as records
from sample_plan p join kdd2010 r on (p.split is null or p.split = r.split) and (p.learner_id is null or p.learner_id = r.learner_id)
where row_id is not null and k > 0 group by plan_id, k""",
    "p4_members": """
select plan_id, least(k, count(distinct row_id)) as n
from sample_plan p join kdd2010 r on (p.split is null or p.split = r.split) and (p.learner_id is null or p.learner_id = r.learner_id)
where row_id is not null and k > 0 group by plan_id, k""",
    "p7_kept": """
with s as (
  select plan_id, regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') as source, sum(greatest(coalesce(weight, 0), 0)) as weight, min(max_repeats) as cap
  from mix_targets where source is not null group by 1, 2),
d as (select distinct regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') as source from documents where text <> '' and source is not null)
select plan_id, source, round(weight / sum(weight) over (partition by plan_id), 6) as target_share,
  weight > 0 and coalesce(cap, 1) > 0 and source in (from d) as used, true as close, true as capped
from s""",
}
