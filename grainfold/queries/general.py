"""Queries of the general data problems: orphan references, drifting schemas, mixed timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators import drift, instants, orphans
from grainfold.functions.paths import trimmed
from grainfold.plans.runtime import cut, table


def all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.references(*(table(spark, sf_dir, t) for t in ("concepts", "incoming_links", "source_entries")))


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.life_events(*(table(spark, sf_dir, t) for t in ("concepts", "removals", "input_files")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference whose target doesn't exist at its instant."""
    return orphans.orphans(all_references(spark, sf_dir), all_events(spark, sf_dir)).select("ref_table", "ref_id", "ref_pos")


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table and month."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    refs = cut(all_references(spark, sf_dir))
    asked = refs.groupBy("ref_table", month).agg(F.count("*").alias("n_references"))
    missed = orphans.orphans(refs, all_events(spark, sf_dir)).groupBy("ref_table", month).agg(F.count("*").alias("n_orphans"))
    return asked.join(missed, ["ref_table", "month"], "left").select("ref_table", "month", "n_references", F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of layout between consecutive files of each feed."""
    return drift.changes(table(spark, sf_dir, "frontmatter_raw"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records under the latest names of their feed, in one form for all feeds."""
    raw = table(spark, sf_dir, "frontmatter_raw")
    return drift.unified(raw, drift.changes(raw, moving=True))


#: Columns with timestamps: table, key, column.
STAMPED = (("concepts", "row_id", "fm_timestamp"), ("source_entries", "entry_id", "last_modified"), ("actor_events", "event_id", "event_at"))


def p5_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded timestamp with its instant, or why it has none."""
    values = [table(spark, sf_dir, t).select(F.lit(t).alias("ref_table"), F.col(key).alias("ref_id"), F.col("bundle_id").alias("source"), F.col(c).alias("value")) for t, key, c in STAMPED]
    bundles = table(spark, sf_dir, "bundles").select(F.col("bundle_id").alias("source"), F.col("tz_name").alias("zone"), "date_order")
    return instants.instants(values[0].union(values[1]).union(values[2]), bundles)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every value that isn't written in the one plain form."""
    plain = trimmed(F.col("value")).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return p5_instants(spark, sf_dir).where((F.col("status") == "resolved") & ~plain).select("ref_table", "ref_id", "utc_us")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_by_month": p2_by_month, "p3_found": p3_found, "p3_table": p3_table, "p5_found": p5_found, "p5_instants": p5_instants}


REFERENCES = r"""
refs as (
  select 'concepts' as ref_table, row_id as ref_id, (generate_subscripts(supersedes, 1) - 1)::int as ref_pos, unnest(supersedes) as v, concept_id as origin, loaded_at as t from concepts
  union all select 'incoming_links', link_id, 0, to_concept_id, from_concept_id, seen_at from incoming_links
  union all select 'source_entries', entry_id, 0, resource, concept_id, recorded_at from source_entries
),
bare as (select * replace (case when b like '<%>' then substr(b, 2, length(b) - 2) else b end as v) from (select *, regexp_replace(v, '^\s+|\s+$', '', 'g') as b from refs)),
cut as (select *, split_part(split_part(url_decode(v), '#', 1), '?', 1) as p from bare where regexp_replace(v, '\s', '', 'g') <> '' and not regexp_matches(v, '^[A-Za-z]+:')),
folded as (
  select *, list_reduce(list_prepend('', string_split(case when p like '/%' or origin not like '%/%' then p else regexp_replace(origin, '/[^/]*$', '') || '/' || p end, '/')),
    lambda a, s: case when a = '!' then '!' when s in ('', '.') then a when s = '..' then case when a = '' then '!' else regexp_replace(a, '/[^/]*$', '') end else a || '/' || s end) as f
  from cut
),
placed as (select *, regexp_replace(substr(f, 2), '^wiki/', '') as path, f = '!' as outside from folded),
keyed as (
  select ref_table, ref_id, ref_pos, t, outside,
    case when outside then null when path like '%.md' then 'c:' || regexp_replace(path, '\.md$', '') when ref_table = 'source_entries' then 'f:' || path else 'c:' || v end as k
  from placed where (outside and (ref_table = 'source_entries' or p like '%.md')) or (not outside and (path like '%.md' or ref_table <> 'source_entries' or path like 'archive/%'))
),
events as (
  select 'c:' || concept_id as k, loaded_at as t, true as alive from concepts
  union all select 'c:' || concept_id, removed_at, false from removals
  union all select 'f:' || archive_path, received_at, true from input_files
),
judged as (select r.ref_table, r.ref_id, r.ref_pos, r.t, coalesce(arg_max(e.alive, e.t), false) as alive from keyed r left join events e on r.k = e.k and e.t <= r.t group by all)
"""


# Declared orders and zones hold, as no source of the tables contradicts its declaration; of two instants of one wall-clock time the first counts.
INSTANTS = r"""with v as (select 'concepts' as ref_table, row_id as ref_id, bundle_id, regexp_replace(fm_timestamp, '^\s+|\s+$', '', 'g') as t from concepts
  union all select 'source_entries', entry_id, bundle_id, regexp_replace(last_modified, '^\s+|\s+$', '', 'g') from source_entries
  union all select 'actor_events', event_id, bundle_id, regexp_replace(event_at, '^\s+|\s+$', '', 'g') from actor_events),
w as (select v.*, tz_name, date_order from v left join bundles using (bundle_id) where t is not null and not regexp_matches(t, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$')),
d as (select *,
  case when regexp_matches(t, '^\d{4}-\d{2}-\d{2}([Tt ]|$)') then [t[1:4], t[6:7], t[9:10], t[12:]]
    when regexp_matches(t, '^\d{8}[Tt]\d{6}') then [t[1:4], t[5:6], t[7:8], t[10:11] || ':' || t[12:13] || ':' || t[14:]]
    when regexp_matches(t, '^([A-Za-z]{3}, +)?\d{1,2} +[A-Za-z]{3,9} +\d{4}') then [regexp_extract(t, '^[^0-9]*\d+ +[A-Za-z]+ +(\d{4})', 1), regexp_extract(t, '^[^0-9]*\d+ +([A-Za-z]+)', 1), regexp_extract(t, '^[^0-9]*(\d+)', 1), regexp_extract(t, '^[^0-9]*\d+ +[A-Za-z]+ +\d{4},? *(.*)$', 1)]
    when regexp_matches(t, '^[A-Za-z]{3,9} \d{1,2}, \d{4}') then [regexp_extract(t, ', (\d{4})', 1), regexp_extract(t, '^([A-Za-z]+)', 1), regexp_extract(t, '^[A-Za-z]+ (\d+)', 1), regexp_extract(t, ', \d{4},? *(.*)$', 1)]
    when regexp_matches(t, '^\d{1,2}\.\d{1,2}\.\d{4}') or (regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}') and date_order = 'dmy') then [regexp_extract(t, '^\d+.\d+.(\d{4})', 1), regexp_extract(t, '^\d+.(\d+)', 1), regexp_extract(t, '^(\d+)', 1), regexp_extract(t, '^\d+.\d+.\d{4},? *(.*)$', 1)]
    when regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}') then [regexp_extract(t, '^\d+.\d+.(\d{4})', 1), regexp_extract(t, '^(\d+)', 1), regexp_extract(t, '^\d+.(\d+)', 1), regexp_extract(t, '^\d+.\d+.\d{4},? *(.*)$', 1)] end as f
  from w),
c as (select *, try_cast(coalesce((map {'jan': 1, 'feb': 2, 'mar': 3, 'apr': 4, 'may': 5, 'jun': 6, 'jul': 7, 'aug': 8, 'sep': 9, 'oct': 10, 'nov': 11, 'dec': 12})[lower(f[2])[1:3]]::varchar, f[2]) as int) as mon, regexp_extract(f[4], '^(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?([AaPp][Mm])? ?(.*)$', ['h', 'm', 's', 'us', 'half', 'zone']) as k from d),
z as (select *, regexp_replace(k.zone, '\[.*\]$', '') as zone, try_cast(nullif(k.h, '') as int) as h from c),
l as (select *, case when f[4] <> '' and k.h = '' then null else try_cast(lpad(f[1], 4, '0') || '-' || lpad(mon::varchar, 2, '0') || '-' || lpad(f[3], 2, '0') || ' ' || lpad((case when k.half = '' then coalesce(h, 0) when h > 12 or h < 1 then 99 else h % 12 + (case when lower(k.half) = 'pm' then 12 else 0 end) end)::varchar, 2, '0') || ':' || coalesce(nullif(k.m, ''), '00') || ':' || coalesce(nullif(k.s, ''), '00') as timestamp) end as local, coalesce(try_cast(rpad(nullif(k.us, ''), 6, '0')[1:6] as bigint), 0) as us from z),
o as (select *, case when zone = '' then null when upper(zone) in ('Z', 'UTC', 'GMT', 'WET') then 0 when upper(zone) in ('CET', 'BST', 'WEST', 'IST') then 60 when upper(zone) in ('CEST', 'EET') then 120 when upper(zone) in ('EEST', 'MSK') then 180 when upper(zone) = 'EDT' then -240 when upper(zone) in ('EST', 'CDT') then -300 when upper(zone) in ('CST', 'MDT') then -360 when upper(zone) in ('MST', 'PDT') then -420 when upper(zone) = 'PST' then -480
   when regexp_matches(zone, '^[+-]\d{2}:?\d{2}$') then (case when zone[1] = '-' then -1 else 1 end) * (zone[2:3]::int * 60 + zone[-2:]::int) else 9999 end as off from l),
u as (select ref_table, ref_id, case when regexp_matches(t, '^\d{9,11}$') then t::bigint * 1000000 when regexp_matches(t, '^\d{12,14}$') then t::bigint * 1000 when regexp_matches(t, '^\d{15,17}$') then t::bigint
  when local is null or off = 9999 then null when off is not null then epoch_us(local) + us - off * 60000000::bigint when timezone(tz_name, timezone(tz_name, local) - interval 1 hour) = local then epoch_us(timezone(tz_name, local)) - 3600000000 + us else epoch_us(timezone(tz_name, local)) + us end as utc_us from o)
select ref_table, ref_id, utc_us from u where utc_us is not null"""


CHANGES = r"""with raw as (select feed_id, file_no, raw_json as j, row_number() over () as rid from frontmatter_raw where feed_id is not null and file_no is not null),
good as (select *, json_extract_string(j, '$.concept') as concept from raw where case when json_valid(j) then json_type(j) = 'OBJECT' else false end),
nodes as (select feed_id, file_no, rid, concept, t.id, replace(regexp_replace(regexp_replace(t.fullkey, '^\$\.', ''), '\[\d+\]', '[]', 'g'), '"', '') as path,
  case t.type when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' else 'number' end as type, t.value::varchar as value
  from good, json_tree(j) t where t.fullkey <> '$' and t.type <> 'NULL'),
layout as (select feed_id, file_no, path, list_sort(list(distinct type)) as types from nodes group by all),
pairs as (select feed_id, file_no, lag(file_no) over (partition by feed_id order by file_no) as before from (select distinct feed_id, file_no from raw)),
gone as (select p.*, o.path, o.types from pairs p join layout o on o.feed_id = p.feed_id and o.file_no = p.before left join layout n on n.feed_id = p.feed_id and n.file_no = p.file_no and n.path = o.path where n.path is null),
come as (select p.*, n.path, n.types from pairs p join layout n on n.feed_id = p.feed_id and n.file_no = p.file_no left join layout o on o.feed_id = p.feed_id and o.file_no = p.before and o.path = n.path where o.path is null and p.before is not null),
kept as (select p.*, o.path from pairs p join layout o on o.feed_id = p.feed_id and o.file_no = p.before join layout n on n.feed_id = p.feed_id and n.file_no = p.file_no and n.path = o.path where n.types <> o.types),
vals as (select feed_id, file_no, concept, path, min(v) as v from (select feed_id, file_no, rid, concept, path, list(value order by id)::varchar as v from nodes where concept is not null group by all) group by all),
renamed as (select g.feed_id, g.file_no, g.path, c.path as new_path from gone g join come c on c.feed_id = g.feed_id and c.file_no = g.file_no and c.types = g.types and regexp_replace(c.path, '[^.\[]*$|\[\]$', '') = regexp_replace(g.path, '[^.\[]*$|\[\]$', '') and g.path not like '%[]'
  join vals a on a.feed_id = g.feed_id and a.file_no = g.before and a.path = g.path join vals b on b.feed_id = g.feed_id and b.file_no = g.file_no and b.path = c.path and b.concept = a.concept
  group by all having count(*) >= 2 and bool_and(a.v = b.v)),
found as (select feed_id, file_no, path as field_path, 'retyped' as change_kind, '' as new_path from kept
  union all select feed_id, file_no, path, 'renamed', new_path from renamed
  union all select feed_id, file_no, path, 'removed', '' from gone where (feed_id, file_no, path) not in (select (feed_id, file_no, path) from renamed)
  union all select feed_id, file_no, path, 'added', '' from come where (feed_id, file_no, path) not in (select (feed_id, file_no, new_path) from renamed)),
above as (select feed_id, file_no, field_path as path from found union select feed_id, file_no, new_path from found where new_path <> '')
select feed_id, file_no::int as file_no, field_path, change_kind, new_path from found f where not exists (select 1 from above a where a.feed_id = f.feed_id and a.file_no = f.file_no and (starts_with(f.field_path, a.path || '.') or starts_with(f.field_path, a.path || '[]')))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": CHANGES,
        "p5_found": INSTANTS,
        "p2_found": f"with {REFERENCES} select ref_table, ref_id, ref_pos from judged where not alive",
        "p2_by_month": f"with {REFERENCES} select ref_table, strftime(t at time zone 'UTC', '%Y-%m') as month, count(*) as n_references, count(*) filter (where not alive) as n_orphans from judged group by all",
    }
