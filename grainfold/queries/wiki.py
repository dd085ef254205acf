"""Queries over the knowledge base: retrieval, snapshots, directories, links, removals, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.functions import paths, text
from grainfold.operators import retrieval, wiki
from grainfold.plans.runtime import once, spread, table

QUESTION = "Which central registry keeps the nightly archive of the turbine label?"
SNAPSHOT_CUT = "2024-07-01 00:00:00"
REMOVED, REMOVED_TOO = "tables/logistics", "playbooks"
LOG_DATE = "2026-01-01"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.current(table(spark, sf_dir, "concepts"))


def concept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return concepts(spark, sf_dir).select(F.col("concept_id").alias("key"), F.concat_ws(" ", blank("title"), blank("description"), tags, blank("body")).alias("text"))


def retrieve_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(documents(spark, sf_dir), QUESTION, 10)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def retrieve_concepts_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(concept_texts(spark, sf_dir), QUESTION, 10)
    return found.select(F.col("key").alias("concept_id"), F.round("score", 6).alias("score"))


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequencies(documents(spark, sf_dir))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents(spark, sf_dir)
    df = term_document_frequency(spark, sf_dir)
    return df.select("term", F.round(retrieval.inverse(corpus.count()), 6).alias("idf"))


def doc_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.norms(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), F.round("norm", 4).alias("norm"))


def tokenize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return documents(spark, sf_dir).where("text is not null").select(F.col("key").alias("doc_id"), F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.snapshot(concepts(spark, sf_dir))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "concepts")
    before = wiki.current(every.where(F.col("loaded_at") < F.lit(SNAPSHOT_CUT).cast("timestamp")))
    return wiki.diff(wiki.snapshot(before), wiki.snapshot(wiki.current(every)))


def snapshot_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.alive(table(spark, sf_dir, "concepts"), table(spark, sf_dir, "removals"))


def structure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.types_in_use(concepts(spark, sf_dir))


def structure_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.directories(table(spark, sf_dir, "concepts").where("concept_id is not null"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "concepts").where("concept_id is not null").select("concept_id").distinct()


def index_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.index_dirs(ids(spark, sf_dir))


def child_subdirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.child_dirs(index_dirs(spark, sf_dir))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.index_pages(concepts(spark, sf_dir))


def dir_index_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_pages(spark, sf_dir).where("dir <> ''")


def root_index_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_pages(spark, sf_dir).where("dir = ''").select("markdown")


def orphan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of archived files and of all concepts ever loaded, taken as having index pages, that no living concept needs."""
    every = table(spark, sf_dir, "concepts").where("concept_id is not null").select("concept_id")
    filed = table(spark, sf_dir, "input_files").where("relative_path is not null").select(F.col("relative_path").alias("concept_id"))
    return wiki.orphan_indexes(wiki.index_dirs(every.union(filed)), snapshot_survivors(spark, sf_dir))


def emptied_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that vanish with all concepts of two of them."""
    gone = F.startswith("concept_id", F.lit(REMOVED + "/")) | F.startswith("concept_id", F.lit(REMOVED_TOO + "/"))
    every = ids(spark, sf_dir)
    return wiki.ordered_dirs(wiki.emptied_dirs(every.where(gone), every.where(~gone)))


def wiki_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).select(F.concat(F.lit("wiki/"), "concept_id", F.lit(".md")).alias("path"))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spread(table(spark, sf_dir, "incoming_links").select("link_id", "from_concept_id", "to_concept_id"))
    return links.select("link_id", paths.concept_of_link(F.col("to_concept_id"), paths.directory(F.col("from_concept_id"))).alias("concept_id"))


def concept_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "retrieved_concepts")
    return wiki.markdown_links(hits, "hit_id", "content_text", "concept_id").groupBy("hit_id", "concept_id").agg(F.count("*").alias("n"))


def incoming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "incoming_links").select("from_concept_id", "to_concept_id")
    return wiki.ordered_links(wiki.incoming(links, table(spark, sf_dir, "removals")))


def removal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spread(table(spark, sf_dir, "incoming_links").select("from_concept_id", "to_concept_id"))
    target = F.coalesce(paths.concept_of_link(F.col("to_concept_id"), paths.directory(F.col("from_concept_id"))), "to_concept_id")
    resolved = once(links, "target", target).select("from_concept_id", F.col("target").alias("to_concept_id"))
    return wiki.removal_plan(ids(spark, sf_dir), resolved, REMOVED)


def trust_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.trust(table(spark, sf_dir, "actor_events"))


def render_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.rendered(concepts(spark, sf_dir), table(spark, sf_dir, "actor_events"), table(spark, sf_dir, "source_entries"))


def query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best concepts as a model gets to read them, one row each in order of rank."""
    best = retrieval.retrieve(concept_texts(spark, sf_dir), QUESTION, 10).withColumnRenamed("key", "concept_id")
    shown = best.join(render_concept(spark, sf_dir), "concept_id")
    return shown.select("concept_id", F.round("score", 6).alias("score"), "content")


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_entries").where("title is not null").select("entry_id", text.slug(F.col("title"), F.coalesce("resource", F.lit(""))).alias("slug"))


def status_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = text.migrated_status(F.col("status"))
    return table(spark, sf_dir, "concepts").where(changed.isNotNull()).select("row_id", changed.alias("status"))


def ground_truth_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits quote their concept's title or, else, its description."""
    about = concepts(spark, sf_dir).select("concept_id", F.array("title", "description").alias("alternatives"))
    hits = table(spark, sf_dir, "retrieved_concepts").where("content_text is not null").join(about, "concept_id")
    found = F.exists(F.filter("alternatives", lambda a: F.coalesce(a, F.lit("")) != ""), lambda a: F.contains(text.matchable(F.col("content_text")), text.matchable(a)))
    return hits.agg(F.count_if(found).alias("found"), F.count("*").alias("expected"))


def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "input_files").select("file_id", text.column_name(F.col("file_id") + 1).alias("name"))


def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "extracted_parts").select("part_row", F.explode(F.split("part_text", "\n")).alias("line"))
    return lines.where(text.is_section_label(F.col("line"))).groupBy("part_row").agg(F.count("*").alias("n"))


def normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "concepts").where("title is not null").select("row_id", text.matchable(F.col("title")).alias("title"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [retrieve_top10, retrieve_concepts_top10, term_document_frequency, term_idf, doc_norms, tokenize_distinct, snapshot_hash, snapshot_diff, snapshot_survivors, structure_types, structure_directories, index_dirs, child_subdirs, dir_index_md, root_index_md, orphan_index, emptied_directories, wiki_tree, link_targets, concept_links, incoming_links, removal_plan, trust_tier, render_concept, query_context, slugify, status_migration, ground_truth_recall, column_names, section_labels, normalize_match]
    return {f.__name__: f for f in found}


TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 2)"
CURRENT = "cur as (select * exclude (rn) from (select *, row_number() over (partition by concept_id order by loaded_at desc, row_id desc) as rn from concepts where concept_id is not null) where rn = 1)"
IDS = "ids as (select distinct concept_id from concepts where concept_id is not null)"
DIR = "case when {0} like '%/%' then regexp_replace({0}, '/[^/]*$', '') else '' end"
ANCESTORS = "unnest(list_concat([''], list_transform(range(1, length(string_split({0}, '/')) + 1), lambda i: array_to_string(string_split({0}, '/')[1:i], '/'))))"
ALIVE = "alive as (select l.concept_id from (select concept_id, max(loaded_at) as t from concepts where concept_id is not null group by 1) l left join (select concept_id, max(removed_at) as r from removals group by 1) g using (concept_id) where r is null or t > r)"


def tfidf(corpus: str) -> str:
    asked = TOKENS.format("'" + QUESTION + "'")
    return f"""
corpus as ({corpus}),
tf as (select key, term, count(*) as tf from (select key, unnest({TOKENS.format('text')}) as term from corpus) group by all),
n as (select count(*) as n from corpus),
df as (select term, count(*) as df from tf group by 1),
idf as (select term, ln((n + 1) / (df + 1)) + 1 as idf from df cross join n),
q as (select term, count(*) as qtf from (select unnest({asked}) as term) group by 1),
qw as (select term, qtf * coalesce(idf, ln(n + 1) + 1) as qw from q left join idf using (term) cross join n),
scored as (
  select key, sum(tf * idf * coalesce(qw, 0)) / (sqrt(sum((tf * idf) ^ 2)) * (select sqrt(sum(qw * qw)) from qw)) as score
  from tf join idf using (term) left join qw using (term) group by key having sum(coalesce(qw, 0)) > 0
)"""


DOCUMENTS = "select doc_id as key, text from documents"
CONCEPT_TEXTS = "select concept_id as key, coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(array_to_string(tags, ' '), '') || ' ' || coalesce(body, '') as text from cur"
RESOLVE = r"""
t as (select *, regexp_replace(to_concept_id, '^\s+|\s+$', '', 'g') as a from incoming_links),
u as (select *, regexp_replace(case when a like '<%>' then substr(a, 2, length(a) - 2) else a end, '^\s+|\s+$', '', 'g') as b from t),
p as (select *, split_part(split_part(url_decode(b), '#', 1), '?', 1) as c from u),
f as (select *, list_reduce(list_prepend('', string_split(case when c like '/%' or from_concept_id not like '%/%' then c else regexp_replace(from_concept_id, '/[^/]*$', '') || '/' || c end, '/')),
  lambda x, s: case when x = '!' then '!' when s in ('', '.') then x when s = '..' then case when x = '' then '!' else regexp_replace(x, '/[^/]*$', '') end else x || '/' || s end) as d from p),
resolved as (select link_id, from_concept_id, to_concept_id, case when b <> '' and not regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*:') and d <> '!' and d like '%.md' then regexp_replace(regexp_replace(substr(d, 2), '^wiki/', ''), '\.md$', '') end as concept_id from f)"""


def oracle_sql() -> dict[str, str]:
    dirs = f"dirs as (select distinct {ANCESTORS.format('own')} as dir from (select distinct {DIR.format('concept_id')} as own from ids) where own <> '' and not regexp_matches(own, '^(archive|trash)(/|$)') union select '')"
    last = "regexp_replace({0}, '^.*/', '')"
    children = f"kids as (select {DIR.format('dir')} as dir, dir as child from dirs where dir <> '')"
    pages = f"""
with {CURRENT}, ids as (select concept_id from cur), {dirs}, {children},
lines as (
  select dir, 0 as part, child as key, '* [' || {last.format('child')} || '/](' || {last.format('child')} || '/)' as line from kids
  union all select {DIR.format('concept_id')}, 1, concept_id, '* [' || coalesce(title, {last.format('concept_id')}) || '](' || {last.format('concept_id')} || '.md)' || case when coalesce(description, '') <> '' then ' - ' || description else '' end from cur
),
listed as (select dir, string_agg(line, chr(10) order by key) filter (where part = 0) as subs, string_agg(line, chr(10) order by key collate en, key) filter (where part = 1) as own from dirs left join lines using (dir) group by dir),
pages as (select dir, case when dir = '' then '---' || chr(10) || 'okf_version: "0.2"' || chr(10) || '---' || chr(10) || chr(10) else '' end || '# ' || case when dir = '' then 'Wiki' else {last.format('dir')} end || ' Index' || chr(10) || chr(10) || coalesce(subs || chr(10) || chr(10), '') || coalesce(own || chr(10), '') as markdown from listed)
"""
    above = "select distinct " + ANCESTORS.format("d") + " as dir from (select distinct " + DIR.format("concept_id") + " as d from {0}) where d <> ''"
    doomed = f"concept_id like '{REMOVED}/%' or concept_id like '{REMOVED_TOO}/%'"
    # Prose lines by a state that goes from line to line: the open fence, and the lines outside of fences so far.
    prose = r"""
texts as (select hit_id, concept_id as origin, list_transform(string_split(replace(content_text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: {'fence': l, 'kept': []::varchar[]}) as lines from retrieved_concepts where contains(content_text, '](') or contains(content_text, ']:')),
marked as (select hit_id, origin, list_reduce(list_prepend({'fence': '', 'kept': []::varchar[]}, lines), lambda a, x: {
  'fence': case when a.fence = '' then regexp_extract(x.fence, '^\s*(`{3,}|~{3,})', 1) when starts_with(regexp_extract(x.fence, '^\s*(`{3,}|~{3,})', 1), a.fence) then '' else a.fence end,
  'kept': case when a.fence = '' and regexp_extract(x.fence, '^\s*(`{3,}|~{3,})', 1) = '' then list_append(a.kept, x.fence) else a.kept end}).kept as kept from texts),
named as (select hit_id, origin, unnest(list_concat(regexp_extract_all(l, '\]\([ ]*(<[^<>]*>|[^\s()<>]*)[^()]*\)', 1), regexp_extract_all(l, '^[ \t]{0,3}\[[^\[\]]+\]:[ \t]*(<[^<>]*>|[^\s<]\S*)', 1))) as to_concept_id from (select hit_id, origin, unnest(kept) as l from marked)),
incoming_links as (select hit_id as link_id, coalesce(origin, '') as from_concept_id, to_concept_id from named)"""
    rendered = rf"""
gen as (select concept_id, actor_by, event_at from (select *, row_number() over (partition by concept_id order by recorded_at desc, event_id desc) as rn from actor_events where event_kind = 'generated') where rn = 1),
ver as (select concept_id, case when bool_or(coalesce(actor_by like 'human:%', false)) then 'human-reviewed' else 'machine-confirmed' end as tier, max(event_at) as latest from actor_events where event_kind = 'verified' and concept_id is not null group by 1),
src as (select concept_id, string_agg(coalesce(source_id, '(no id)') || ' -> ' || coalesce(resource, '(no resource)'), '; ' order by entry_pos nulls first, entry_id) as sources from source_entries group by 1),
shown as (
  select c.concept_id, '### ' || c.concept_id || chr(10) || chr(10) || array_to_string(list_filter([
    'type: ' || coalesce(concept_type, '(untyped)'),
    case when title <> '' then 'title: ' || title end, case when description <> '' then 'description: ' || description end,
    case when len(list_filter(tags, lambda x: coalesce(x, '') <> '')) > 0 then 'tags: [' || array_to_string(list_filter(tags, lambda x: coalesce(x, '') <> ''), ', ') || ']' end, case when status <> '' then 'status: ' || status end,
    case when len(list_filter(supersedes, lambda x: coalesce(x, '') <> '')) > 0 then 'supersedes: [' || array_to_string(list_filter(supersedes, lambda x: coalesce(x, '') <> ''), ', ') || ']' end,
    case when g.concept_id is not null then 'generated: by ' || coalesce(actor_by, '(unknown)') || ' at ' || coalesce(event_at, '(unknown)') when fm_timestamp <> '' then 'timestamp: ' || fm_timestamp || ' (legacy v0.1)' end,
    case when tier is not null then 'verified: ' || tier || coalesce(' (latest ' || latest || ')', '') end, 'sources: ' || sources], lambda x: x is not null), chr(10))
    || chr(10) || chr(10) || regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g') as content
  from cur c left join gen g using (concept_id) left join ver v using (concept_id) left join src s using (concept_id)
)"""
    return {
        "retrieve_top10": f"with {tfidf(DOCUMENTS)} select key as doc_id, round(score, 6) as score from scored order by scored.score desc, key limit 10",
        "retrieve_concepts_top10": f"with {CURRENT}, {tfidf(CONCEPT_TEXTS)} select key as concept_id, round(score, 6) as score from scored order by scored.score desc, key limit 10",
        "term_document_frequency": f"with {tfidf(DOCUMENTS)} select term, df from df",
        "term_idf": f"with {tfidf(DOCUMENTS)} select term, round(idf, 6) as idf from idf",
        "doc_norms": f"with {tfidf(DOCUMENTS)} select key as doc_id, round(sqrt(sum((tf * idf) ^ 2)), 4) as norm from tf join idf using (term) group by key",
        "tokenize_distinct": f"select doc_id, length(t)::bigint as n_tokens, length(list_distinct(t))::bigint as n_distinct from (select doc_id, {TOKENS.format('text')} as t from documents where text is not null)",
        "snapshot_hash": f"with {CURRENT} select concept_id, sha1(coalesce(body, '')) as hash from cur",
        "snapshot_diff": f"""with {CURRENT}, old as (select * from (select *, row_number() over (partition by concept_id order by loaded_at desc, row_id desc) as rn from concepts where concept_id is not null and loaded_at < timestamptz '{SNAPSHOT_CUT}+00') where rn = 1)
select concept_id, case when o.row_id is null then 'created' else 'updated' end as change from cur c left join old o using (concept_id) where o.row_id is null or coalesce(o.body, '') <> coalesce(c.body, '')""",
        "snapshot_survivors": f"with {ALIVE} select * from alive",
        "structure_types": f"with {CURRENT} select coalesce(concept_type, '(untyped)') as type, count(*) as n from cur group by 1",
        "structure_directories": f"with {IDS} select distinct dir from (select {DIR.format('concept_id')} as dir from ids) where dir <> ''",
        "index_dirs": f"with {IDS}, {dirs} select dir from dirs",
        "child_subdirs": f"with {IDS}, {dirs}, {children} select * from kids",
        "dir_index_md": pages + "select dir, markdown from pages where dir <> ''",
        "root_index_md": pages + "select markdown from pages where dir = ''",
        "orphan_index": f"with {ALIVE}, every as (select concept_id from concepts where concept_id is not null union select relative_path from input_files where relative_path is not null) select dir from ({above.format('every')}) where not regexp_matches(dir, '^(archive|trash)(/|$)') and dir <> '' and dir not in ({above.format('alive')})",
        "emptied_directories": f"with {IDS}, dead as (select concept_id from ids where {doomed}), living as (select concept_id from ids where not ({doomed})) select dir from ({above.format('dead')}) where dir <> '' and dir not in ({above.format('living')})",
        "wiki_tree": f"with {IDS} select 'wiki/' || concept_id || '.md' as path from ids",
        "link_targets": f"with {RESOLVE} select link_id, concept_id from resolved",
        "concept_links": f"with {prose}, {RESOLVE} select link_id as hit_id, concept_id, count(*) as n from resolved where concept_id is not null group by 1, 2",
        "incoming_links": "select distinct from_concept_id, to_concept_id from incoming_links where to_concept_id in (select concept_id from removals) and from_concept_id not in (select concept_id from removals)",
        "removal_plan": f"""with {IDS}, {RESOLVE}, doomed as (select concept_id from ids where concept_id like '{REMOVED}/%'), living as (select concept_id from ids where concept_id not like '{REMOVED}/%')
select 'concept' as kind, concept_id as subject, '' as object from doomed
union all select 'directory', dir, '' from ({above.format('doomed')}) where dir <> '' and dir not in ({above.format('living')})
union all select distinct 'link', from_concept_id, coalesce(concept_id, to_concept_id) from resolved where coalesce(concept_id, to_concept_id) in (select concept_id from doomed) and from_concept_id not in (select concept_id from doomed)""",
        "trust_tier": f"with {CURRENT}, {rendered} select concept_id, tier, latest from ver",
        "render_concept": f"with {CURRENT}, {rendered} select * from shown",
        "query_context": f"with {CURRENT}, {rendered}, {tfidf(CONCEPT_TEXTS)}, best as (select key as concept_id, score from scored order by score desc, key limit 10) select concept_id, round(score, 6) as score, content from best join shown using (concept_id)",
        "slugify": r"select entry_id, case when s = '' then 'source' else s end as slug from (select entry_id, regexp_replace(substr(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g') as s from source_entries where title is not null)",
        "status_migration": "select row_id, case lower(trim(status)) when 'current' then 'stable' else 'deprecated' end as status from concepts where lower(trim(status)) in ('current', 'superseded')",
        "ground_truth_recall": rf"""with {CURRENT}, m as (select regexp_replace(regexp_replace(lower(content_text), '(\d),(\d)', '\1.\2', 'g'), '\s+', '', 'g') as h, list_transform(list_filter([title, description], lambda x: coalesce(x, '') <> ''), lambda x: regexp_replace(regexp_replace(lower(x), '(\d),(\d)', '\1.\2', 'g'), '\s+', '', 'g')) as alts from retrieved_concepts r join cur using (concept_id) where content_text is not null)
select count(*) filter (where len(list_filter(alts, lambda a: contains(h, a))) > 0) as found, count(*) as expected from m""",
        "column_names": "with recursive r as (select file_id, file_id + 1 as n, '' as s from input_files union all select file_id, (n - 1) // 26, chr((65 + (n - 1) % 26)::int) || s from r where n > 0) select file_id, s as name from r where n = 0",
        "section_labels": r"select part_row, count(*) as n from (select part_row, unnest(string_split(part_text, chr(10))) as line from extracted_parts) where length(line) <= 100 and not regexp_matches(line, '[.!?;:]$') and regexp_matches(line, '\([^()]*\)$') and len(regexp_extract_all(line, '\S+')) between 3 and 14 group by 1",
        "normalize_match": r"select row_id, regexp_replace(regexp_replace(lower(title), '(\d),(\d)', '\1.\2', 'g'), '\s+', '', 'g') as title from concepts where title is not null",
    }
