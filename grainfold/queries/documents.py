"""Queries over whole documents: front matter, migration, link rewriting, extraction, streams."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.functions import frontmatter
from grainfold.operators import rewrite
from grainfold.plans.runtime import ensure_checkpoint_dir, table
from grainfold.queries.wiki import concepts
from grainfold.sources import files as file_source
from grainfold.streaming import ingest

STAMP = "2026-01-01-0000"


def quoted(c: Column) -> Column:
    """A text as a double-quoted YAML scalar."""
    made = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(made, F.lit(6), F.char_length(made) - 6))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current concepts as documents of the older format."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), quoted(c))
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.concat(F.lit("  - "), quoted(t))), "\n")))
    head = F.concat_ws("\n", line("type", given("concept_type")), line("title", given("title")), tags, line("timestamp", given("fm_timestamp")), line("status", given("status")))
    return concepts(spark, sf_dir).select("concept_id", F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("content"))


def parse_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frontmatter.parse_documents(pages(spark, sf_dir), "concept_id", "content")
    return f.select("concept_id", "frontmatter.type", "frontmatter.title", "frontmatter.status", F.size("frontmatter.tags").cast("bigint").alias("n_tags"))


def migrate_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = frontmatter.parse_documents(rewrite.migrated(pages(spark, sf_dir)), "concept_id", "content")
    return new.select("concept_id", "frontmatter.status", F.col("frontmatter.generated.at").alias("generated_at"), "frontmatter.timestamp")


def rewrite_archive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each directory of the input that cites its files, after they were archived under stamped names."""
    f = table(spark, sf_dir, "input_files").where("relative_path is not null")
    docs = f.select(F.concat(F.lit("files/"), F.col("file_id").cast("string")).alias("concept_id"), F.concat(F.lit("See [it](/archive/"), "relative_path", F.lit(") and /archive/none.txt.")).alias("content"))
    mapping = f.select(F.col("relative_path").alias("old"), F.concat("relative_path", F.lit(f".{STAMP}")).alias("new"))
    return rewrite.rewrite_archive_links(docs, mapping)


def rewrite_removed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all links of a concept, redirected where the linked concept was removed."""
    links = table(spark, sf_dir, "incoming_links").where("from_concept_id is not null and to_concept_id is not null")
    target = F.when(F.col("to_concept_id").contains(".md"), F.col("to_concept_id")).otherwise(F.concat(F.lit("/"), "to_concept_id", F.lit(".md")))
    line = F.concat(F.lit("* ["), F.coalesce("link_label", F.lit("link")), F.lit("](<"), F.regexp_replace(F.trim(target), "[<>]", ""), F.lit(">)"))
    docs = links.select(F.concat_ws("/", "from_concept_id", F.floor(F.col("link_id") / 100).cast("string")).alias("concept_id"), "link_id", line.alias("line"))
    docs = docs.groupBy("concept_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("link_id", "line"))), lambda x: x["line"]), "\n").alias("content"))
    mapping = table(spark, sf_dir, "removals").select(F.col("concept_id").alias("old"), F.concat(F.lit("/"), F.coalesce("trash_path", F.lit("trash"))).alias("new"))
    return rewrite.rewrite_removed_links(docs, mapping)


def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records of each feed's file as one JSON Lines document, extracted into parts."""
    raw = table(spark, sf_dir, "frontmatter_raw").where("raw_json is not null")
    name = F.concat_ws("/", "feed_id", F.concat(F.col("file_no").cast("string"), F.lit(".jsonl")))
    docs = raw.groupBy(name.alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("raw_id", "raw_json"))), lambda x: x["raw_json"]), "\n").cast("binary").alias("data"))
    found = file_source.extract_documents(docs.withColumn("name", F.col("path")), "path", "name", "data")
    return found.select("path", "source_format", F.size("parts").cast("bigint").alias("n_parts"), F.size(F.regexp_extract_all(F.array_join("parts", "\n"), F.lit(r"(?m)^## Record \d+$"), F.lit(0))).cast("bigint").alias("n_records"), F.size("warnings").cast("bigint").alias("n_warnings"))


def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted part read once more as HTML, block by block."""
    docs = table(spark, sf_dir, "extracted_parts").where("part_text is not null").select("part_row", F.lit("part.html").alias("name"), F.col("part_text").cast("binary").alias("data"))
    found = file_source.extract_documents(docs, "part_row", "name", "data")
    return found.select("part_row", "reason", F.element_at("parts", 1).alias("text"))


def stream_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per target and window of 30 days, counted by a stream that takes what there is and stops."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "incoming_links").schema
    # A table may be a folder of files or a single file; a stream reads folders.
    reader = spark.readStream.schema(schema)
    whole = f"{sf_dir}/incoming_links.parquet"
    links = reader.parquet(whole) if os.path.isdir(whole) else reader.option("pathGlobFilter", "incoming_links.parquet").parquet(sf_dir)
    counted = ingest.link_counts(links)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out")

    query = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "to_concept_id", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [parse_frontmatter, migrate_concepts, rewrite_archive_links, rewrite_removed_links, extract_lines, extract_html, stream_link_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from grainfold.queries.wiki import CURRENT, RESOLVE

    # A link in a document is rewritten if it names a removed concept; the document changes if any is.
    removed = r"""
l as (select from_concept_id || '/' || (link_id // 100) as doc, link_id, coalesce(link_label, 'link') as label, from_concept_id as origin, regexp_replace(case when contains(to_concept_id, '.md') then trim(to_concept_id) else '/' || to_concept_id || '.md' end, '[<>]', '', 'g') as raw from incoming_links where from_concept_id is not null and to_concept_id is not null),
incoming_links as (select link_id, doc, label, raw, origin || '/x' as from_concept_id, trim(raw) as to_concept_id from l)"""
    changed = "case lower(trim(status)) when 'current' then 'stable' when 'superseded' then 'deprecated' else status end"
    return {
        "parse_frontmatter": f"with {CURRENT} select concept_id, nullif(concept_type, '') as type, nullif(title, '') as title, nullif(status, '') as status, len(list_filter(coalesce(tags, []), lambda t: t <> ''))::bigint as n_tags from cur",
        "migrate_concepts": f"with {CURRENT} select concept_id, nullif({changed}, '') as status, nullif(fm_timestamp, '') as generated_at, null::varchar as timestamp from cur where coalesce(fm_timestamp, '') <> '' or lower(trim(status)) in ('current', 'superseded')",
        "rewrite_archive_links": f"select 'files/' || file_id as concept_id, 'See [it](/archive/' || relative_path || '.{STAMP}) and /archive/none.txt.' as content from input_files where relative_path is not null",
        "rewrite_removed_links": f"""with {removed}, {RESOLVE}, m as (select concept_id, min('/' || coalesce(trash_path, 'trash')) as new from removals where concept_id is not null group by 1),
n as (select doc, i.link_id, new, '* [' || label || '](' || case when new is null then '<' || raw || '>' when regexp_matches(new, '[\\s()]') then '<' || new || '>' else new end || ')' as line from resolved r join incoming_links i using (link_id) left join m on r.concept_id = m.concept_id)
select doc as concept_id, string_agg(line, chr(10) order by link_id) as content from n group by doc having count(new) > 0""",
        "extract_lines": "select feed_id || '/' || file_no || '.jsonl' as path, 'jsonl' as source_format, 1::bigint as n_parts, count(*) filter (where json_valid(raw_json)) as n_records, (count(*) filter (where not json_valid(raw_json)) > 0)::bigint as n_warnings from frontmatter_raw where raw_json is not null group by 1",
        "stream_link_counts": f"with {RESOLVE} select strftime(to_timestamp(floor(epoch(seen_at) / 2592000) * 2592000) at time zone 'UTC', '%Y-%m-%d') as start, coalesce(r.concept_id, r.to_concept_id) as to_concept_id, count(*) as n from resolved r join incoming_links using (link_id) group by 1, 2",
    }
