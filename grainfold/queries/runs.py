"""Queries that run the commands over a directory made of the tables, and give their reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.plans import commands
from grainfold.plans.runtime import ensure_checkpoint_dir, table
from grainfold.queries.documents import pages
from grainfold.queries.wiki import CURRENT, REMOVED_TOO, ids
from grainfold.sources import files

DATE, STAMP = "2026-01-01", "2026-01-01-0000"


def new_root(spark: SparkSession) -> str:
    """A new directory in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:").replace("///", "/"), f"root-{uuid.uuid4().hex}")


def concept_pages(spark: SparkSession, sf_dir: str, body: F.Column) -> DataFrame:
    return ids(spark, sf_dir).select(F.concat("concept_id", F.lit(".md")).alias("relative_path"), F.concat(F.lit("---\ntype: T\n---\n\n"), body, F.lit("\n")).alias("content"))


def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every input file, with some junk and empty directories beside, written, cleaned, listed and read back."""
    root = new_root(spark)
    f = table(spark, sf_dir, "input_files").select(F.concat(F.lit("d"), (F.col("file_id") % 7).cast("string"), F.lit("/.f"), F.col("file_id").cast("string")).alias("name"), F.coalesce("relative_path", F.lit("")).alias("content"))
    junk = f.select(F.concat("name", F.lit("/._x")).alias("relative_path"), F.lit("junk").alias("content"))
    files.write_texts(f.select(F.concat("name", F.lit(".txt")).alias("relative_path"), "content").union(junk), root)
    files.remove_junk(root)
    files.remove_empty_dirs(root)
    found = files.read_texts(files.list_files(spark, root)).select("relative_path", F.md5(F.col("content").cast("binary")).alias("md5"))
    return found.withColumn("directories", F.lit(sum(len(d) for _, d, _ in os.walk(root))))


def update_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update without an agent does with four kinds of input: pages with a type, pages without, documents, unknown files."""
    root = new_root(spark)
    files.write_texts(concept_pages(spark, sf_dir, F.lit("text")), os.path.join(root, "wiki"))
    kind = F.col("file_id") % 4
    name = F.concat(F.lit("in/F"), F.col("file_id").cast("string"), F.when(kind == 0, ".md").when(kind == 1, ".markdown").when(kind == 2, ".html").otherwise(".xyz"))
    content = F.when(kind == 0, "---\ntype: T\n---\n\nnew\n").when(kind == 1, "no head").when(kind == 2, "<p>text</p>").otherwise("x")
    files.write_texts(table(spark, sf_dir, "input_files").select(name.alias("relative_path"), content.alias("content")), os.path.join(root, "input"))
    return commands.update(spark, root, DATE, STAMP).rows


def remove_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of a directory does to pages half of which link to one of its concepts."""
    root = new_root(spark)
    body = F.when(F.char_length("concept_id") % 2 == 0, F.lit(f"see [it](/{REMOVED_TOO}/gone.md)")).otherwise("no link")
    every = concept_pages(spark, sf_dir, body).union(spark.createDataFrame([(f"{REMOVED_TOO}/gone.md", "---\ntype: T\n---\n\nx\n")], "relative_path string, content string"))
    files.write_texts(every, os.path.join(root, "wiki"))
    return commands.remove(spark, root, REMOVED_TOO, DATE, STAMP).rows


def migrate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages of the older format a migration changes."""
    root = new_root(spark)
    files.write_texts(pages(spark, sf_dir).select(F.concat("concept_id", F.lit(".md")).alias("relative_path"), "content"), os.path.join(root, "wiki"))
    return commands.migrate(spark, root, DATE).rows.select("kind", "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (written_files, update_report, remove_report, migrate_report)}


def oracle_sql() -> dict[str, str]:
    gone = f"(concept_id like '{REMOVED_TOO}/%')"
    every = f"with c as (select distinct concept_id from concepts where concept_id is not null union select '{REMOVED_TOO}/gone')"
    above = "unnest(list_transform(range(1, length(string_split(d, '/')) + 1), lambda i: array_to_string(string_split(d, '/')[1:i], '/')))"
    name = "'in/F' || file_id || case file_id % 4 when 0 then '.md' when 1 then '.markdown' when 2 then '.html' else '.xyz' end"
    return {
        "written_files": "select 'd' || file_id % 7 || '/.f' || file_id || '.txt' as relative_path, md5(coalesce(relative_path, '')) as md5, (select count(distinct file_id % 7) from input_files)::int as directories from input_files",
        "update_report": f"""with f as (select file_id % 4 as k, {name} as n from input_files)
select 'created' as kind, regexp_replace(n, '\\.md$', '') as subject, null::varchar as object from f where k = 0
union all select 'imported', n, null from f where k = 0 union all select 'for_agent', n, null from f where k in (1, 2) union all select 'leftover', n, null from f where k in (1, 2) union all select 'ignored', n, 'unsupported' from f where k = 3""",
        "remove_report": f"""{every} select 'removed' as kind, concept_id as subject, '/trash/' || concept_id || '.md.orig' as object from c where {gone}
union all select 'updated', concept_id, null from c where not {gone} and length(concept_id) % 2 = 0
union all select distinct 'directory', {above}, null from (select regexp_replace(concept_id, '/[^/]*$', '') as d from c where {gone})""",
        "migrate_report": f"with {CURRENT} select 'updated' as kind, concept_id as subject from cur where coalesce(fm_timestamp, '') <> '' or lower(trim(status)) in ('current', 'superseded')",
    }
