"""The knowledge base as tables: current concepts, snapshots, directories, indexes, links, removals.

All operators take and return DataFrames. Rows of null concept_id take no part. Where several rows
describe one concept, the one loaded last (then of the greatest row_id) is current.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import links, paths
from grainfold.plans.runtime import cut

FORMAT_VERSION = "0.2"
UNINDEXED = r"^(archive|trash)(/|$)"


def current(concepts: DataFrame) -> DataFrame:
    """The latest row of each concept; an aggregate, so no group is sorted."""
    fields = [c for c in concepts.columns if c != "concept_id"]
    latest = F.max_by(F.struct(*fields), F.struct("loaded_at", "row_id"))
    return concepts.where(F.col("concept_id").isNotNull()).groupBy("concept_id").agg(latest.alias("r")).select("concept_id", "r.*")


def snapshot(concepts: DataFrame, content: str = "body") -> DataFrame:
    """(concept_id, hash) of the content."""
    return concepts.select("concept_id", F.sha1(F.coalesce(F.col(content), F.lit("")).cast("binary")).alias("hash"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(concept_id, change): created or updated; what is no longer there isn't reported."""
    old = before.select("concept_id", F.col("hash").alias("old_hash"))
    joined = after.join(old, "concept_id", "left")
    change = F.when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") != F.col("hash"), "updated")
    return joined.select("concept_id", change.alias("change")).where("change is not null")


def alive(concepts: DataFrame, removals: DataFrame) -> DataFrame:
    """concept_ids whose last load is later than their last removal."""
    loads = concepts.where(F.col("concept_id").isNotNull()).groupBy("concept_id").agg(F.max("loaded_at").alias("loaded"))
    gone = removals.groupBy("concept_id").agg(F.max("removed_at").alias("removed"))
    return loads.join(gone, "concept_id", "left").where(F.col("removed").isNull() | (F.col("loaded") > F.col("removed"))).select("concept_id")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, with the root as ''."""
    parts = F.split(directory, "/")
    named = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), named))


def index_dirs(ids: DataFrame) -> DataFrame:
    """(dir): every directory on the way to a concept, and the root; none inside archive or trash."""
    own = ids.select(paths.directory(F.col("concept_id")).alias("own")).where(~F.col("own").rlike(UNINDEXED)).distinct()
    found = own.select(F.explode(ancestors(F.col("own"))).alias("dir")).distinct()
    root = ids.sparkSession.range(1).select(F.lit("").alias("dir"))
    return found.union(root).distinct()


def child_dirs(dirs: DataFrame) -> DataFrame:
    """(dir, child) for each directory below another."""
    return dirs.where("dir <> ''").select(paths.parent(F.col("dir")).alias("dir"), F.col("dir").alias("child"))


def by_locale(c: Column) -> Column:
    """A text in the order of the root locale, in which case and accents come after letters."""
    return F.collate(c, "UNICODE")


def dir_label(c: Column) -> Column:
    return F.when(c == "", "Wiki").otherwise(paths.basename(c))


def index_pages(concepts: DataFrame) -> DataFrame:
    """(dir, markdown) of the index of every directory; the root's begins with the format version. Directories come first, in binary order, then concepts in that of the locale.

    A directory's page is one value, so its entries meet in one row; only link lines travel there.
    """
    dirs = index_dirs(concepts)
    subs = child_dirs(dirs).select("dir", F.lit(0).alias("part"), F.col("child").alias("key"), by_locale(F.lit("")).alias("place"), F.format_string("* [%s/](%s/)", paths.basename(F.col("child")), paths.basename(F.col("child"))).alias("line"))
    slug = paths.basename(F.col("concept_id"))
    title = F.coalesce(F.col("title"), slug)
    link = F.format_string("* [%s](%s.md)", title, slug)
    line = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(link, F.lit(" - "), "description")).otherwise(link)
    own = concepts.select(paths.directory(F.col("concept_id")).alias("dir"), F.lit(1).alias("part"), F.lit("").alias("key"), by_locale(F.col("concept_id")).alias("place"), line.alias("line"))
    entries = subs.union(own).groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("part", "key", "place", "line"))).alias("entries"))
    lines = lambda part: F.transform(F.filter("entries", lambda e: e["part"] == part), lambda e: e["line"])
    listed = dirs.join(entries, "dir", "left").select("dir", F.coalesce(lines(0), F.array().cast("array<string>")).alias("subs"), F.coalesce(lines(1), F.array().cast("array<string>")).alias("own"))
    head = F.array(F.concat(F.lit("# "), dir_label(F.col("dir")), F.lit(" Index")), F.lit(""))
    gap = F.when(F.size("subs") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(head, "subs", gap, "own", F.array(F.lit(""))), "\n")
    version = F.lit(f'---\nokf_version: "{FORMAT_VERSION}"\n---\n\n')
    return listed.select("dir", F.when(F.col("dir") == "", F.concat(version, body)).otherwise(body).alias("markdown"))


def orphan_indexes(existing: DataFrame, concepts: DataFrame) -> DataFrame:
    """Directories (dir) with an index page that no longer qualify."""
    return existing.select("dir").distinct().join(index_dirs(concepts), "dir", "left_anti")


def emptied_dirs(doomed: DataFrame, survivors: DataFrame) -> DataFrame:
    """(dir): directories of doomed concepts below which no concept survives.

    The prefix test becomes an equi-join: the survivors' ancestors are spelled out.
    """
    above = lambda df: df.select(F.explode(ancestors(paths.directory(F.col("concept_id")))).alias("dir")).where("dir <> ''").distinct()
    return above(doomed).join(above(survivors), "dir", "left_anti")


def structure(concepts: DataFrame) -> DataFrame:
    """(part, name, n): directories, types with the number of their concepts, and ids, as a preview of the knowledge base."""
    listed = directories(concepts).select(F.lit("directory").alias("part"), F.col("dir").alias("name"), F.lit(None).cast("bigint").alias("n"))
    typed = types_in_use(concepts).select(F.lit("type"), "type", F.col("n").cast("bigint"))
    return listed.union(typed).union(concepts.select(F.lit("concept"), "concept_id", F.lit(None).cast("bigint")))


#: Kinds of log lines, in order.
LOGGED = ("created", "updated", "removed", "images", "warning")


def log_lines(rows: DataFrame) -> DataFrame:
    """(part, subject, line) of the log for what was done (kind, subject, object); other kinds aren't logged."""
    flat = F.trim(F.regexp_replace("subject", r"\s+", " "))
    page = F.format_string("[%s](/%s.md).", "subject", "subject")
    line = (
        F.when(F.col("kind") == "created", F.concat(F.lit("* **Creation**: Added "), page))
        .when(F.col("kind") == "updated", F.concat(F.lit("* **Update**: Updated "), page))
        .when(F.col("kind") == "removed", F.format_string("* **Removal**: Removed [%s](%s).", "subject", F.coalesce("object", F.lit(""))))
        .when(F.col("kind") == "images", F.concat(F.lit("* **Images**: "), flat))
        .when(F.col("kind") == "warning", F.concat(F.lit("* **Warning**: "), flat))
    )
    return rows.where(F.col("kind").isin(*LOGGED)).select(F.array_position(F.array(*map(F.lit, LOGGED)), F.col("kind")).cast("int").alias("part"), "subject", line.alias("line"))


def types_in_use(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy(F.coalesce("concept_type", F.lit("(untyped)")).alias("type")).agg(F.count("*").alias("n"))


def directories(concepts: DataFrame) -> DataFrame:
    return concepts.select(paths.directory(F.col("concept_id")).alias("dir")).where("dir <> ''").distinct()


def markdown_links(df: DataFrame, key: str, content: str, source: str) -> DataFrame:
    """(key, concept_id): concepts that the links and reference definitions in prose lines name, each as often as it is named.

    Fences make the lines of a text depend on those before, so each text is scanned once, in one pass.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (text_, origin) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                named = [c for t in links.prose_targets(text_) if (c := links.resolve(t, (origin or "").rpartition("/")[0])) is not None]
                at += [i] * len(named)
                found += named
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "concept_id"])

    texts = df.where(F.col(content).contains("](") | F.col(content).contains("]:")).select(F.col(key), F.col(content), F.col(source).cast("string"))
    return texts.mapInArrow(run, f"key {kind}, concept_id string").withColumnRenamed("key", key)


def incoming(linked: DataFrame, doomed: DataFrame) -> DataFrame:
    """Distinct (from_concept_id, to_concept_id) that lead from survivors to doomed concepts."""
    ids = doomed.select("concept_id").distinct()
    into = linked.join(ids.withColumnRenamed("concept_id", "to_concept_id"), "to_concept_id", "left_semi")
    return into.join(ids.withColumnRenamed("concept_id", "from_concept_id"), "from_concept_id", "left_anti").select("from_concept_id", "to_concept_id").distinct()


def ordered_links(linked: DataFrame) -> DataFrame:
    """(from_concept_id, to_concept_id) in the order of the locale."""
    return linked.orderBy(by_locale(F.col("from_concept_id")), by_locale(F.col("to_concept_id")), "from_concept_id", "to_concept_id")


def ordered_dirs(dirs: DataFrame) -> DataFrame:
    """(dir), the longest first, as they have to be removed, then in the order of the locale."""
    return dirs.orderBy(F.char_length("dir").desc(), by_locale(F.col("dir")), "dir")


def target_path(c: Column) -> Column:
    """A removal target as a path inside the wiki, or NULL."""
    path = F.regexp_replace(F.replace(paths.trimmed(c), F.lit("\\"), F.lit("/")), "/+$", "")
    inner = F.regexp_replace(path, "^wiki/", "")
    bad = (path == "") | F.startswith(path, F.lit("/")) | (path == "wiki") | F.exists(F.split(inner, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, inner)


def is_raw(c: Column) -> Column:
    return F.lower(F.split_part(c, F.lit("/"), F.lit(1))).isin("archive", "trash")


def doomed_by(ids: DataFrame, target: str) -> DataFrame:
    """Concepts that a removal target names: one page, or all below a directory; none for generated pages and raw files."""
    t = target_path(F.lit(target))
    page = F.endswith(t, F.lit(".md")) & (F.col("concept_id") == F.regexp_replace(t, r"\.md$", ""))
    below = ~F.endswith(t, F.lit(".md")) & F.startswith("concept_id", F.concat(t, F.lit("/")))
    kept = ~paths.basename(t).isin("index.md", "log.md") & ~is_raw(t)
    return ids.where(F.coalesce((page | below) & kept, F.lit(False))).select("concept_id")


def removal_plan(ids: DataFrame, linked: DataFrame, target: str) -> DataFrame:
    """(kind, subject, object): concepts to remove, directories that vanish, links that lead to them."""
    ids = cut(ids.select("concept_id"))
    doomed = doomed_by(ids, target)
    survivors = ids.join(doomed, "concept_id", "left_anti")
    none = F.lit("").alias("object")
    return (
        doomed.select(F.lit("concept").alias("kind"), F.col("concept_id").alias("subject"), none)
        .union(emptied_dirs(doomed, survivors).select(F.lit("directory"), "dir", none))
        .union(incoming(linked, doomed).select(F.lit("link"), "from_concept_id", "to_concept_id"))
    )


def trust(events: DataFrame) -> DataFrame:
    """(concept_id, tier, latest) of verified concepts; dates compare as text."""
    human = F.max(F.coalesce(F.startswith("actor_by", F.lit("human:")), F.lit(False)))
    return events.where("event_kind = 'verified' and concept_id is not null").groupBy("concept_id").agg(F.when(human, "human-reviewed").otherwise("machine-confirmed").alias("tier"), F.max("event_at").alias("latest"))


def rendered(concepts: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """(concept_id, content): each concept as the text that a model gets to read."""
    made = events.where("event_kind = 'generated'").groupBy("concept_id").agg(F.max_by(F.struct("actor_by", "event_at"), F.struct("recorded_at", "event_id")).alias("g"))
    entry = F.concat(F.coalesce("source_id", F.lit("(no id)")), F.lit(" -> "), F.coalesce("resource", F.lit("(no resource)")))
    used = sources.groupBy("concept_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_pos", "entry_id", entry.alias("e")))), lambda x: x["e"]), "; ").alias("sources"))
    joined = concepts.join(made, "concept_id", "left").join(trust(events), "concept_id", "left").join(used, "concept_id", "left")
    given = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    filled = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
    listed = lambda name, c: F.when(F.size(filled(c)) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(filled(c), ", "), F.lit("]")))
    unknown = lambda c: F.coalesce(c, F.lit("(unknown)"))
    origin = F.when(F.col("g").isNotNull(), F.concat(F.lit("generated: by "), unknown(F.col("g.actor_by")), F.lit(" at "), unknown(F.col("g.event_at")))).when(
        F.coalesce("fm_timestamp", F.lit("")) != "", F.concat(F.lit("timestamp: "), "fm_timestamp", F.lit(" (legacy v0.1)"))
    )
    checked = F.when(F.col("tier").isNotNull(), F.concat(F.lit("verified: "), "tier", F.coalesce(F.concat(F.lit(" (latest "), "latest", F.lit(")")), F.lit(""))))
    meta = F.concat_ws(
        "\n",
        F.concat(F.lit("type: "), F.coalesce("concept_type", F.lit("(untyped)"))),
        given("title", F.col("title")),
        given("description", F.col("description")),
        listed("tags", "tags"),
        given("status", F.col("status")),
        listed("supersedes", "supersedes"),
        origin,
        checked,
        given("stale_after", F.col("stale_after")) if "stale_after" in concepts.columns else F.lit(None),
        F.concat(F.lit("sources: "), "sources"),
    )
    body = paths.trimmed(F.coalesce("body", F.lit("")))
    return joined.select("concept_id", F.concat(F.lit("### "), "concept_id", F.lit("\n\n"), meta, F.lit("\n\n"), body).alias("content"))
