"""The four commands over a directory with ``input/`` and ``wiki/``: update, query, remove, migrate.

What a command decides is a plan over DataFrames; contents are read, moved and written by the executors, below a root that
all of them share. The driver lists names, counts, and writes the log line by line. Whatever is needed from a state of the
files is written before they change, as a lazy plan would read the changed ones.

An update has two halves: ``begin`` takes in what can be taken in and stages what an agent has to write from, ``finish``
brings in what the agent has done. The agent itself is outside; ``update`` calls the one it is given in between.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.functions import frontmatter, paths
from grainfold.operators import intake, retrieval, rewrite, wiki
from grainfold.plans import prepass, prompts
from grainfold.plans.runtime import cut
from grainfold.sources import files, formats

# The title of the log, pages that are made, and what an agent's own warnings are introduced with.
LOG_TITLE = "# Wiki Update Log"
GENERATED = ("index.md", "log.md")
STAGED = ".extracted"
REPORTED = "Image analysis limitation reported by agent: "


@dataclass(frozen=True)
class Report:
    """What a command has done: rows (kind, subject, object), written, and their number by kind."""

    rows: DataFrame | None
    counts: dict[str, int]
    concepts_before: int = 0
    concepts_after: int = 0
    error: str | None = None

    def names(self, kind: str) -> list[str]:
        """Subjects of one kind, in order; collects them, so it is for reports of a size to be shown."""
        return [r["subject"] for r in self.rows.where(F.col("kind") == kind).orderBy("subject").select("subject").collect()] if self.rows is not None else []


@dataclass(frozen=True)
class Session:
    """An update that waits for its agent. waiting has (relative_path, source_format, warnings, n_parts), images what ``prepass`` tells of each."""

    root: str
    stamp: str
    before: DataFrame
    pre_agent: DataFrame
    imported: DataFrame
    ignored: DataFrame
    stuck: DataFrame
    waiting: DataFrame
    targets: DataFrame
    names: DataFrame
    images: DataFrame
    note: str | None
    n_waiting: int

    def prompt(self, most_images: int | None = intake.FALLBACK_IMAGES) -> str:
        """The text for one turn of the agent, with an entry for every file that waits."""
        base, staged = os.path.join(self.root, "wiki"), os.path.join(self.root, "input", STAGED)
        texts = self.names.groupBy("relative_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "name"))), lambda x: F.concat(F.lit(staged + "/"), x["name"])).alias("texts"))
        told = self.images.select(F.col("doc").alias("relative_path"), F.concat(F.lit(staged + "/"), "findings").alias("findings")).distinct()
        listed = self.waiting.join(self.targets, "relative_path").withColumn("target", F.concat(F.lit(base + "/"), "target")).join(texts, "relative_path", "left").join(told, "relative_path", "left")
        entries = prompts.file_entries(listed, self.images, most_images).orderBy("relative_path")
        shape = wiki.structure(load_concepts(entries.sparkSession, self.root)).orderBy("part", "name")
        return prompts.update_prompt([r["entry"] for r in entries.toLocalIterator()], [tuple(r) for r in shape.toLocalIterator()])


def today(now: datetime | None = None) -> str:
    """The day in UTC, as the log has it."""
    return (now or datetime.now(UTC)).strftime("%Y-%m-%d")


def archive_stamp(now: datetime | None = None) -> str:
    """Day and minute in UTC, as names have it that would collide."""
    return (now or datetime.now(UTC)).strftime("%Y-%m-%d-%H%M")


def concept_files(spark: SparkSession, root: str) -> DataFrame:
    """(concept_id, content) of the concept pages below wiki/."""
    listed = files.list_files(spark, os.path.join(root, "wiki")).where(F.endswith("relative_path", F.lit(".md")) & ~F.substring_index("relative_path", "/", -1).isin(*GENERATED))
    return files.read_texts(listed).select(F.regexp_replace("relative_path", r"\.md$", "").alias("concept_id"), "content")


def load_concepts(spark: SparkSession, root: str) -> DataFrame:
    """Concepts whose front matter can be read, with their typed fields."""
    parsed = frontmatter.parse_documents(concept_files(spark, root), "concept_id", "content").where("frontmatter is not null")
    return parsed.select("concept_id", F.col("frontmatter.type").alias("concept_type"), *[f"frontmatter.{c}" for c in ("title", "description", "tags", "status", "stale_after")], "body")


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    return cut(wiki.snapshot(concept_files(spark, root), "content"))


def read_index(root: str) -> str | None:
    """The index page of the root, if there is one."""
    path = os.path.join(root, "wiki", "index.md")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_pages(pages: DataFrame, base: str) -> None:
    """Write pages (concept_id, content)."""
    files.write_texts(pages.select(F.concat("concept_id", F.lit(".md")).alias("relative_path"), "content"), base)


def reindex(spark: SparkSession, root: str) -> None:
    """Write the index page of every directory and delete those that no longer qualify."""
    base = os.path.join(root, "wiki")
    pages = cut(wiki.index_pages(load_concepts(spark, root)))
    name = lambda d: F.when(d == "", "index.md").otherwise(F.concat(d, F.lit("/index.md")))
    there = files.list_files(spark, base).where(F.substring_index("relative_path", "/", -1) == "index.md")
    files.remove_files(there.join(pages.select(name(F.col("dir")).alias("relative_path")), "relative_path", "left_anti"))
    files.write_texts(pages.select(name(F.col("dir")).alias("relative_path"), F.col("markdown").alias("content")), base)


def reported(spark: SparkSession, *parts: tuple[str, DataFrame, Column | str, Column | str | None]) -> Report:
    """A report of (kind, rows, subject, object)."""
    rows = [df.select(F.lit(kind).alias("kind"), (F.col(s) if isinstance(s, str) else s).alias("subject"), (F.lit(None).cast("string") if o is None else F.col(o) if isinstance(o, str) else o).alias("object")) for kind, df, s, o in parts]
    written = cut(reduce(DataFrame.union, rows))
    return Report(written, {r["kind"]: r["count"] for r in written.groupBy("kind").count().collect()})


def append_log(root: str, date: str | None, report: Report) -> None:
    """Put the newest entry on top of the log, line by line."""
    path = os.path.join(root, "wiki", "log.md")
    new = path + ".new"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(new, "w", encoding="utf-8") as out:
        out.write(f"{LOG_TITLE}\n\n## {date or today()}\n\n")
        n = 0
        for r in wiki.log_lines(report.rows).orderBy("part", "subject").toLocalIterator():
            out.write(r["line"] + "\n")
            n += 1
        out.write("\n" if n else "* **No-op**: No concepts changed.\n\n")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as old:
                first = old.readline()
                while first.startswith(LOG_TITLE) or not first.strip():
                    first = old.readline()
                    if not first:
                        break
                out.write(first)
                shutil.copyfileobj(old, out)
    os.replace(new, path)


def begin(spark: SparkSession, root: str, stamp: str | None = None, analyse: prepass.Analyse | None = None, limits: formats.Limits = formats.Limits(), readers: dict[str, formats.Read] | None = None) -> Session:
    """Take in conformant pages and stage everything else for the agent: texts, images and, if there is a model, its findings.

    ``readers`` by suffix extend those of the library; ``limits`` are what a reader takes from a document.
    """
    stamp = stamp or archive_stamp()
    extracted_suffixes = intake.EXTRACTED_SUFFIXES + sorted(readers or {})
    source, base = os.path.join(root, "input"), os.path.join(root, "wiki")
    staging = os.path.join(source, STAGED)
    files.remove_directory(staging)
    files.remove_junk(source)
    before = snapshot(spark, root)
    listed = files.list_files(spark, source, lambda p, is_dir: is_dir and os.path.basename(p) == STAGED)
    classes = listed.withColumn("c", intake.classified(F.col("relative_path"), sorted(readers or {}))).select("relative_path", "absolute_path", "c.*")
    texts = files.read_texts(classes.where("bucket = 'conformant'").select("relative_path", "absolute_path"))
    heads = frontmatter.parse_documents(texts, "relative_path", "content").select("relative_path", "frontmatter.type")
    pages = cut(texts.join(heads, "relative_path"))
    suffix = F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
    readable = classes.where("bucket = 'non-conformant'")
    documents = files.read_files(readable.where(suffix.isin(*extracted_suffixes)).select("relative_path", "absolute_path"))
    extracted = cut(files.extract_documents(documents, "relative_path", "relative_path", "data", limits, readers))
    good = extracted.where("reason is null")
    taken = classes.where("bucket = 'ignored'").select("relative_path", "reason").union(extracted.where("reason is not null").select("relative_path", "reason"))
    bare = lambda df: df.select("relative_path", F.lit(None).cast("string").alias("source_format"), F.lit(None).cast("array<string>").alias("warnings"), F.lit(0).alias("n_parts"))
    waiting = cut(good.select("relative_path", "source_format", "warnings", F.size("parts").alias("n_parts")).union(bare(pages.where("type is null"))).union(bare(readable.where(~suffix.isin(*extracted_suffixes)))))
    imported = pages.where("type is not null")
    targets = cut(intake.archive_targets(imported.select("relative_path").union(waiting.select("relative_path")), below(spark, base, "archive"), "relative_path", "relative_path", stamp))
    files.write_texts(imported.select(F.regexp_replace("relative_path", r"(?i)\.markdown$", ".md").alias("relative_path"), "content"), base)
    # A page whose original can't be archived is written, but not imported: it comes again with the next update.
    moved = files.move_files(imported.join(targets, "relative_path").select(F.col("absolute_path").alias("source"), F.concat(F.lit(base + "/"), "target").alias("target")))
    stuck = moved.where("error is not null").select(F.substring("source", F.lit(len(source) + 2), F.char_length("source")).alias("relative_path"), "error")
    imported = imported.join(stuck, "relative_path", "left_anti")
    names = cut(intake.staged_names(good.withColumn("n", F.size("parts")), "relative_path", "relative_path", "n"))
    part = good.select("relative_path", F.posexplode("parts").alias("k", "content")).withColumn("part_no", F.col("k") + 1)
    files.write_texts(part.join(names, ["relative_path", "part_no"]).select(F.col("name").alias("relative_path"), "content"), staging)
    images, note = stage_images(good, names, staging, analyse)
    return Session(root, stamp, before, snapshot(spark, root), cut(imported.select("relative_path")), cut(taken.union(stuck.select("relative_path", F.lit("io_failed")))), cut(stuck), waiting, targets, names, images, note, waiting.count())


def below(spark: SparkSession, base: str, directory: str) -> DataFrame:
    """(target) of the files there are in a directory, with its name."""
    return files.list_files(spark, os.path.join(base, directory)).select(F.concat(F.lit(directory + "/"), "relative_path").alias("target"))


def stage_images(good: DataFrame, names: DataFrame, staging: str, analyse: prepass.Analyse | None) -> tuple[DataFrame, str | None]:
    """Write the images of documents and the findings about them; (doc, id, status, reason, occurrences, …, path, findings) of each, and what the model calls have used."""
    staged = cut(prepass.staged_images(good.select(F.col("relative_path").alias("doc"), "images")))
    first = names.where("part_no = 1").select(F.col("relative_path").alias("doc"), intake.findings_name(F.col("name")).alias("findings"))
    ending = F.regexp_replace(F.substring_index("media", "/", -1), "^jpeg$", "jpg")
    place = F.concat(F.regexp_replace("findings", r"-image-findings\.txt$", "-images/"), "id", F.lit("."), ending)
    placed = staged.join(first, "doc").withColumn("path", place)
    files.write_binaries(placed.select(F.col("path").alias("relative_path"), "data"), staging)
    if analyse:
        found = cut(prepass.run_prepass(prepass.request_batches(staged), analyse))
        used = prepass.usage(found).first()
    else:
        found, used = good.sparkSession.createDataFrame([], prepass.FINDING), None
    told = cut(prepass.with_findings(placed.drop("data"), found).withColumn("path", F.concat(F.lit(staging + "/"), "path")))
    rendered = prepass.render_findings(told).join(first, "doc").select(F.col("findings").alias("relative_path"), "content")
    files.write_texts(rendered, staging)
    note = f"Pre-analysis: {used['calls']} call(s), {used['input_tokens']} input / {used['output_tokens']} output tokens, cost {used['cost']:.4f}." if used and used["calls"] else None
    return told, note


def finish(spark: SparkSession, session: Session, date: str | None = None, message: str = "") -> Report:
    """Bring in what the agent has done: links to archived originals, indexes, extracted texts into the archive, outcomes, log."""
    root, source, base = session.root, os.path.join(session.root, "input"), os.path.join(session.root, "wiki")
    staging = os.path.join(source, STAGED)
    written = wiki.diff(session.pre_agent, snapshot(spark, root)).select("concept_id")
    mapping = session.targets.join(session.waiting.select("relative_path"), "relative_path").select(F.col("relative_path").alias("old"), F.regexp_replace("target", "^archive/", "").alias("new"))
    write_pages(cut(rewrite.rewrite_archive_links(concept_files(spark, root).join(written, "concept_id", "left_semi"), mapping)), base)
    after = snapshot(spark, root)
    diff = cut(wiki.diff(session.before, after))
    reindex(spark, root)
    still = files.list_files(spark, source, lambda p, is_dir: is_dir and os.path.basename(p) == STAGED).select("relative_path")
    leftover = cut(session.waiting.join(still, "relative_path", "left_semi").select("relative_path"))
    # The extracted texts and findings of what the agent has archived follow it.
    findings = session.images.select(F.col("doc").alias("relative_path"), F.col("findings").alias("name")).distinct()
    done = session.names.select("relative_path", "name").union(findings).join(leftover, "relative_path", "left_anti").select("name")
    kept = cut(intake.archive_targets(done, below(spark, base, "archive"), "name", "name", session.stamp))
    copied = files.copy_files(kept.select(F.concat(F.lit(staging + "/"), "name").alias("source"), F.concat(F.lit(base + "/"), "target").alias("target")))
    files.remove_directory(staging)
    files.remove_empty_dirs(source)
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(message.splitlines())], "pos bigint, line string")
    resolved = intake.applied_outcomes(session.images.select("doc", "id", "status"), intake.parsed_outcomes(lines)).select("doc", "id", "status")
    summary = intake.document_summary(session.images.select("doc", "id", F.size("occurrences").alias("occurrences")).join(resolved, ["doc", "id"])).select("summary")
    if session.note:
        summary = summary.union(spark.createDataFrame([(session.note,)], "summary string"))
    told = session.waiting.select("relative_path", F.explode("warnings").alias("w")).select(F.concat("relative_path", F.lit(": "), "w").alias("warning"))
    told = told.union(intake.limitation_lines(spark.createDataFrame([(message,)], "text string"), "text").select(F.concat(F.lit(REPORTED), "line")))
    told = told.union(session.stuck.select(F.concat(F.lit("Could not archive "), "relative_path", F.lit(": "), "error"))).union(copied.where("error is not null").select(F.concat(F.lit("Could not archive extracted text "), "source", F.lit(": "), "error")))
    warned = intake.aggregated_warnings(told.withColumn("pos", F.lit(0)))
    report = reported(
        spark,
        ("created", diff.where("change = 'created'"), "concept_id", None),
        ("updated", diff.where("change = 'updated'"), "concept_id", None),
        ("images", summary, "summary", None),
        ("warning", warned, "warning", None),
        ("imported", session.imported, "relative_path", None),
        ("for_agent", session.waiting, "relative_path", None),
        ("ignored", session.ignored, "relative_path", "reason"),
        ("leftover", leftover, "relative_path", None),
    )
    append_log(root, date, report)
    return Report(report.rows, report.counts, session.before.count(), after.count())


def update(spark: SparkSession, root: str, date: str | None = None, stamp: str | None = None, agent: Callable[[str], str] | None = None, analyse: prepass.Analyse | None = None) -> Report:
    """Take in what lies in input/. The agent gets the prompt, writes and moves files itself, and returns its last message; without one, what needs it is left in input/."""
    session = begin(spark, root, stamp, analyse)
    return finish(spark, session, date, agent(session.prompt()) if agent and session.n_waiting else "")


def query(spark: SparkSession, root: str, question: str, limit: int = 10) -> DataFrame:
    """(concept_id, score, title, body) of the best concepts for a question."""
    concepts = load_concepts(spark, root)
    blank = lambda c: F.coalesce(c, F.lit(""))
    corpus = concepts.select(F.col("concept_id").alias("key"), F.concat_ws(" ", blank("title"), blank("description"), F.array_join("tags", " "), blank("body")).alias("text"))
    best = retrieval.retrieve(corpus, question, limit).withColumnRenamed("key", "concept_id")
    return best.join(concepts, "concept_id").select("concept_id", "score", "title", "body")


def query_prompt(spark: SparkSession, root: str, question: str, limit: int = 10) -> str:
    """The question with its context: rules, index page and the best concepts, which are ``limit`` at most."""
    best = query(spark, root, question, limit).orderBy(F.desc("score"), "concept_id").select("concept_id", F.concat(F.lit("### "), F.coalesce("title", "concept_id"), F.lit("\n\n"), F.coalesce("body", F.lit(""))))
    return prompts.query_prompt(question, prompts.query_context([tuple(r) for r in best.collect()], read_index(root)))


def plan_removal(spark: SparkSession, root: str, target: str) -> DataFrame:
    """(kind, subject, object) of what a removal would do; nothing is changed."""
    pages = concept_files(spark, root)
    plan = wiki.removal_plan(pages.select("concept_id"), rewrite.references(pages), target)
    # A directory stays if it holds anything else than removed pages and indexes.
    doomed = plan.where("kind = 'concept'").select(F.concat("subject", F.lit(".md")).alias("relative_path"))
    others = files.list_files(spark, os.path.join(root, "wiki")).where(F.substring_index("relative_path", "/", -1) != "index.md").join(doomed, "relative_path", "left_anti")
    held = others.select(F.lit("directory").alias("kind"), F.explode(wiki.ancestors(paths.directory(F.col("relative_path")))).alias("subject")).distinct()
    return plan.join(held, ["kind", "subject"], "left_anti")


def remove(spark: SparkSession, root: str, target: str, date: str | None = None, stamp: str | None = None) -> Report:
    """Move concepts to the trash and redirect every link to them."""
    base = os.path.join(root, "wiki")
    doomed = cut(wiki.doomed_by(concept_files(spark, root).select("concept_id"), target))
    if doomed.isEmpty():
        return Report(None, {}, error=f"nothing to remove at {target}")
    page = F.concat("concept_id", F.lit(".md"))
    trash = cut(intake.archive_targets(doomed.withColumn("page", page), below(spark, base, "trash"), "concept_id", "page", stamp or archive_stamp(), "trash"))
    moved = files.move_files(trash.select(F.concat(F.lit(base + "/"), page).alias("source"), F.concat(F.lit(base + "/"), "target").alias("target")))
    # What couldn't be moved stays, and so do the links to it.
    stuck = moved.where("error is not null")
    gone_ = trash.withColumn("absolute", F.concat(F.lit(base + "/"), "target")).join(stuck.select(F.col("target").alias("absolute")), "absolute", "left_anti")
    mapping = cut(gone_.select(F.col("concept_id").alias("old"), F.concat(F.lit("/"), "target").alias("new")))
    warned = stuck.select(F.concat(F.lit("Could not move "), "source", F.lit(": "), "error").alias("warning"))
    changed = cut(rewrite.rewrite_removed_links(concept_files(spark, root).where(~wiki.is_raw(F.col("concept_id"))), mapping))
    write_pages(changed, base)
    reindex(spark, root)
    gone = spark.createDataFrame([(d,) for d in files.remove_empty_dirs(base)], "dir string")
    report = reported(spark, ("removed", mapping, "old", "new"), ("updated", changed, "concept_id", None), ("directory", gone, "dir", None), ("warning", warned, "warning", None))
    append_log(root, date, report)
    return report


def migrate(spark: SparkSession, root: str, date: str | None = None) -> Report:
    """Bring every concept of the older format up to date; a second run changes nothing."""
    changed = cut(rewrite.migrated(concept_files(spark, root)))
    report = reported(spark, ("updated", changed, "concept_id", None))
    if report.counts:
        write_pages(changed, os.path.join(root, "wiki"))
        reindex(spark, root)
        append_log(root, date, report)
    return report
