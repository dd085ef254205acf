"""Intake of input files as DataFrames: classification, collision-free names, image catalogues and batches, outcomes, warnings, line records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions import paths, text
from grainfold.plans.runtime import cut

# Suffixes read as they are, images, suffixes with an extractor, statuses in print order, limits.
TEXT_SUFFIXES = [".txt", ".csv", ".tsv", ".json", ".dsl", ".mmd", ".mermaid", ".puml", ".plantuml", ".dot", ".gv", ".yaml", ".yml", ".toml", ".rst", ".adoc", ".asciidoc", ".org"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp"]
EXTRACTED_SUFFIXES = [".pdf", ".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".epub", ".html", ".htm", ".rtf", ".jsonl", ".ndjson", ".ipynb"]
CLASSES, DASHES = ["content", "decorative", "unreadable"], ":=–—-"
STATUSES = ["staged", "analyzed", "decorative", "unreadable", "broken", "failed"]
JUNK = [".DS_Store", "Thumbs.db", "ehthumbs.db", "ehthumbs_vista.db", "desktop.ini"]
BATCH_SIZE, BATCH_BYTES, IMAGE_BYTES, FALLBACK_IMAGES, RECORDS_A_PART, NAMED_BAD_LINES = 5, 12 * 1024 * 1024, 5 * 1024 * 1024, 24, 1000, 10


def has_suffix(c: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(c), F.lit(s))
    return out


def classified(path: Column, further: list[str] | None = None) -> Column:
    """(bucket, reason): reserved names first, then markdown, then readable, image and extractable suffixes, and those of ``further`` readers."""
    name = paths.basename(F.regexp_replace(path, r"(?i)\.markdown$", ".md"))
    known = has_suffix(path, TEXT_SUFFIXES + IMAGE_SUFFIXES + EXTRACTED_SUFFIXES + (further or []))
    bucket = F.when(name.isin("index.md", "log.md"), "ignored").when(has_suffix(path, [".md", ".markdown"]), "conformant").when(known, "non-conformant").otherwise("ignored")
    reason = F.when(name.isin("index.md", "log.md"), "reserved").when(bucket == "ignored", "unsupported")
    return F.struct(bucket.alias("bucket"), reason.alias("reason"))


def is_junk(name: Column) -> Column:
    return name.isin(JUNK) | name.rlike(r"^\._.")


def stem(name: Column) -> Column:
    """File name without its suffix; a dot at the start is none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def in_directory(path: Column, name: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.concat(paths.directory(path), F.lit("/"), name)).otherwise(name)


def archive_targets(files: DataFrame, existing: DataFrame, key: str, path: str, stamp: str, root: str = "archive") -> DataFrame:
    """(key, target): a name below ``root`` that no existing path has and no other file of the batch gets.

    First the plain name, then one with the stamp, then with a counter. ``.md`` originals end in ``.orig``.
    Files of a batch that want the same name are served in order of their key.
    """
    name = paths.basename(F.col(path))
    orig = F.when(F.endswith(name, F.lit(".md")), ".orig").otherwise("")
    plain = F.concat(F.lit(f"{root}/"), in_directory(F.col(path), F.concat(name, orig)))
    stamped = F.concat(F.lit(f"{root}/"), in_directory(F.col(path), F.concat(stem(name), F.lit(f".{stamp}"))))
    wish = files.select(F.col(key), plain.alias("plain"), stamped.alias("head"), F.concat(suffix(name), orig).alias("tail"))
    taken = existing.select(F.col("target").alias("plain")).distinct().withColumn("taken", F.lit(1))
    ranked = wish.withColumn("n", F.row_number().over(Window.partitionBy("plain").orderBy(key)) - 1).join(taken, "plain", "left")
    # Existing paths that are stamped forms of a wish: their head, tail and step (1 stamped, k + 1 with counter k).
    form = rf"^(.*\.{stamp})(?:\.(\d+))?((?:\.[^./]*)?(?:\.orig)?)$"
    old = existing.where(F.col("target").rlike(form)).select(F.regexp_extract("target", form, 1).alias("head"), F.regexp_extract("target", form, 3).alias("tail"), (F.coalesce(F.regexp_extract("target", form, 2).try_cast("int"), F.lit(0)) + 1).alias("s"))
    steps = old.groupBy("head", "tail").agg(F.sort_array(F.collect_set("s")).alias("used"))
    # The first file gets the plain name if it is free; the k-th of the others gets the k-th free stamped form.
    free = F.col("n") + F.coalesce("taken", F.lit(0))
    used = F.coalesce("used", F.array().cast("array<int>"))
    step = F.aggregate(used, free, lambda at, u: F.when((at > 0) & (u <= at), at + 1).otherwise(at))
    counted = ranked.join(steps, ["head", "tail"], "left").withColumn("step", step)
    target = F.when(F.col("step") == 0, F.col("plain")).when(F.col("step") == 1, F.concat("head", "tail")).otherwise(F.concat("head", F.lit("."), (F.col("step") - 1).cast("string"), "tail"))
    return counted.select(key, target.alias("target"))


def staged_names(files: DataFrame, key: str, path: str, parts: str) -> DataFrame:
    """(key, part_no, name) of each file's extracted text: numbered parts if several, the suffix in the name if the plain one is taken."""
    name = paths.basename(F.col(path))
    plain = in_directory(F.col(path), F.concat(stem(name), F.lit("-extracted")))
    longer = in_directory(F.col(path), F.concat(stem(name), F.lit("."), F.lower(F.substring(suffix(name), 2, 100)), F.lit("-extracted")))
    wish = files.select(key, plain.alias("plain"), longer.alias("longer"), F.greatest(F.coalesce(F.col(parts), F.lit(1)), F.lit(1)).cast("int").alias("parts"))
    first = F.row_number().over(Window.partitionBy("plain").orderBy(key)) == 1
    base = wish.withColumn("base", F.when(first, F.col("plain")).otherwise(F.col("longer")))
    each = base.select(key, "base", "parts", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part_no"))
    number = F.lpad(F.col("part_no").cast("string"), F.greatest(F.lit(2), F.char_length(F.col("part_no").cast("string"))), F.lit("0"))
    return each.select(key, "part_no", F.when(F.col("parts") == 1, F.concat("base", F.lit(".txt"))).otherwise(F.concat("base", F.lit(".part"), number, F.lit(".txt"))).alias("name"))


def findings_name(extracted: Column) -> Column:
    return F.regexp_replace(extracted, r"-extracted(?:\.part\d+)?\.txt$", "-image-findings.txt")


def catalogue(payloads: DataFrame) -> DataFrame:
    """(doc, id, sha256, byte_length, occurrences, first_pos) of the distinct payloads (doc, pos, data, location) of each document.

    Ids follow the first occurrence. Rows of null data are no payload.
    """
    hashed = payloads.where(F.col("data").isNotNull()).select("doc", "pos", "location", F.sha2(F.col("data").cast("binary"), 256).alias("sha256"), F.octet_length("data").alias("byte_length"))
    per = hashed.groupBy("doc", "sha256").agg(F.max("byte_length").cast("bigint").alias("byte_length"), F.count("*").alias("occurrences"), F.min("pos").alias("first_pos"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("first_pos", "sha256")).cast("string")
    return per.select("doc", F.concat(F.lit("img-"), F.lpad(n, F.greatest(F.lit(2), F.char_length(n)), F.lit("0"))).alias("id"), "sha256", "byte_length", "occurrences", "first_pos")


def batches(images: DataFrame, size: int = BATCH_SIZE, most: int = BATCH_BYTES, largest: int = IMAGE_BYTES) -> DataFrame:
    """(doc, pos, byte_length, batch) of images (doc, pos, byte_length): greedy batches in order; NULL for images over ``largest``.

    Of a document, which is a list in order, the sum starts anew with every batch, so it is gone through once.
    """

    def run(rows_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_:
            at, out = [], []
            for i, items in enumerate(rows.column(1).to_pylist()):
                batch = n = total = 0
                for x in items:
                    if not batch or n >= size or total + x["byte_length"] > most:
                        batch, n, total = batch + 1, 0, 0
                    n, total = n + 1, total + x["byte_length"]
                    at.append(i)
                    out.append((x["pos"], x["byte_length"], batch))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32())))], names=["doc", "pos", "byte_length", "batch"])

    fits = images.where(F.col("byte_length") <= largest).select("doc", F.col("pos").cast("bigint").alias("pos"), F.col("byte_length").cast("bigint").alias("byte_length"))
    items = fits.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "byte_length"))).alias("items"))
    packed = items.mapInArrow(run, f"doc {images.schema['doc'].dataType.simpleString()}, pos bigint, byte_length bigint, batch int")
    over = images.where(F.col("byte_length") > largest).select("doc", F.col("pos").cast("bigint"), F.col("byte_length").cast("bigint"), F.lit(None).cast("int"))
    return packed.union(over)


def status_counts(images: DataFrame) -> DataFrame:
    """(doc, one column for each status): zero where a document has none."""
    return images.groupBy("doc").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def awaiting() -> Column:
    return F.col("status").isin("staged", "failed")


def document_summary(images: DataFrame) -> DataFrame:
    """(doc, summary) of images (doc, id, status, occurrences)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    per = images.groupBy("doc").agg(F.sum("occurrences").alias("occ"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(awaiting(), F.col("id")))), ", ").alias("missing"), *counts)
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in STATUSES])
    missing = F.when(F.col("missing") == "", "none").otherwise(F.col("missing"))
    return per.select("doc", F.concat("doc", F.lit(": "), F.col("occ").cast("string"), F.lit(" occurrence(s), "), F.col("n").cast("string"), F.lit(" unique — "), told, F.lit("; missing findings: "), missing).alias("summary"))


def outcome(line: str) -> tuple[str, str, str, str] | None:
    """(document, id, classification, note) of a line "- document image-id: classification - note"; the document may be left out, and signs of emphasis and code count for nothing."""
    for m in re.finditer(r"img-[0-9]+", line, re.I):
        if not (line[m.start() - 1 : m.start()] + line[m.end() : m.end() + 1]).replace("_", "x").isalnum():
            said = line[m.end() :].replace("`", "", 1) if line[m.end() : m.end() + 1] == "`" else line[m.end() :]
            said = said.lstrip()
            word = re.match("[A-Za-z]*", said[1:].lstrip().lstrip("*")).group()
            if said[:1] in DASHES and said and word.lower() in CLASSES:
                note = said[1:].lstrip().lstrip("*")[len(word) :]
                if not (note[:1].isalnum() or note[:1] == "_"):
                    note = note.lstrip("*").strip()
                    document = line[: m.start()].strip()
                    document = document[1:] if document[:1] in ("-", "*") else document
                    document = document.replace("`", "").replace("*", "").strip()
                    document = document[:-1] if document[-1:] in (":", ",") else document
                    return document.strip().removeprefix("input/"), m.group().lower(), word.lower(), (note[1:] if note[:1] in DASHES else note).strip()
    return None


def parsed_outcomes(lines: DataFrame) -> DataFrame:
    """(pos, doc, id, classification, note) of lines (pos, line) that tell an image's outcome."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            found = [(i, o) for i, line in enumerate(batch.column(1).to_pylist()) if (o := outcome(line))]
            cols = list(zip(*(o for _, o in found))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names=["pos", "doc", "id", "classification", "note"])

    named = lines.where(F.lower("line").contains("img-")).select("pos", "line")
    return named.mapInArrow(run, f"pos {lines.schema['pos'].dataType.simpleString()}, doc string, id string, classification string, note string")


def applied_outcomes(images: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(doc, id, status, note): awaiting images take the first outcome that names them.

    An outcome with a path must name the document or end with it; one without applies only if a single
    document awaits that id.
    """
    status = F.when(F.col("classification") == "content", "analyzed").otherwise(F.col("classification"))
    waits = images.where(awaiting())
    only = waits.groupBy("id").agg(F.count_distinct("doc").alias("docs"))
    named = outcomes.withColumnRenamed("doc", "said")
    paired = waits.select("doc", "id").join(only, "id").join(named, "id")
    fits = F.when(F.col("said") == "", F.col("docs") == 1).otherwise((F.col("said") == F.col("doc")) | F.endswith(F.col("said"), F.concat(F.lit("/"), "doc")))
    first = paired.where(fits).groupBy("doc", "id").agg(F.min_by(F.struct(status.alias("status"), "note"), "pos").alias("o"))
    return images.select("doc", "id", F.col("status").alias("had")).join(first, ["doc", "id"], "left").select("doc", "id", F.coalesce("o.status", "had").alias("status"), F.col("o.note").alias("note"))


def merged_findings(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc, id, status): items of a batch with the first finding for their id; ``failed`` without one."""
    first = findings.groupBy("doc", "id").agg(F.min_by("classification", "pos").alias("classification"))
    status = F.when(F.col("classification").isNull(), "failed").when(F.col("classification") == "content", "analyzed").otherwise(F.col("classification"))
    return items.select("doc", "id").join(first, ["doc", "id"], "left").select("doc", "id", status.alias("status"))


def aggregated_warnings(warnings: DataFrame, *by: str) -> DataFrame:
    """(by, first_pos, warning) of warnings (by, pos, warning): repeats once with their number, in order of first occurrence.

    A number that a warning already has is counted in; applying it twice changes nothing.
    """
    flat = text.collapsed(F.col("warning"))
    counted = F.regexp_extract(flat, r"^(.*\S)\s+\(×(\d+)\)$", 2)
    plain = F.when(counted != "", F.regexp_extract(flat, r"^(.*\S)\s+\(×(\d+)\)$", 1)).otherwise(flat)
    rows = warnings.select(*by, "pos", plain.alias("text"), F.coalesce(counted.try_cast("bigint"), F.lit(1)).alias("n")).where("text <> ''")
    per = rows.groupBy(*by, "text").agg(F.sum("n").alias("n"), F.min("pos").alias("first_pos"))
    return per.select(*by, "first_pos", F.when(F.col("n") > 1, F.concat("text", F.lit(" (×"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("text")).alias("warning"))


# What a line tells of a picture, and that something went wrong with it; they decide which lines count as warnings.
PICTURE_WORDS = ["image", "visual", "chart", "diagram", "picture", "labels", "values", "axis", "legend", "font"]
FAULT_WORDS = ["unreadable", "uncertain", "failed", "skipped", "unable", "illegible"]
FAULT_PHRASES = ["could not", "not available"]


def limitation_lines(df: DataFrame, content: str) -> DataFrame:
    """(line): distinct lines that tell of an image that couldn't be read."""
    lines = df.select(F.explode(F.split(F.col(content), "\r?\n")).alias("line"))
    words = F.split(F.lower("line"), "[^a-z0-9_]+")
    any_of = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    fault = any_of(FAULT_WORDS) | F.lower("line").rlike(rf"\b(?:{'|'.join(FAULT_PHRASES)})\b")
    return lines.where(any_of(PICTURE_WORDS) & fault).select(paths.trimmed(F.col("line")).alias("line")).distinct()


def check_lines(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strict JSON test and pretty print of a column line, behind all other columns."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    for batch in batches_:
        out = []
        for line in batch.column(batch.num_columns - 1).to_pylist():
            try:
                out.append(json.dumps(json.loads(line, parse_constant=refuse), indent=2, ensure_ascii=False))
            except (ValueError, RecursionError):
                out.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "pretty"])


def line_records(lines: DataFrame) -> DataFrame:
    """(doc, pos, line, pretty, record_no, part_no) of lines (doc, pos, line): valid ones numbered from 1, a part for each thousand.

    Blank and null lines are skipped; invalid ones have no number. Lines are numbered within ranges of (doc, pos) and the
    ranges of a document then among each other, so a document of any length is spread over many tasks.
    """
    kept = lines.where(F.trim(F.col("line")) != "").select("doc", "pos", "line")
    types = {c: t for c, t in kept.dtypes}
    checked = kept.mapInArrow(check_lines, f"doc {types['doc']}, pos {types['pos']}, line string, pretty string")
    # Written once: ranges and their counts must be the same.
    ranged = cut(cut(checked).repartitionByRange("doc", "pos").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("doc", "range").agg(F.count("pretty").alias("n"))
    before = Window.partitionBy("doc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("doc", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("doc", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("own", F.count("pretty").over(within))
    good = own.join(counts, own["doc"].eqNullSafe(counts["doc"]) & (own["range"] == counts["range"])).select(own["doc"], "pos", "line", "pretty", F.when(F.col("pretty").isNotNull(), F.col("before") + F.col("own")).alias("record_no"))
    return good.withColumn("part_no", (F.floor((F.col("record_no") - 1) / RECORDS_A_PART) + 1).cast("int"))
