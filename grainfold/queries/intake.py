"""Queries over input files and what is extracted from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.functions import paths, text
from grainfold.operators import intake, wiki
from grainfold.plans.runtime import table

STAMP = "2026-01-01-0000"
#: Limits for the tables' small payloads.
SIZE, MOST, LARGEST = 5, 6000, 4000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "input_files")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracted_parts")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the images of their file, with a status made of their number and what they hold."""
    status = F.element_at(F.array(*map(F.lit, intake.STATUSES)), (F.pmod(F.col("part_row"), F.lit(6)) + 1).cast("int"))
    return parts(spark, sf_dir).select(F.col("file_id").cast("string").alias("doc"), F.concat(F.lit("img-"), F.lpad(F.col("part_no").cast("string"), 2, "0"), F.lit("-"), F.col("part_row").cast("string")).alias("id"), status.alias("status"), F.lit(1).alias("occurrences"), F.coalesce(F.octet_length("part_text"), F.lit(0)).cast("bigint").alias("byte_length"), F.col("part_row").alias("pos"), "part_text", "part_no")


def classify_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("relative_path is not null").select("file_id", intake.classified(F.col("relative_path")).alias("c")).select("file_id", "c.bucket", "c.reason")


def ignored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = files(spark, sf_dir).select("file_id", F.col("ignore_reason").alias("reason"))
    both = classify_inputs(spark, sf_dir).where("bucket = 'ignored'").select("file_id", "reason").union(told).where("reason is not null").distinct()
    return both.groupBy("reason").agg(F.count("*").alias("n")).withColumn("phrase", text.lookup(text.REASONS, F.col("reason")))


def detect_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for the agent without any extracted part."""
    agent = classify_inputs(spark, sf_dir).where("bucket = 'non-conformant'").select("file_id")
    remaining = files(spark, sf_dir).select("file_id").join(parts(spark, sf_dir).select("file_id").distinct(), "file_id", "left_anti")
    return agent.join(remaining, "file_id", "left_semi")


def archive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("relative_path is not null")
    return intake.archive_targets(f, files(spark, sf_dir).select(F.col("archive_path").alias("target")), "file_id", "relative_path", STAMP)


def staged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("relative_path is not null").withColumn("n", F.size(F.coalesce("extracted_text_paths", F.array().cast("array<string>"))))
    return intake.staged_names(f, "file_id", "relative_path", "n")


def image_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = images(spark, sf_dir).select("doc", "pos", F.col("part_text").alias("data"), F.col("part_no").alias("location"))
    return intake.catalogue(payloads)


def image_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.batches(images(spark, sf_dir).select("doc", "pos", "byte_length"), SIZE, MOST, LARGEST)


def image_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.status_counts(images(spark, sf_dir))


def images_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).where(intake.awaiting()).select("doc", "id")


def document_image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.document_summary(images(spark, sf_dir))


def staging_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir)
    count = lambda c, name: F.count_if(c).alias(name)
    return i.groupBy("doc").agg(
        F.count("*").alias("occurrences"), count(F.trim(F.coalesce("part_text", F.lit(""))) != "", "with_context"), F.count_distinct("part_text").alias("uniques"),
        (F.count("part_text") - F.count_distinct("part_text")).alias("duplicates"), count(F.col("status") == "decorative", "tiny"), count(F.col("status") == "broken", "broken"),
        count(F.col("status") == "staged", "staged"), count(F.col("part_text").isNull(), "dropped"),
    )


def fallback_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = images(spark, sf_dir).where(intake.awaiting() & F.col("part_text").isNotNull())
    return waits.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where(F.col("n") <= intake.FALLBACK_IMAGES).select("doc", "id")


def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each awaiting image, some with the path of their document."""
    i = images(spark, sf_dir).where(intake.awaiting())
    kind = F.element_at(F.array(F.lit("content"), F.lit("decorative"), F.lit("unreadable")), (F.pmod(F.col("pos"), F.lit(3)) + 1).cast("int"))
    path = F.when(F.pmod(F.col("pos"), F.lit(2)) == 0, F.concat(F.lit("input/"), "doc", F.lit(" "))).otherwise(F.lit(""))
    return i.select("pos", F.concat(F.lit("- "), path, F.lit("`img-0"), F.col("part_no").cast("string"), F.lit("`: "), kind, F.lit(" - note "), F.col("pos").cast("string")).alias("line"))


def plain_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir)
    return i.groupBy("doc", F.concat(F.lit("img-0"), F.col("part_no").cast("string")).alias("id")).agg(F.min_by("status", "pos").alias("status"))


def agent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.applied_outcomes(plain_images(spark, sf_dir), intake.parsed_outcomes(outcome_lines(spark, sf_dir)))


def findings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake.parsed_outcomes(outcome_lines(spark, sf_dir)).where("doc <> ''")
    return intake.merged_findings(plain_images(spark, sf_dir), found)


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("bundle_id", "file_id", F.posexplode("extraction_warnings").alias("i", "warning")).select("bundle_id", (F.col("file_id") * 1000 + F.col("i")).alias("pos"), "warning").where("warning is not null")


def aggregate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.aggregated_warnings(warnings(spark, sf_dir), "bundle_id")


def warning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.limitation_lines(table(spark, sf_dir, "documents"), "text")


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where("part_text is not null").select("part_row", text.stripped_markup(F.col("part_text")).alias("text"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("part_text", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return parts(spark, sf_dir).select("part_row", F.explode(found).alias("href")).groupBy("part_row", "href").agg(F.count("*").alias("n"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frontmatter_raw").select(F.concat_ws("/", "feed_id", F.col("file_no").cast("string")).alias("doc"), F.col("raw_id").alias("pos"), F.col("raw_json").alias("line"))


def jsonl_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = intake.line_records(raw_lines(spark, sf_dir)).where("record_no is not null")
    return r.groupBy("doc", "part_no").agg(F.min("record_no").alias("first_record"), F.max("record_no").alias("last_record"), F.count("*").alias("n_records"))


def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = intake.line_records(raw_lines(spark, sf_dir)).where("record_no is null")
    first = bad.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    return first.where(F.col("k") <= intake.NAMED_BAD_LINES).select("doc", "pos")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under each heading: the last heading line at or above them."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    head = F.when(F.col("line").rlike(r"^#{1,6} \S"), F.trim(F.regexp_replace("line", "\r", "")))
    under = document_lines(spark, sf_dir).withColumn("heading", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return under.groupBy("doc_id", F.coalesce("heading", F.lit("")).alias("heading")).agg(F.count("*").alias("n_lines"))


def preceding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each heading line the last line with text above it."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.trim(F.regexp_replace("line", "\r", "")) != "", F.trim(F.regexp_replace("line", "\r", "")))
    lines = document_lines(spark, sf_dir).withColumn("before", F.last(filled, ignorenulls=True).over(order))
    return lines.where(F.col("line").rlike(r"^#{1,6} \S")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("before", F.lit("")).alias("before"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.when(~F.isnan("usage_count"), F.col("usage_count"))
    return table(spark, sf_dir, "source_entries").groupBy("bundle_id").agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum(valid), F.lit(0.0)), 4).alias("usage"))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.agg(F.count("*").alias("n_files"), F.count_if(F.col("ignore_reason").isNotNull()).alias("ignored"), F.count_if(F.col("classification") == "conformant").alias("imported"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))


def log_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the update log: creations, updates and removals since the snapshot, then warnings."""
    from grainfold.queries.wiki import LOG_DATE, snapshot_diff

    diff = snapshot_diff(spark, sf_dir).select(F.col("change").alias("kind"), F.col("concept_id").alias("subject"), F.lit(None).cast("string").alias("object"))
    gone = table(spark, sf_dir, "removals").select(F.lit("removed"), "concept_id", "trash_path")
    warned = intake.aggregated_warnings(warnings(spark, sf_dir).drop("bundle_id")).select(F.lit("warning"), "warning", F.lit(None).cast("string"))
    return wiki.log_lines(diff.union(gone).union(warned)).select(F.lit(LOG_DATE).alias("date"), "part", "line")


def resolved_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of the input tree with the number and bytes of the files directly in them."""
    return files(spark, sf_dir).where("relative_path is not null").groupBy(paths.directory(F.col("relative_path")).alias("dir")).agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [classify_inputs, ignored_buckets, detect_leftover, archive_targets, staged_names, image_catalog, image_batches, image_status_counts, images_missing, document_image_summary, staging_statistics, fallback_images, agent_outcomes, findings_merge, aggregate_warnings, warning_lines, html_strip, html_links, jsonl_parts, jsonl_bad_lines, nearest_heading, preceding_text, usage_totals, report_counts, log_entry, resolved_parents]
    return {f.__name__: f for f in found}


SUFFIXES = {"md": ["md", "markdown"], "known": [s[1:] for s in intake.TEXT_SUFFIXES + intake.IMAGE_SUFFIXES + intake.EXTRACTED_SUFFIXES]}
DIR = "case when {0} like '%/%' then regexp_replace({0}, '/[^/]*$', '') else '' end"


def oracle_sql() -> dict[str, str]:
    md, known = (f"regexp_matches(lower(relative_path), '\\.({'|'.join(SUFFIXES[k])})$')" for k in ("md", "known"))
    name = "regexp_replace(regexp_replace(relative_path, '(?i)\\.markdown$', '.md'), '^.*/', '')"
    classes = f"classes as (select file_id, case when {name} in ('index.md', 'log.md') then 'ignored' when {md} then 'conformant' when {known} then 'non-conformant' else 'ignored' end as bucket, case when {name} in ('index.md', 'log.md') then 'reserved' when not {md} and not {known} then 'unsupported' end as reason from input_files where relative_path is not null)"
    states = "[" + ", ".join(f"'{s}'" for s in intake.STATUSES) + "]"
    img = f"img as (select file_id::varchar as doc, 'img-' || lpad(part_no::varchar, 2, '0') || '-' || part_row as id, ({states})[part_row % 6 + 1] as status, coalesce(octet_length(encode(part_text)), 0) as byte_length, part_row as pos, part_text, part_no from extracted_parts)"
    counts = ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in intake.STATUSES)
    told = " || ', ' || ".join(f"'{s} ' || {s}" for s in intake.STATUSES)
    plain = "plain as (select doc, 'img-0' || part_no as id, arg_min(status, pos) as status from img group by all)"
    lines = "outcomes as (select pos, case when pos % 2 = 0 then doc else '' end as said, 'img-0' || part_no as id, (['content', 'decorative', 'unreadable'])[pos % 3 + 1] as c, 'note ' || pos as note from img where status in ('staged', 'failed'))"
    state = "case when c = 'content' then 'analyzed' else c end"
    warned = r"w as (select bundle_id, file_id * 1000 + i as pos, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g') as t from (select bundle_id, file_id, generate_subscripts(extraction_warnings, 1) - 1 as i, unnest(extraction_warnings) as x from input_files) where x is not null), v as (select bundle_id, pos, case when regexp_matches(t, '^(.*\S)\s+\(×(\d+)\)$') then regexp_extract(t, '^(.*\S)\s+\(×(\d+)\)$', 1) else t end as t, coalesce(try_cast(nullif(regexp_extract(t, '^(.*\S)\s+\(×(\d+)\)$', 2), '') as bigint), 1) as n from w)"
    shown = "case when sum(n) > 1 then t || ' (×' || sum(n)::bigint || ')' else t end as warning"
    good = "l as (select feed_id || '/' || file_no as doc, raw_id as pos, raw_json as line, json_valid(raw_json) as ok from frontmatter_raw where trim(raw_json) <> '')"
    doclines = "dl as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents where text is not null)"
    strip = r"regexp_replace(regexp_replace(regexp_replace(part_text, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for e, s in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        strip = f"replace({strip}, '{e}', '{s}')"
    base = "regexp_replace({0}, '^(.+)\\.[^.]*$', '\\1')"
    last = "regexp_replace(relative_path, '^.*/', '')"
    into = f"case when relative_path like '%/%' then {DIR.format('relative_path')} || '/' else '' end"
    end = f"case when regexp_matches({last}, '^.+\\.[^.]*$') then regexp_extract({last}, '(\\.[^.]*)$', 1) else '' end"
    from grainfold.queries.wiki import LOG_DATE
    from grainfold.queries.wiki import oracle_sql as wiki_sql

    diff = wiki_sql()["snapshot_diff"]
    phrases = " ".join(f"when '{k}' then '{v}'" for k, v in text.REASONS.items())
    nouns, faults = "|".join(intake.PICTURE_WORDS), "|".join(intake.FAULT_WORDS + intake.FAULT_PHRASES)
    shape = rf"(?i)\b({nouns})\b.*\b({faults})\b|\b({faults})\b.*\b({nouns})\b"
    return {
        "classify_inputs": f"with {classes} select * from classes",
        "ignored_buckets": f"with {classes} select reason, count(*) as n, case reason {phrases} end as phrase from (select file_id, reason from classes where bucket = 'ignored' union select file_id, ignore_reason from input_files) where reason is not null group by 1",
        "detect_leftover": f"with {classes} select file_id from classes where bucket = 'non-conformant' and file_id not in (select file_id from extracted_parts where file_id is not null)",
        "archive_targets": f"""with wish as (select file_id, 'archive/' || {into} || {last} || o as plain, 'archive/' || {into} || {base.format(last)} || '.{STAMP}' as head, {end} || o as tail from (select *, case when relative_path like '%.md' then '.orig' else '' end as o from input_files where relative_path is not null)),
ranked as (select *, row_number() over (partition by plain order by file_id) - 1 + (plain in (select archive_path from input_files))::int as step from wish)
select file_id, case when step = 0 then plain when step = 1 then head || tail else head || '.' || (step - 1) || tail end as target from ranked""",
        "staged_names": f"""with wish as (select file_id, {into} || {base.format(last)} as b, lower(substr({end}, 2)) as e, greatest(coalesce(len(extracted_text_paths), 1), 1) as parts from input_files where relative_path is not null),
named as (select *, case when row_number() over (partition by b order by file_id) = 1 then b || '-extracted' else b || '.' || e || '-extracted' end as base from wish), each as (select *, unnest(range(1, parts + 1))::int as part_no from named)
select file_id, part_no, case when parts = 1 then base || '.txt' else base || '.part' || lpad(part_no::varchar, greatest(2, length(part_no::varchar))::int, '0') || '.txt' end as name from each""",
        "image_catalog": f"""with {img}, per as (select doc, sha256(part_text) as sha256, max(byte_length)::bigint as byte_length, count(*) as occurrences, min(pos) as first_pos from img where part_text is not null group by 1, 2)
select doc, 'img-' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') as id, sha256, byte_length, occurrences, first_pos from (select *, row_number() over (partition by doc order by first_pos, sha256) as n from per)""",
        "image_batches": f"""with recursive {img}, o as (select doc, pos, byte_length, row_number() over (partition by doc order by pos) as k from img where byte_length <= {LARGEST}),
r as (select doc, pos, byte_length, k, 1 as batch, 1 as n, byte_length as total from o where k = 1
union all select o.doc, o.pos, o.byte_length, o.k, case when r.n >= {SIZE} or r.total + o.byte_length > {MOST} then r.batch + 1 else r.batch end, case when r.n >= {SIZE} or r.total + o.byte_length > {MOST} then 1 else r.n + 1 end, case when r.n >= {SIZE} or r.total + o.byte_length > {MOST} then o.byte_length else r.total + o.byte_length end from r join o on o.doc = r.doc and o.k = r.k + 1)
select doc, pos, byte_length, batch from r union all select doc, pos, byte_length, null from img where byte_length > {LARGEST}""",
        "image_status_counts": f"with {img} select doc, {counts} from img group by 1",
        "images_missing": f"with {img} select doc, id from img where status in ('staged', 'failed')",
        "document_image_summary": f"with {img}, per as (select doc, count(*) as n, string_agg(id, ', ' order by id) filter (where status in ('staged', 'failed')) as missing, {counts} from img group by 1) select doc, doc || ': ' || n || ' occurrence(s), ' || n || ' unique — ' || {told} || '; missing findings: ' || coalesce(missing, 'none') as summary from per",
        "staging_statistics": f"with {img} select doc, count(*) as occurrences, count(*) filter (where trim(coalesce(part_text, '')) <> '') as with_context, count(distinct part_text) as uniques, count(part_text) - count(distinct part_text) as duplicates, count(*) filter (where status = 'decorative') as tiny, count(*) filter (where status = 'broken') as broken, count(*) filter (where status = 'staged') as staged, count(*) filter (where part_text is null) as dropped from img group by 1",
        "fallback_images": f"with {img} select doc, id from (select *, row_number() over (partition by doc order by pos) as n from img where status in ('staged', 'failed') and part_text is not null) where n <= {intake.FALLBACK_IMAGES}",
        "agent_outcomes": f"""with {img}, {plain}, {lines}, waits as (select *, count(*) over (partition by id) as docs from plain where status in ('staged', 'failed')),
f as (select w.doc, w.id, arg_min({state}, o.pos) as s, arg_min(note, o.pos) as note from waits w join outcomes o on o.id = w.id and ((o.said = '' and w.docs = 1) or o.said = w.doc or (o.said <> '' and o.said like '%/' || w.doc)) group by 1, 2)
select p.doc, p.id, coalesce(s, p.status) as status, note from plain p left join f using (doc, id)""",
        "findings_merge": f"with {img}, {plain}, {lines}, f as (select said as doc, id, arg_min(c, pos) as c from outcomes where said <> '' group by 1, 2) select doc, id, case when c is null then 'failed' else {state} end as status from plain left join f using (doc, id)",
        "aggregate_warnings": f"with {warned} select bundle_id, min(pos) as first_pos, {shown} from v where t <> '' group by bundle_id, t",
        "warning_lines": f"select distinct regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from (select unnest(regexp_split_to_array(text, '\\r?\\n')) as line from documents) where regexp_matches(line, '{shape}')",
        "html_strip": f"select part_row, regexp_replace(regexp_replace({strip}, '\\s+', ' ', 'g'), '^ | $', '', 'g') as text from extracted_parts where part_text is not null",
        "html_links": "select part_row, href, count(*) as n from (select part_row, unnest(regexp_extract_all(part_text, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) as href from extracted_parts) group by all",
        "jsonl_parts": f"with {good}, r as (select doc, row_number() over (partition by doc order by pos) as record_no from l where ok) select doc, (1 + (record_no - 1) // {intake.RECORDS_A_PART})::int as part_no, min(record_no) as first_record, max(record_no) as last_record, count(*) as n_records from r group by 1, 2",
        "jsonl_bad_lines": f"with {good} select doc, pos from (select doc, pos, row_number() over (partition by doc order by pos) as k from l where not ok) where k <= {intake.NAMED_BAD_LINES}",
        "nearest_heading": f"with {doclines}, h as (select doc_id, last_value(case when regexp_matches(line, '^#{{1,6}} \\S') then trim(replace(line, chr(13), '')) end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as heading from dl) select doc_id, coalesce(heading, '') as heading, count(*) as n_lines from h group by 1, 2",
        "preceding_text": f"with {doclines}, h as (select *, last_value(nullif(trim(replace(line, chr(13), '')), '') ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from dl) select doc_id, pos, coalesce(before, '') as before from h where regexp_matches(line, '^#{{1,6}} \\S')",
        "usage_totals": "select bundle_id, count(*) as entries, round(coalesce(sum(usage_count) filter (where not isnan(usage_count)), 0), 4) as usage from source_entries group by 1",
        "report_counts": "select count(*) as n_files, count(ignore_reason) as ignored, count(*) filter (where classification = 'conformant') as imported, coalesce(sum(byte_length), 0)::bigint as bytes from input_files",
        "log_entry": f"""with d as ({diff}), {warned.replace('bundle_id, ', '')}
select '{LOG_DATE}' as date, 1 as part, '* **Creation**: Added [' || concept_id || '](/' || concept_id || '.md).' as line from d where change = 'created'
union all select '{LOG_DATE}', 2, '* **Update**: Updated [' || concept_id || '](/' || concept_id || '.md).' from d where change = 'updated'
union all select '{LOG_DATE}', 3, '* **Removal**: Removed [' || concept_id || '](' || coalesce(trash_path, '') || ').' from removals
union all select '{LOG_DATE}', 5, '* **Warning**: ' || warning from (select {shown} from v where t <> '' group by t)""",
        "resolved_parents": f"select {DIR.format('relative_path')} as dir, count(*) as n, coalesce(sum(byte_length), 0)::bigint as bytes from input_files where relative_path is not null group by 1",
    }
