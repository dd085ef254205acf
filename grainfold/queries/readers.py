"""Queries over documents of every format: each input file is made into a small document, which is then read back.

The tables hold no documents, so these are made of the tables' values: what a reader has to give is then plain SQL.
"""

from __future__ import annotations

import base64
import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.functions import frontmatter
from grainfold.operators import intake, rewrite, wiki
from grainfold.plans import prepass, prompts
from grainfold.plans.runtime import spread, table
from grainfold.queries.wiki import CURRENT, concepts
from grainfold.sources import files as file_source
from grainfold.sources import images

NS = 'xmlns:w="w" xmlns:a="a" xmlns:r="r" xmlns:p="p" xmlns:c="c" xmlns:table="t" xmlns:text="x" xmlns:draw="d" xmlns:xlink="l"'


def container(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def picture(width: int, height: int, step: int) -> bytes:
    """A grey picture that rises by ``step`` from left to right and from row to row."""
    return images.encode_png(width, height, 1, bytes((step * (x + y)) % 251 for y in range(height) for x in range(width)))


def relations(*targets: str) -> str:
    return '<Relationships xmlns="r">' + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets, 1)) + "</Relationships>"


def docx(a: str, b: str, c: str) -> bytes:
    paragraph = lambda inner, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r>{inner}</w:r></w:p>'
    body = paragraph(f"<w:t>{a}</w:t>", "H") + paragraph(f'<w:t>{b}</w:t><a:blip r:embed="r1"/>') + paragraph('<c:chart r:id="r2"/>')
    chart = f"<c:x {NS}><a:t>{c}</a:t><c:ser><c:tx><c:v>{b}</c:v></c:tx><c:val><c:v>1</c:v><c:v>2</c:v></c:val></c:ser></c:x>"
    return container({"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>', "word/_rels/document.xml.rels": relations("media/i.png", "charts/chart1.xml"), "word/charts/chart1.xml": chart, "word/media/i.png": picture(40, 40, 3)})


def xlsx(a: str, b: str, c: str) -> bytes:
    rows = f'<w:row r="1"><w:c r="A1" t="s"><w:v>0</w:v></w:c><w:c r="B1" t="inlineStr"><w:is><w:t>{b}</w:t></w:is></w:c></w:row><w:row r="3"><w:c r="B3" t="b"><w:v>1</w:v></w:c></w:row>'
    return container({"xl/workbook.xml": f'<w:x {NS}><w:sheet name="{c}" r:id="r1"/></w:x>', "xl/_rels/workbook.xml.rels": relations("worksheets/sheet1.xml"), "xl/sharedStrings.xml": f"<w:s {NS}><w:si><w:t>{a}</w:t></w:si></w:s>", "xl/worksheets/sheet1.xml": f"<w:x {NS}>{rows}</w:x>"})


def pptx(a: str, b: str, c: str) -> bytes:
    slide = lambda *t: f"<p:s {NS}>{''.join(f'<a:t>{x}</a:t>' for x in t)}<a:blip r:embed=\"r1\"/></p:s>"
    return container({"ppt/slides/slide10.xml": slide(a, b), "ppt/slides/slide2.xml": slide(c), "ppt/slides/_rels/slide10.xml.rels": relations("../media/i.png"), "ppt/media/i.png": picture(40, 40, 3)})


def odt(a: str, b: str, c: str) -> bytes:
    return container({"content.xml": f'<o {NS}><text:h>{a}</text:h><text:p>{b} <i xlink:href="Pictures/i.png"/>{c}</text:p></o>', "Pictures/i.png": picture(40, 40, 3)})


def ods(a: str, b: str, c: str) -> bytes:
    cell = lambda t, more="": f"<table:table-cell{more}><text:p>{t}</text:p></table:table-cell>"
    twice = ' table:number-columns-repeated="2"'
    rows = f"<table:table-row>{cell(a)}{cell(b, twice)}</table:table-row><table:table-row table:number-rows-repeated=\"2\">{cell(c)}</table:table-row>"
    return container({"content.xml": f'<o {NS}><table:table table:name="S">{rows}</table:table></o>'})


def odp(a: str, b: str, c: str) -> bytes:
    return container({"content.xml": f"<o {NS}><draw:page><text:p>{a}</text:p></draw:page><draw:page/><draw:page><text:p>{b}</text:p><text:p>{c}</text:p></draw:page></o>"})


def epub(a: str, b: str, c: str) -> bytes:
    package = '<p xmlns="p"><item id="x" href="x.xhtml"/><item id="y" href="y.xhtml"/><itemref idref="y"/><itemref idref="x"/></p>'
    return container({"META-INF/container.xml": '<c xmlns="c"><rootfile full-path="O/p.opf"/></c>', "O/p.opf": package, "O/x.xhtml": f"<p>{a}</p><p>{b}</p>", "O/y.xhtml": f"<style>no</style><p>{c} &amp; more</p>"})


def html(a: str, b: str, c: str) -> bytes:
    uri = base64.b64encode(picture(40, 40, 3)).decode()
    return f'<html><head><title>no</title></head><body><h1>{a}</h1><p>{b} <a href="/x">{c}</a></p><ol><li>{a}</li><li>{b}</li></ol><figure><img alt="{c}" src="data:image/png;base64,{uri}"><figcaption>{b}</figcaption></figure><script>no()</script></body></html>'.encode()


def rtf(a: str, b: str, c: str) -> bytes:
    euro = "\\" + "u8364?"
    return rf"{{\rtf1{{\fonttbl{{\f0 Arial;}}}}{{\*\generator no;}}{a}\par {{\b {b}}}\tab {c} \'e9{euro}}}".encode()


def ipynb(a: str, b: str, c: str) -> bytes:
    cells = [{"cell_type": "markdown", "source": [f"# {a}\n", b]}, {"cell_type": "code", "source": f"x = '```{c}'", "outputs": [{"data": {"image/png": base64.b64encode(picture(40, 40, 3)).decode()}}]}]
    return json.dumps({"metadata": {"language_info": {"name": "python"}}, "cells": cells}).encode()


def pdf(a: str, b: str, c: str) -> bytes:
    page = zlib.compress(f"BT /F1 12 Tf ({a}) Tj 0 -14 Td [({b}) -20 (!)] TJ ET BT ({c}) Tj ET".encode())
    return b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + page + b"\nendstream endobj"


MAKERS = {f.__name__: f for f in (docx, xlsx, pptx, odt, ods, odp, epub, html, rtf, ipynb, pdf)}


def made(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(file_id, name, data): a document of one format for every input file."""
    maker = MAKERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, f"{a}.{kind}", maker(a, b, c)) for k, a, b, c in zip(*(x.to_pylist() for x in batch.columns))]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.binary()))], names=["file_id", "name", "data"])

    f = table(spark, sf_dir, "input_files").select("file_id", F.concat(F.lit("F"), F.col("file_id").cast("string")).alias("a"), F.coalesce("bundle_id", F.lit("none")).alias("b"), F.coalesce("classification", F.lit("none")).alias("c"))
    return spread(f).mapInArrow(run, "file_id bigint, name string, data binary")


def reading(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = file_source.extract_documents(made(spark, sf_dir, kind), "file_id", "name", "data")
        image = F.try_element_at("images", F.lit(1))
        return found.select("file_id", "source_format", F.array_join("parts", "\n").alias("text"), F.size("images").cast("bigint").alias("n_images"), image["location"].alias("location"), image["context"].alias("context"))

    run.__doc__ = f"Every input file as a document of the format {kind}, read back."
    return run


def image_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for every input file, of a size and a pattern that follow from its number, inspected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [images.encode_png(w, h, 1, bytes(w * h)) if n % 3 == 0 else picture(w, h, 2) for n in batch.column(0).to_pylist() for w, h in [(4 + n * 7 % 60, 4 + n * 11 % 90)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["file_id", "data"])

    made_ = spread(table(spark, sf_dir, "input_files").select("file_id")).mapInArrow(run, "file_id bigint, data binary")
    return images.inspected(made_.withColumn("media", F.lit("image/png")), "file_id", "data", "media").select("file_id", "width", "height", "verdict")


def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes told by the headers of GIF and BMP pictures."""
    little = lambda c, n: F.concat(*[F.unhex(F.lpad(F.hex(F.floor(c / 256**k) % 256), 2, "0")) for k in range(n)])
    f = table(spark, sf_dir, "input_files").select("file_id", (F.col("file_id") % 900 + 33).alias("w"), (F.col("file_id") % 700 + 40).alias("h"))
    gif = F.concat(F.lit("GIF89a").cast("binary"), little(F.col("w"), 2), little(F.col("h"), 2))
    bmp = F.concat(F.lit("BM").cast("binary"), F.unhex(F.lit("00" * 16)), little(F.col("w"), 4), little(F.col("h"), 4))
    both = f.select("file_id", gif.alias("data"), F.lit("image/gif").alias("media")).union(f.select("file_id", bmp, F.lit("image/bmp")))
    found = images.inspected(both.select(F.concat_ws(":", "file_id", "media").alias("key"), "data", "media"), "key", "data", "media")
    return found.select("key", "width", "height")


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would say of the parts of each file, one part a batch, read back: fenced, bare or broken answers."""
    p = table(spark, sf_dir, "extracted_parts").select(F.col("part_row").cast("string").alias("doc"), F.lit(1).alias("batch"), F.lit("img-01").alias("id"), F.array(F.col("staged_name")).alias("locations"), F.col("lang").alias("context"), F.lit("image/png").alias("media"), F.lit(b"").alias("data"))

    def analyse(items: list[dict]) -> prepass.Answer:
        kind = {None: "unreadable", "en": "content", "de": "decorative"}.get(items[0]["context"], "odd")
        text = json.dumps({"findings": [{"id": "img-01", "classification": kind, "description": f" in {items[0]['context']} ", "legible_values": [1, " ", "x"]}]})
        return prepass.Answer(f"Here it is:\n```json\n{text}\n```" if kind == "content" else f"So: {text}" if kind != "odd" else text, 10, 5, 0.5)

    found = prepass.run_prepass(p.where("doc is not null"), analyse)
    return found.select(F.col("doc").cast("bigint").alias("part_row"), "status", "description", F.array_join("legible_values", ",").alias("values"), "input_tokens", "output_tokens")


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of what the calls for all documents have used, two images a document."""
    p = table(spark, sf_dir, "input_files").select(F.col("file_id").cast("string").alias("doc"), F.explode(F.array(F.lit("img-01"), F.lit("img-02"))).alias("id"))
    batches = p.select("doc", F.lit(1).alias("batch"), "id", F.array().cast("array<string>").alias("locations"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("media"), F.lit(None).cast("binary").alias("data"))
    return prepass.usage(prepass.run_prepass(batches, lambda items: prepass.Answer("{}", 100, len(items), 0.25)))


def findings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A findings file for every input file with parts, each part standing for an image and its staged name for the place."""
    p = table(spark, sf_dir, "extracted_parts").where("part_no < 90").groupBy("file_id", "part_no").agg(F.min("staged_name").alias("place"), F.count("*").alias("n"))
    number = F.lpad(F.col("part_no").cast("string"), 2, "0")
    i = p.select(
        F.col("file_id").cast("string").alias("doc"), F.concat(F.lit("img-"), number).alias("id"), F.when(F.col("part_no") % 2 == 0, "failed").otherwise("analyzed").alias("status"), F.when(F.col("part_no") % 2 == 0, "no answer").alias("reason"),
        F.array(F.struct(F.col("place").alias("location"), F.lit(" one\ntwo ").alias("context")), F.struct(F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("context"))).alias("occurrences"),
        F.when(F.col("part_no") % 2 == 1, "seen").alias("description"), F.when(F.col("part_no") % 2 == 1, F.array(F.lit("v"))).alias("legible_values"), F.lit(None).cast("array<string>").alias("uncertainties"),
    )
    return prepass.render_findings(i).select(F.col("doc").cast("bigint").alias("file_id"), "content")


def prompt_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the agent is told about every input file."""
    f = table(spark, sf_dir, "input_files").where("relative_path is not null")
    known = f.groupBy("relative_path").agg(F.min_by(F.struct("source_format", F.col("archive_path").alias("target"), F.col("extracted_text_paths").alias("texts"), F.col("extraction_warnings").alias("warnings")), "file_id").alias("x")).select("relative_path", "x.*", F.lit(None).cast("string").alias("findings"))
    i = known.where(F.size("texts") > 0).select(F.col("relative_path").alias("doc"), F.lit("img-01").alias("id"), F.lit("failed").alias("status"), F.array(F.struct(F.lit("p 1").alias("location"), F.lit(None).cast("string").alias("context"))).alias("occurrences"), F.lit("i.png").alias("path"))
    return prompts.file_entries(known, i)


def structure_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories, types and ids of the knowledge base, as an agent is shown them."""
    return wiki.structure(concepts(spark, sf_dir))


def citations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as the citations of an older page for each concept, migrated: what they become."""
    s = table(spark, sf_dir, "source_entries").where("concept_id is not null and resource is not null")
    s = s.where(~F.col("resource").rlike(r"[\s<>()\[\]]") & F.col("resource").rlike("^[a-z/]")).select("concept_id", "resource").distinct()
    line = F.concat(F.lit("- [Name]("), "resource", F.lit(")"))
    pages = s.groupBy("concept_id").agg(F.concat(F.lit("---\ntype: T\n---\n\nText\n\n# Citations\n\n```\n# Citations\n```\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n\n## Next\nmore\n")).alias("content"))
    new = frontmatter.parse_documents(rewrite.migrated(pages), "concept_id", "content")
    return new.select("concept_id", F.explode("frontmatter.sources").alias("s"), "body").select("concept_id", "s.resource", "s.title", F.col("body").contains("Text\n\n## Next").alias("without_section"))


def repaired_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter with values that break YAML: colons, stars and tabs, of every bundle."""
    b = table(spark, sf_dir, "bundles")
    head = F.concat(F.lit("---\ntype: report: "), "bundle_id", F.lit("\ntitle: *"), "bundle_id", F.lit("* and: more\nstatus: draft\ntags: [a, "), "bundle_id", F.lit("]\n---\nbody"))
    found = frontmatter.parse_documents(b.select("bundle_id", head.alias("content")), "bundle_id", "content")
    return found.select("bundle_id", "frontmatter.type", "frontmatter.title", "frontmatter.status", F.element_at("frontmatter.tags", -1).alias("tag"), "body")


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts written as documents with front matter and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [frontmatter.serialise({"type": kind, "title": title, "extra": {"n": 1}}, body or "") for _, kind, title, body in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["concept_id", "content"])

    c = concepts(spark, sf_dir).select("concept_id", "concept_type", "title", "body")
    found = frontmatter.parse_documents(c.mapInArrow(run, "concept_id string, content string"), "concept_id", "content")
    return found.select("concept_id", "frontmatter.type", "frontmatter.title", F.get_json_object("frontmatter.raw_json", "$.extra.n").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [image_verdicts, header_sizes, parsed_answers, model_usage, findings_text, prompt_entries, structure_preview, citations_of, repaired_frontmatter, round_trips]
    return {f"read_{kind}": reading(kind) for kind in MAKERS} | {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    values = "v as (select file_id, 'F' || file_id as a, coalesce(bundle_id, 'none') as b, coalesce(classification, 'none') as c from input_files)"
    nl = "chr(10)"
    #: Format: text, number of images, location and context of the first one.
    read = {
        "docx": (f"a || {nl} || {nl} || b || {nl} || {nl} || '## Embedded chart 1: ' || c || {nl} || 'Context: Section: ' || a || ', paragraph 3' || {nl} || 'Surrounding text: ' || b || {nl} || '- ' || b || '; values: 1, 2'", 1, "'Section: ' || a || ', paragraph 2'", "b"),
        "xlsx": (f"'## Sheet: ' || c || {nl} || {nl} || '| ' || a || ' | ' || b || ' |' || {nl} || '| --- | --- |' || {nl} || '|  |  |' || {nl} || '|  | true |'", 0, "null", "null"),
        "pptx": (f"'## Slide 2' || {nl} || {nl} || c || {nl} || {nl} || '## Slide 10' || {nl} || {nl} || a || ' ' || b", 1, "'Slide 10'", "null"),
        "odt": ("a || ' ' || b || ' ' || c", 1, "'Section: ' || a", "a || ' — ' || b || ' ' || c"),
        "ods": (f"'## Sheet: S' || {nl} || {nl} || '| ' || a || ' | ' || b || ' | ' || b || ' |' || {nl} || '| --- | --- | --- |' || {nl} || '| ' || c || ' |  |  |' || {nl} || '| ' || c || ' |  |  |'", 0, "null", "null"),
        "odp": (f"'## Slide 1' || {nl} || {nl} || a || {nl} || {nl} || '## Slide 3' || {nl} || {nl} || b || ' ' || c", 0, "null", "null"),
        "epub": (f"c || ' & more' || {nl} || {nl} || a || ' ' || b", 0, "null", "null"),
        "html": (f"upper(a) || {nl} || {nl} || b || ' ' || c || ' (/x)' || {nl} || {nl} || ' 1. ' || a || {nl} || ' 2. ' || b || {nl} || {nl} || b", 1, "'Section: ' || a", "b || ' — Image alt text: ' || c"),
        "rtf": (f"a || {nl} || b || chr(9) || c || ' é€'", 0, "null", "null"),
        "ipynb": (f"'# ' || a || {nl} || b || {nl} || {nl} || '````python' || {nl} || 'x = ''```' || c || '''' || {nl} || '````'", 1, "'Cell 2'", "'x = ''```' || c || ''''"),
        "pdf": (f"a || {nl} || b || '!' || {nl} || c", 0, "null", "null"),
    }
    told = {f"read_{k}": f"with {values} select file_id, '{k}' as source_format, {text} as text, {n}::bigint as n_images, {where} as location, {around} as context from v" for k, (text, n, where, around) in read.items()}
    current = f"with {CURRENT}"
    shown = "p as (select file_id, part_no, min(staged_name) as place from extracted_parts where part_no < 90 group by all)"
    block = f"'## img-' || lpad(part_no::varchar, 2, '0') || case when part_no % 2 = 0 then ' — failed' || {nl} || 'Reason: no answer' else ' — analyzed' end || {nl} || 'Location: ' || coalesce(place, 'unknown') || ' — near: one two' || {nl} || 'Also at: unknown' || case when part_no % 2 = 1 then {nl} || 'Description: seen' || {nl} || 'Legible values:' || {nl} || '  - v' else '' end"
    dirs = "case when concept_id like '%/%' then regexp_replace(concept_id, '/[^/]*$', '') else '' end"
    return told | {
        "image_verdicts": "with v as (select file_id, 4 + file_id * 7 % 60 as w, 4 + file_id * 11 % 90 as h from input_files) select file_id, w::int as width, h::int as height, case when (w < 32 and h < 32) or least(w, h) < 8 then 'tiny' when greatest(w, h)::double / least(w, h) > 40 or file_id % 3 = 0 then 'broken' else 'content' end as verdict from v",
        "header_sizes": "select file_id || ':' || m as key, (file_id % 900 + 33)::int as width, (file_id % 700 + 40)::int as height from input_files cross join (values ('image/gif'), ('image/bmp')) t(m)",
        "parsed_answers": "select part_row, case when lang is null then 'unreadable' when lang = 'en' then 'analyzed' when lang = 'de' then 'decorative' else 'failed' end as status, case when lang is null then 'in None' when lang in ('en', 'de') then 'in ' || lang end as description, case when lang is null or lang in ('en', 'de') then '1,x' end as values, 10::bigint as input_tokens, 5::bigint as output_tokens from extracted_parts",
        "model_usage": "select count(*) as calls, (100 * count(*))::bigint as input_tokens, (2 * count(*))::bigint as output_tokens, 0.25 * count(*)::double as cost from input_files",
        "findings_text": f"with {shown} select file_id, 'Image findings for input/' || file_id || {nl} || count(*) || ' unique image(s), ' || 2 * count(*) || ' occurrence(s). Status: staged 0, analyzed ' || count(*) filter (where part_no % 2 = 1) || ', decorative 0, unreadable 0, broken 0, failed ' || count(*) filter (where part_no % 2 = 0) || '.' || {nl} || {nl} || string_agg({block}, {nl} || {nl} order by part_no) || {nl} as content from p group by file_id",
        "prompt_entries": f"with f as (select * from (select *, row_number() over (partition by relative_path order by file_id) as k from input_files where relative_path is not null) where k = 1) select relative_path, '- input/' || relative_path || coalesce(' (' || source_format || ')', '') || ' -> ' || archive_path || case when len(extracted_text_paths) > 0 then {nl} || '  Extracted text, ' || len(extracted_text_paths) || ' part(s): ' || array_to_string(extracted_text_paths, ', ') || {nl} || '  Images: 1 unique, 1 occurrence(s)' || {nl} || '  Images not analysed, to be reported under \"{prompts.OUTCOMES}\":' || {nl} || '    - img-01: i.png — p 1' else '' end || case when len(extraction_warnings) > 0 then {nl} || '  Limits of the extraction, for the log: ' || array_to_string(extraction_warnings, '; ') else '' end as entry from f",
        "structure_preview": f"{current} select 'directory' as part, d as name, null::bigint as n from (select distinct {dirs} as d from cur) where d <> '' union all select 'type', coalesce(concept_type, '(untyped)'), count(*) from cur group by 2 union all select 'concept', concept_id, null from cur",
        "citations_of": r"select distinct concept_id, resource, 'Name' as title, true as without_section from source_entries where concept_id is not null and not regexp_matches(resource, '[\s<>()\[\]]') and regexp_matches(resource, '^[a-z/]')",
        "repaired_frontmatter": "select bundle_id, 'report: ' || bundle_id as type, '*' || bundle_id || '* and: more' as title, 'draft' as status, bundle_id as tag, 'body' as body from bundles",
        "round_trips": f"{current} select concept_id, nullif(concept_type, '') as type, nullif(title, '') as title, '1' as n from cur",
    }
