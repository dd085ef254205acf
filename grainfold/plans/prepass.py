"""Analysis of embedded images by an outside model: staging, batches, tolerant reading of its answers, and findings.

The model call is a function from a batch to an answer, given by the caller; nothing here calls out.

Fixed values, as an agent reads them: the first line of a findings file, its count line and the names of its fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.operators import intake
from grainfold.sources import images

CLASSES = ("content", "decorative", "unreadable")
#: Longest context that a model and a reader are told; None for all of it.
CONTEXT, SHOWN_CONTEXT = 600, 300


@dataclass(frozen=True)
class Answer:
    """What a model says, and what the call has used."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    cost: float = 0.0


#: Batch of (id, locations, context, media, data) to the model's answer.
Analyse = Callable[[list[dict]], "Answer | str"]


def short(text: str | None, limit: int | None) -> str:
    flat = " ".join((text or "").split())
    return flat if limit is None or len(flat) <= limit else flat[:limit] + "…"


def instructions(items: list[dict], limit: int | None = CONTEXT) -> str:
    """What the model is asked about a batch."""
    told = []
    for i in items:
        context = short(i.get("context"), limit)
        told.append(f"{i['id']} at {', '.join(i.get('locations') or []) or 'an unknown place'}" + (f", near: {context}" if context else ""))
    return (
        "Describe each image below. Report legible values exactly, list what is uncertain, and guess nothing.\n"
        'Answer with JSON only: {"findings": [{"id": "...", "classification": "content|decorative|unreadable", "description": "...", "legible_values": ["..."], "uncertainties": ["..."]}]}\n\n' + "\n".join(told)
    )


def staged_images(extracted: DataFrame) -> DataFrame:
    """(doc, id, sha256, media, data, byte_length, occurrences, status, reason) of the distinct images of documents (doc, images).

    occurrences is the array of (location, context) in order; small and thin pictures are decorative, undecodable ones
    broken, all others staged. Ids follow the first occurrence within the document.
    """
    each = extracted.select("doc", F.posexplode("images").alias("pos", "i")).select("doc", "pos", F.col("i.media").alias("media"), F.col("i.data").alias("data"), F.col("i.location").alias("location"), F.col("i.context").alias("context"))
    each = each.where(F.col("data").isNotNull())
    named = intake.catalogue(each.select("doc", "pos", "data", "location")).select("doc", "id", "sha256", "byte_length")
    same = each.withColumn("sha256", F.sha2("data", 256)).groupBy("doc", "sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "location", "context"))).alias("o"), F.first("media").alias("media"), F.first("data").alias("data"))
    found = named.join(same, ["doc", "sha256"]).withColumn("key", F.struct("doc", "id"))
    judged = images.inspected(found, "key", "data", "media").select("key.doc", "key.id", "verdict", "reason")
    status = F.when(F.col("verdict") == "tiny", "decorative").when(F.col("verdict") == "broken", "broken").otherwise("staged")
    occurrences = F.transform("o", lambda x: F.struct(x["location"].alias("location"), x["context"].alias("context")))
    return found.join(judged, ["doc", "id"]).select("doc", "id", "sha256", "media", "data", "byte_length", occurrences.alias("occurrences"), status.alias("status"), "reason")


def request_batches(staged: DataFrame, size: int = intake.BATCH_SIZE, most: float = intake.BATCH_BYTES, largest: float = intake.IMAGE_BYTES) -> DataFrame:
    """(doc, batch, id, locations, context, media, data) of the images that await a model: distinct locations, the first context that isn't blank."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    waits = staged.where("status = 'staged'").withColumn("pos", number)
    batch = intake.batches(waits.select("doc", "pos", "byte_length"), size, most, largest).where("batch is not null").select("doc", "pos", "batch")
    places = F.array_compact(F.array_distinct(F.transform("occurrences", lambda o: o["location"])))
    context = F.try_element_at(F.filter(F.transform("occurrences", lambda o: o["context"]), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.lit(1))
    return waits.join(batch, ["doc", "pos"]).select("doc", "batch", "id", places.alias("locations"), context.alias("context"), "media", "data")


def payloads(answer: str) -> Iterator[object]:
    """Every JSON value that an answer may mean: a fenced block, the whole, the outermost object or list."""
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", answer, re.S)
    tries = [fenced.group(1)] if fenced else []
    tries.append(answer)
    for a, b in ("{}", "[]"):
        if 0 <= answer.find(a) < answer.rfind(b):
            tries.append(answer[answer.find(a) : answer.rfind(b) + 1])
    for t in tries:
        try:
            yield json.loads(t)
        except (ValueError, RecursionError):
            continue


def strings(v: object) -> list[str]:
    items = v if isinstance(v, list) else [v]
    out = [x.strip() if isinstance(x, str) else str(x) for x in items if isinstance(x, str | int | float) and not isinstance(x, bool)]
    return [x for x in out if x]


def parse_answer(answer: str | None, expected: list[str]) -> dict[str, dict]:
    """Findings by id: only expected ids, the first one of each, only with a known classification."""
    for value in payloads(answer or ""):
        items = value.get("findings") if isinstance(value, dict) else value
        if not isinstance(items, list):
            continue
        found: dict[str, dict] = {}
        for i in items:
            if isinstance(i, dict) and i.get("id") in expected and i.get("classification") in CLASSES and i["id"] not in found:
                found[i["id"]] = {"classification": i["classification"], "description": (i.get("description") or "").strip() if isinstance(i.get("description"), str) else "", "legible_values": strings(i.get("legible_values", i.get("legibleValues"))), "uncertainties": strings(i.get("uncertainties"))}
        return found
    return {}


FINDING = "doc string, id string, status string, description string, legible_values array<string>, uncertainties array<string>, reason string, input_tokens bigint, output_tokens bigint, cost double"


def run_prepass(batches: DataFrame, analyse: Analyse, in_flight: int = 3) -> DataFrame:
    """Findings of images (doc, batch, id, locations, context, media, data): at most ``in_flight`` calls at a time.

    An image without a finding, or in a batch whose call fails, is ``failed`` with the reason. What a call has used stands
    with its first image.
    """

    def call(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = []
            for doc, items in zip(*(c.to_pylist() for c in batch.columns)):
                answer, reason = Answer(""), "no finding in the answer"
                try:
                    said = analyse(items)
                    answer = said if isinstance(said, Answer) else Answer(said)
                except Exception as e:  # the fault of one call must not end the others
                    reason = str(e)
                found = parse_answer(answer.text, [i["id"] for i in items])
                for k, i in enumerate(items):
                    f = found.get(i["id"])
                    status = "failed" if f is None else "analyzed" if f["classification"] == "content" else f["classification"]
                    used = (0, 0, 0.0) if k else (answer.input_tokens, answer.output_tokens, answer.cost)
                    rows.append((doc, i["id"], status, f and f["description"], f and f["legible_values"], f and f["uncertainties"], None if f else reason, *used))
            cols = list(zip(*rows)) or [[]] * 10
            types = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in FINDING.split(", ")])

    grouped = batches.groupBy("doc", "batch").agg(F.sort_array(F.collect_list(F.struct("id", "locations", "context", "media", "data"))).alias("items"))
    return grouped.select("doc", "items").repartition(in_flight).mapInArrow(call, FINDING)


def usage(findings: DataFrame) -> DataFrame:
    """(calls, input_tokens, output_tokens, cost) of all calls, one row."""
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero)).alias(c)
    return findings.agg(F.count_if((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0) | (F.col("cost") > 0)).alias("calls"), total("input_tokens", 0), total("output_tokens", 0), total("cost", 0.0))


def with_findings(staged: DataFrame, findings: DataFrame) -> DataFrame:
    """The staged images with what the model found; those it wasn't asked about keep their status."""
    told = findings.select("doc", "id", F.col("status").alias("new_status"), "description", "legible_values", "uncertainties", F.col("reason").alias("new_reason"))
    joined = staged.join(told, ["doc", "id"], "left")
    return joined.withColumn("status", F.coalesce("new_status", "status")).withColumn("reason", F.when(F.col("new_status").isNotNull(), F.col("new_reason")).otherwise(F.col("reason"))).drop("new_status", "new_reason")


def render_findings(found: DataFrame, limit: int | None = SHOWN_CONTEXT) -> DataFrame:
    """(doc, content): the findings of each document as text, from rows (doc, id, status, reason, occurrences, description, legible_values, uncertainties).

    A document's findings are one file, so its images meet in one row, without their pictures.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    cut_off = lambda c: c if limit is None else F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    near = lambda o: F.when(flat(o["context"]) != "", F.concat(F.lit(" — near: "), cut_off(flat(o["context"])))).otherwise("")
    places = F.array_join(F.transform("occurrences", lambda o, k: F.concat(F.when(k == 0, "Location: ").otherwise("Also at: "), F.coalesce(o["location"], F.lit("unknown")), near(o))), "\n")
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}:\n  - "), F.array_join(c, "\n  - ")))
    given = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    block = F.concat_ws("\n", F.concat(F.lit("## "), "id", F.lit(" — "), "status"), given("Reason", "reason"), F.when(F.size("occurrences") > 0, places), given("Description", "description"), listed("Legible values", "legible_values"), listed("Uncertainties", "uncertainties"))
    counts = F.array_join(F.array(*[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in intake.STATUSES]), ", ")
    per = found.groupBy("doc").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.char_length("id").alias("n"), "id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"),
        F.count("*").alias("n"), F.sum(F.size("occurrences")).alias("o"), *[F.count_if(F.col("status") == s).alias(s) for s in intake.STATUSES],
    )
    head = F.concat(F.lit("Image findings for input/"), "doc", F.lit("\n"), F.col("n").cast("string"), F.lit(" unique image(s), "), F.col("o").cast("string"), F.lit(" occurrence(s). Status: "), counts, F.lit(".\n\n"))
    return per.select("doc", F.concat(head, "body", F.lit("\n")).alias("content"))
