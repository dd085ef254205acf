"""References to records that do not exist at the instant of the reference.

Parents are events (key, instant, alive): a key exists if the last of its events up to and including
an instant says so. Events and references are range-partitioned together by (key, instant); each
range keeps its events as one sorted array, and its references are probed against it in batches by
binary search. The last event before a range is carried into it, so neither a key with very many
events nor one with very many references has to fit into one range. Only misses leave the ranges.

Defined cases: a reference of null key is an orphan (it leads nowhere); one of null instant is
judged at the end of all time. Events of null key or instant count for nothing; of several events of
a key at one instant, one that ends it wins. Repeated references are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import paths
from grainfold.plans.runtime import cut, once, ranges, spread

WIDTH = 24
#: Rows of one range, of which the events stand in memory as one array.
RANGE_ROWS = 1_000_000


def probe(key: Column, at: Column) -> Column:
    """24 bytes that sort by key digest, then by instant."""
    shifted = F.lpad(F.hex(at + F.lit(1 << 62)), 16, "0")
    return F.concat(F.unhex(F.md5(key)), F.unhex(shifted))


def keys_of(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays([column])
    begin, end = column.offset * WIDTH, (column.offset + len(column)) * WIDTH
    return np.frombuffer(column.buffers()[2], np.uint8)[begin:end].view(f"S{WIDTH}") if len(column) else np.zeros(0, f"S{WIDTH}")


def last_event(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest event of a range; columns probe, is_ref, alive."""
    best: tuple[bytes, bool] | None = None
    for batch in batches:
        events = batch.filter(pc.invert(batch.column(1)))
        if events.num_rows:
            keys = keys_of(events.column(0))
            at = int(np.argsort(keys, kind="stable")[-1])
            last = (keys[at].ljust(WIDTH, b"\0"), events.column(2)[at].as_py())
            best = last if best is None or last[0] > best[0] else best
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([best[0]]), pa.array([best[1]])], names=["part", "probe", "alive"])


def misses(carried: list[tuple[int, bytes, bool]]):
    """References that the events don't cover; columns probe, is_ref, alive, then the reference's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = [x for x in carried if x[0] < part]
        probes, alive = [], []
        if before:
            probes.append(np.array([before[-1][1]], f"S{WIDTH}"))
            alive.append(np.array([before[-1][2]]))
        events = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            mine = pa.array(~ref)
            if events is None and (~ref).any():
                probes.append(keys_of(batch.column(0).filter(mine)))
                alive.append(np.asarray(batch.column(2).filter(mine).to_numpy(zero_copy_only=False), bool))
            if not ref.any():
                continue
            if events is None:  # the rows of a range come events first
                events = np.concatenate([np.zeros(0, f"S{WIDTH}"), *probes])
                order = np.argsort(events, kind="stable")
                events, living = events[order], np.concatenate([np.zeros(0, bool), *alive])[order]
                digests = events.astype("S16") if len(events) else np.zeros(0, "S16")
            asked = batch.filter(pa.array(ref))
            want = keys_of(asked.column(0))
            at = np.searchsorted(events, want, side="right") - 1
            hit = np.zeros(len(want), bool)
            ok = at >= 0
            hit[ok] = (digests[at[ok]] == want[ok].astype("S16")) & living[at[ok]]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(~hit)) for c in asked.columns[3:]], names=asked.schema.names[3:])

    return run


def orphans(refs: DataFrame, events: DataFrame) -> DataFrame:
    """The rows of refs (ref_table, ref_id, ref_pos, key, at) whose key has no living event (key, at, alive) then; at in microseconds."""
    spark = refs.sparkSession
    clean = events.where(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", "at").agg(F.min("alive").alias("alive"))
    fields = ["ref_table", "ref_id", "ref_pos", "at"]
    empty = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in fields]
    never = F.lit((1 << 61) - 1)
    rows = clean.select(probe(F.col("key"), F.col("at")).alias("probe"), F.lit(False).alias("is_ref"), "alive", *empty).union(
        refs.select(probe(F.col("key"), F.coalesce("at", never)), F.lit(True), F.lit(False), *fields)
    )
    # Written before it is ranged, as counting and sampling read it too, and after, as both passes must see the same ranges.
    every = cut(rows)
    rows = every.where(F.col("probe").isNotNull())
    parts = ranges(rows, RANGE_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(parts, "probe", "is_ref", "ref_id", "ref_pos").sortWithinPartitions("is_ref"))
    # One row for each range, however large the tables are.
    tails = ranged.select("probe", "is_ref", "alive").mapInArrow(last_event, "part int, probe binary, alive boolean").collect()
    carried = sorted((r["part"], bytes(r["probe"]), r["alive"]) for r in tails)
    schema = ", ".join(f"{c} {refs.schema[c].dataType.simpleString()}" for c in fields)
    found = ranged.mapInArrow(misses(carried), schema)
    return found.union(every.where(F.col("probe").isNull()).select(*fields))


def references(concepts: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_pos, key, at) of every reference; key NULL where the path leaves the root.

    Keys begin with ``c:`` for a concept and ``f:`` for an archived input file. Null and blank values
    and those with a scheme are no references, nor are resources that name neither.
    """
    items = concepts.select(F.lit("concepts").alias("ref_table"), F.col("row_id").alias("ref_id"), F.posexplode("supersedes").alias("ref_pos", "value"), F.col("concept_id").alias("origin"), F.col("loaded_at").alias("t"))
    linked = links.select(F.lit("incoming_links"), F.col("link_id"), F.lit(0), F.col("to_concept_id"), F.col("from_concept_id"), F.col("seen_at"))
    used = sources.select(F.lit("source_entries"), F.col("entry_id"), F.lit(0), F.col("resource"), F.col("concept_id"), F.col("recorded_at"))
    every = spread(items).union(spread(linked)).union(spread(used))
    bare = once(every.where("value is not null").withColumnRenamed("value", "raw"), "value", paths.unbracketed(paths.trimmed(F.col("raw")))).where((paths.trimmed(F.col("value")) != "") & ~F.col("value").rlike("^[A-Za-z]+:"))
    placed = once(bare, "path", paths.link_path(F.col("value"), paths.directory(F.coalesce("origin", F.lit("")))))
    concept = F.concat(F.lit("c:"), F.regexp_replace("path", r"\.md$", ""))
    is_page = F.coalesce(F.endswith("path", F.lit(".md")), F.lit(False))
    # Whether a value that leaves the root names a page is seen by its own end.
    end = paths.before_first(paths.before_first(paths.percent_decoded(F.col("value")), "#"), "?")
    outside = F.col("path").isNull() & ((F.col("ref_table") == "source_entries") | F.endswith(end, F.lit(".md")))
    in_file = (F.col("ref_table") == "source_entries") & F.startswith("path", F.lit("archive/"))
    key = F.when(outside, None).when(is_page, concept).when(in_file, F.concat(F.lit("f:"), "path")).when(F.col("ref_table") != "source_entries", F.concat(F.lit("c:"), "value"))
    kept = outside | is_page | in_file | (F.col("ref_table") != "source_entries")
    return placed.where(kept).select("ref_table", "ref_id", "ref_pos", key.alias("key"), F.unix_micros("t").alias("at"))


def life_events(concepts: DataFrame, removals: DataFrame, files: DataFrame) -> DataFrame:
    """(key, at, alive) of concepts and archived input files."""
    event = lambda df, mark, key, t, alive: df.select(F.concat(F.lit(mark), F.col(key)).alias("key"), F.unix_micros(t).alias("at"), F.lit(alive).alias("alive"))
    return event(concepts, "c:", "concept_id", "loaded_at", True).union(event(removals, "c:", "concept_id", "removed_at", False)).union(event(files, "f:", "archive_path", "received_at", True))
