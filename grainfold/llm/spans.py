"""Long exact spans shared between records.

Paragraph MinHash banding (``paragraphs``) comes first: paragraphs that are equal, or alike and verified to
have a run of ``min_run`` code points in common, prove their texts to share one. It can't give every pair, as a
shared run may begin and end inside different paragraphs, or be all that two paragraphs have in common. So the
rest comes from winnowed fingerprints, which lose none: of every ``min_run - K + 1`` consecutive K-grams the one
of least hash is an anchor, so two texts with a common run of ``min_run`` share an anchor inside that run. Anchors
that occur in more than one text are joined; where the ``min_run`` code points from the anchor on are the same
text a pair is certain, otherwise the code points around the anchor are compared.

Exact copies form one class before anything is joined; they are expanded only in the result.
Defined cases: null texts and texts under ``min_run`` code points share nothing. Texts of any length
are read whole. Nothing is evened out. A row key that occurs twice is one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.llm import paragraphs
from grainfold.llm.rolling import Rolling, U, mix
from grainfold.plans.runtime import bounded, cut, spread, written

CHUNK = 1 << 17
#: Most rows, or elements of their arrays, of a table that is broadcast: about 50 MB.
SMALL = 1_000_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_size(min_run: int) -> int:
    return max(1, min_run * 2 // 5)


def anchors(texts: list[str], min_run: int) -> tuple[np.ndarray, ...]:
    """(text, start, fingerprint, hash of the ``min_run`` code points from there or 0, has repeats) of every anchor; texts have ``min_run`` code points at least."""
    k = anchor_size(min_run)
    width = min_run - k + 1
    r = Rolling(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    grams = r.grams(k)
    bits = U(max(1, int(len(grams)).bit_length()))
    # The place in the low bits makes the least one unique; of equal grams the leftmost is taken.
    least = sliding_least(((grams >> bits) << bits) | np.arange(len(grams), dtype=U), width)
    inside = np.ones(len(least), bool)
    for e in ends[:-1]:
        inside[max(0, e - min_run + 1) : e] = False
    at = np.unique((least[inside] & ((U(1) << bits) - U(1))).astype(np.int64))
    text = np.searchsorted(ends, at, side="right")
    finger = grams[at]
    whole = np.zeros(len(at), U)
    fits = at + min_run <= ends[text]
    whole[fits] = r.stretch(at[fits], min_run) | U(1)
    # Repeats within a text with the same code points on both sides add nothing.
    back = np.minimum(width, at - starts[text])
    left = mix((r.sums[at] - r.sums[at - back]) * Rolling.inverses[at - back] + back.astype(U))
    _, keep, count = np.unique(mix(finger + mix(whole + mix(left + text.astype(U)))), return_index=True, return_counts=True)
    order = np.argsort(keep)
    keep, count = keep[order], count[order]
    return text[keep], (at - starts[text])[keep], finger[keep], whole[keep], count > 1


def scan(min_run: int):
    """Anchors of the distinct texts of a partition; columns k, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def flush(keys: list[int], texts: list[str]) -> pa.RecordBatch:
            text, start, finger, whole, repeats = anchors(texts, min_run)
            k = np.array(keys, np.int64)[text]
            return pa.RecordBatch.from_arrays([pa.array(finger.view(np.int64)), pa.array(k), pa.array(start.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(repeats)], names=["finger", "k", "start", "whole", "repeats"])

        for batch in batches:
            keys, texts, n = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k in seen:
                    continue
                seen.add(k)
                keys.append(k)
                texts.append(t)
                n += len(t)
                if n >= CHUNK:
                    yield flush(keys, texts)
                    keys, texts, n = [], [], 0
            if keys:
                yield flush(keys, texts)

    return run


def around(min_run: int, levels: int = 6):
    """What stands at the places of a text: of certain ones the run from there on, of others the code points on both sides and keys of which two anchors of a common run agree in one.

    If the code points before the anchor agree over l and those behind it over r, with
    l + r >= min_run - K, then for the level l // step both cover a stretch that is ``step`` shorter
    than ``min_run``; its hash is the key of that level.
    """
    k = anchor_size(min_run)
    room = min_run - k
    step = -(-room // levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(key, p["start"], None, text[p["start"] : p["start"] + min_run], None) for p in places if p["certain"]]
                others = [p["start"] for p in places if not p["certain"]]
                if not others:
                    continue
                r = Rolling([text])
                at = np.array(others, np.int64)
                ks = []
                for level in range(levels):
                    a, b = at - level * step, at + k + max(0, room - (level + 1) * step)
                    ok = (a >= 0) & (b <= len(text))
                    h = np.zeros(len(at), U)
                    h[ok] = r.stretch(a[ok], k + level * step + max(0, room - (level + 1) * step)) + U(level)
                    ks.append(h.view(np.int64))
                ks = np.stack(ks, axis=1)
                for i, p in enumerate(others):
                    out.append((key, p, text[max(0, p - room) : p], text[p + k : p + k + room], [x for x in ks[i].tolist() if x]))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["k", "start", "before", "behind", "keys"])

    return run


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def long_enough(min_run: int):
    """Keeps the pairs whose agreement on both sides of an anchor makes up ``min_run``."""
    room = min_run - anchor_size(min_run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, la, ra, lb, rb = (c.to_pylist() for c in batch.columns)
            hit = [common(ra[i], rb[i]) + common(la[i][::-1], lb[i][::-1]) >= room for i in range(len(ka))]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return run


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text, k): k is the class of equal texts."""
    return df.select(F.col(key).alias("doc"), F.col(text).alias("text")).withColumn("k", F.xxhash64("text"))


def shared_anchors(docs: DataFrame, min_run: int) -> DataFrame:
    """(finger, k, start, whole, repeats) of anchors that occur in more than one class of texts; the texts are scanned once."""
    texts = spread(docs.where(F.char_length("text") >= min_run).select("k", "text"))
    found = written(texts.mapInArrow(scan(min_run), "finger bigint, k bigint, start int, whole bigint, repeats boolean"))
    several = cut(found.groupBy("finger").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("finger"))
    # A class may have been scanned in several partitions.
    return cut(found.join(bounded(several, SMALL), "finger", "left_semi").distinct())


def class_pairs(docs: DataFrame, classes: DataFrame, min_run: int) -> DataFrame:
    """(a, b), a < b: classes of texts that share a run, by their anchors."""
    shared = shared_anchors(docs, min_run)
    whole = shared.where("whole <> 0").groupBy("finger", "whole", "k").agg(F.min("start").alias("start"))
    # Anchors along one passage have the same set of texts; one of them is enough.
    sets = whole.groupBy("finger", "whole").agg(F.count("*").alias("n"), F.bit_xor("k").alias("x"), F.bit_xor(F.xxhash64("k")).alias("y")).where("n > 1")
    one = cut(sets.groupBy("n", "x", "y").agg(F.min(F.struct("finger", "whole")).alias("one")).select("one.*"))
    members = whole.join(bounded(one, SMALL), ["finger", "whole"], "left_semi").select("k", "start", F.lit(True).alias("certain"))
    # Anchors behind which not all texts go on alike: compare both sides.
    mixed = cut(shared.groupBy("finger").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high or low = 0").select("finger"))
    others = shared.join(bounded(mixed, SMALL), "finger", "left_semi").select("k", "start", F.lit(False).alias("certain"))
    places = members.union(others).groupBy("k").agg(F.collect_set(F.struct("start", "certain")).alias("places"))
    wanted = cut(places.join(classes, "k").select("k", F.col("first").alias("doc"), "places"))
    near = docs.join(bounded(wanted, SMALL, 1 + F.size("places")), ["doc", "k"]).select("k", "text", "places")
    near = cut(near.mapInArrow(around(min_run), "k bigint, start int, before string, behind string, keys array<bigint>"))
    # The text from a certain anchor on is the key itself, so nothing rests on its hash.
    left, right = (near.where("keys is null").select(F.col("k").alias(x), "behind") for x in "ab")
    certain = cut(left.join(right, "behind").where("a < b").select("a", "b").distinct())
    near = near.where("keys is not null")
    key = near.select("k", "start", F.explode("keys").alias("key"))
    a, b = (key.select("key", F.col("k").alias(x), F.col("start").alias(f"{x}_start")) for x in "ab")
    maybe = a.join(b, "key").where("a < b").join(certain, ["a", "b"], "left_anti")
    # Every place counts: of two places of one shift, a difference may lie between them.
    maybe = maybe.select("a", "b", "a_start", "b_start").distinct()
    near = near.dropDuplicates(["k", "start"])
    sides = [near.select(F.col("k").alias(x), F.col("start").alias(f"{x}_start"), F.col("before").alias(f"{x}_before"), F.col("behind").alias(f"{x}_behind")) for x in "ab"]
    both = maybe.join(sides[0], ["a", "a_start"]).join(sides[1], ["b", "b_start"])
    checked = both.select("a", "b", "a_before", "a_behind", "b_before", "b_behind").mapInArrow(long_enough(min_run), "a bigint, b bigint")
    return certain.union(checked).distinct()


def shared_pairs(df: DataFrame, key: str, text: str, min_run: int = 200) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of records with an identical run of ``min_run`` code points."""
    docs = keyed(df, key, text)
    long_docs = docs.where(F.char_length("text") >= min_run)
    members = cut(long_docs.select("doc", "k").distinct())
    classes = cut(members.groupBy("k").agg(F.min("doc").alias("first"), F.count("*").alias("n")))
    # The two ways don't depend on each other, so neither waits for the other's stages.
    with ThreadPoolExecutor(2) as pool:
        ways = [pool.submit(way, docs, classes, min_run) for way in (paragraphs.run_pairs, class_pairs)]
        pairs = ways[0].result().union(ways[1].result()).distinct()
    a, b = (members.select(F.col("k").alias(x), F.col("doc").alias(f"doc_{x}")) for x in "ab")
    between = pairs.join(a, "a").join(b, "b").select("doc_a", "doc_b")
    copied = members.join(classes.where("n > 1"), "k", "left_semi").withColumnRenamed("k", "a")
    within = copied.join(copied.withColumnRenamed("doc", "doc_b"), "a").where("doc < doc_b").select(F.col("doc").alias("doc_a"), "doc_b")
    return between.union(within).select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).where("doc_a < doc_b").distinct()


def shared_share(df: DataFrame, key: str, text: str, min_run: int = 200) -> DataFrame:
    """(key, n_chars, shared_chars, share): how much of each record stands in runs of ``min_run`` code points that another record has too.

    Every shared run has a shared anchor. Where the whole run from an anchor on is shared, nothing else is
    looked at; only runs that may reach beyond those are hashed and counted by class of equal texts. The runs
    of a text are merged into stretches. A copied text is shared whole. Null texts give 0 of 0 characters and a null share.
    """
    docs = keyed(df, key, text)
    classes = docs.where(F.char_length("text") >= min_run).select("doc", "k").distinct().groupBy("k").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    classes = cut(classes)
    shared = shared_anchors(docs, min_run)
    size = anchor_size(min_run)
    room = min_run - size
    # Anchors from which the whole run is in another class too cover it without more ado.
    sure = cut(shared.where("whole <> 0").groupBy("finger", "whole").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("finger", "whole", F.lit(True).alias("sure")))
    marked = cut(shared.join(bounded(sure, SMALL), ["finger", "whole"], "left").withColumn("sure", F.coalesce("sure", F.lit(False))))
    # A run that isn't covered so begins ``low`` to ``high`` places before one of its anchors; what one text needs all texts with that anchor must hash.
    before = Window.partitionBy("k").orderBy("start")
    last = F.last(F.when(F.col("sure"), F.col("start")), True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("sure") & (F.col("last").isNull() | (F.col("start") - F.col("last") > min_run)), F.col("start"))
    seen = marked.withColumn("last", last).withColumn("from", F.last(opens, True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    behind = F.col("last").isNotNull() & (F.col("start") - F.col("last") <= min_run) & (F.col("start") - room >= F.col("from"))
    low = F.when(~F.col("repeats") & F.col("sure"), F.col("start") - F.col("from") + 1).otherwise(0)
    high = F.when(~F.col("repeats") & ~F.col("sure") & behind, F.col("start") - F.col("last") - 1).otherwise(room)
    needs = cut(seen.select("finger", low.alias("low"), high.alias("high")).where("low <= high").groupBy("finger").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    wide = marked.join(bounded(needs, SMALL), "finger", "left").where("sure or low is not null")
    places = wide.groupBy("k").agg(F.collect_set(F.struct("start", "sure", "low", "high")).alias("places"))
    wanted = cut(places.join(classes, "k").select("k", F.col("first").alias("doc"), "places"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, places in zip(*(c.to_pylist() for c in batch.columns)):
                r = Rolling([t])
                grams = r.grams(size)
                sure = np.array([p["start"] for p in places if p["sure"]], np.int64)
                # Repeats of an anchor within the text were dropped: every place of its code points counts.
                at = np.flatnonzero(np.isin(grams, grams[sure]))
                at = at[at + min_run <= len(t)]
                sure = at[np.isin(r.stretch(at, min_run), r.stretch(sure, min_run))]
                asked = [p for p in places if p["low"] is not None]
                known, index = np.unique(grams[np.array([p["start"] for p in asked], np.int64)], return_index=True)
                at = np.flatnonzero(np.isin(grams, known))
                of = index[np.searchsorted(known, grams[at])]
                low, high = (np.array([p[x] for p in asked], np.int64)[of] for x in ("low", "high"))
                begin, end = np.maximum(at - high, 0), np.maximum(at - low + 1, 0)
                near = np.cumsum(np.bincount(begin, minlength=len(t) + 1) - np.bincount(end, minlength=len(t) + 1))
                start = np.flatnonzero(near[: len(t) - min_run + 1] > 0)
                h = r.stretch(start, min_run).view(np.int64)
                every = np.append(start, sure)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), k)), pa.array(every.astype(np.int32)), pa.array(np.append(h, np.zeros(len(sure), np.int64))), pa.array(np.arange(len(every)) >= len(start))], names=["k", "start", "h", "sure"])

    near = docs.join(bounded(wanted, SMALL, 1 + F.size("places")), ["doc", "k"]).select("k", "text", "places")
    hashed = written(near.mapInArrow(windows, "k bigint, start int, h bigint, sure boolean"))
    twice = hashed.where("not sure").groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("h")
    starts = hashed.where("not sure").join(twice, "h", "left_semi").select("k", "start").union(hashed.where("sure").select("k", "start")).distinct()
    gap = F.col("start") - F.lag("start").over(Window.partitionBy("k").orderBy("start"))
    covered = starts.withColumn("adds", F.least(F.coalesce(gap, F.lit(min_run)), F.lit(min_run))).groupBy("k").agg(F.sum("adds").alias("covered"))
    lengths = docs.select("doc", "k", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars")).dropDuplicates(["doc"])
    joined = lengths.join(classes.select("k", "n"), "k", "left").join(covered, "k", "left")
    total = F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    return joined.select(F.col("doc").alias(key), "n_chars", total.alias("shared_chars"), F.when(F.col("n_chars") > 0, total / F.col("n_chars")).alias("share"))


def removals(df: DataFrame, key: str, text: str, min_run: int = 200) -> DataFrame:
    """(key, class_id, n_paragraphs, n_shared, removed_chars) of every record: see ``paragraphs.removals``; equal texts are of one class."""
    docs = keyed(df, key, text)
    found = paragraphs.removals(docs, docs.where(F.char_length("text") >= min_run).select("doc", "k"), min_run)
    return found.withColumnsRenamed({"doc": key, "class": "class_id"})
