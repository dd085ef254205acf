"""Paragraphs that are alike, by MinHash banding, and what may be removed of them.

Texts are cut into paragraphs at blank lines. Each paragraph of ``least`` code points or more has a MinHash
signature of its shingles of five words; its bands of ``ROWS`` values are keys, and paragraphs that collide in
a key are candidates: at a similarity of 0.8 these are 99.5 of 100 pairs, at 0.9 all but one of 10^5. Candidates
are verified on their texts, by the exact Jaccard similarity of their shingles and by looking for an identical
run. Equal paragraphs are one until the end.

Clusters are the connected components of the verified pairs. Of each cluster the first occurrence (least
document, then place) stays, all others may be removed.

Defined cases: null texts have no paragraphs. Words are runs without white space; each sign of a script
written without blanks is a word. A paragraph under five words is one shingle. A row key that occurs twice
is one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.rolling import Rolling, U, mix
from grainfold.plans.runtime import bounded, cut, spread, written

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 8, 3
CHUNK = 1 << 17
#: Most rows, or elements of their arrays, of a table that is broadcast: about 50 MB.
SMALL = 1_000_000
GAP = re.compile(r"\n\s*\n")
WORD = re.compile("[぀-ヿ㐀-鿿가-힯]|[^\\s぀-ヿ㐀-鿿가-힯]+")
SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U)) | U(1)


def paragraphs_of(text: str, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the paragraphs that are long enough."""
    out, at = [], 0
    for m in GAP.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [(a, b) for a, b in [*out, (at, len(text))] if b - a >= least]


def shingles(r: Rolling, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, hash) of the shingles of consecutive paragraphs that end at ``ends``, in order; every paragraph has one."""
    cp = r.cp
    space = (cp <= 32) | (cp == 0x85) | (cp == 0xA0) | (cp == 0x1680) | ((cp >= 0x2000) & (cp <= 0x200A)) | (cp == 0x2028) | (cp == 0x2029) | (cp == 0x202F) | (cp == 0x205F) | (cp == 0x3000)
    alone = ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0xAC00) & (cp <= 0xD7AF))
    edge = np.zeros(len(cp) + 1, bool)
    edge[0] = True
    edge[ends] = True
    edge[1:-1] |= space[:-1] | alone[:-1] | alone[1:]
    first = np.flatnonzero(~space & edge[:-1])
    last = np.flatnonzero(~space & (edge[1:] | np.append(space[1:], True))) + 1
    word = mix((r.sums[last] - r.sums[first]) * r.inverses[first] + (last - first).astype(U))
    of = np.searchsorted(ends, first, side="right")
    n = max(0, len(word) - WORDS + 1)
    h = np.zeros(n, U)
    for k in range(WORDS):
        h = h * U(0x9E3779B97F4A7C15) + word[k : k + n]
    whole = of[:n] == of[len(of) - n :] if n else np.zeros(0, bool)
    row, h = of[:n][whole], mix(h[whole])
    bare = np.setdiff1d(np.arange(len(ends)), row)
    begin = np.append(0, ends[:-1])
    row = np.append(row, bare)
    h = np.append(h, mix((r.sums[ends[bare]] - r.sums[begin[bare]]) * r.inverses[begin[bare]]))
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def band_keys(r: Rolling, ends: np.ndarray) -> np.ndarray:
    """Keys of the bands of each paragraph, one row a paragraph."""
    row, h = shingles(r, ends)
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    out = np.zeros((len(ends), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(ends), U(b + 1))
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key ^ np.minimum.reduceat((h ^ SEEDS[2 * k]) * SEEDS[2 * k + 1], start))
        out[:, b] = key
    return out


def scan(least: int):
    """Paragraphs (p, k, begin, length, bands) of texts (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            r = Rolling([t for _, _, t in found])
            length = np.array([len(t) for _, _, t in found])
            ends = np.cumsum(length)
            begin = ends - length
            p = mix((r.sums[ends] - r.sums[begin]) * r.inverses[begin] + length.astype(U))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(band_keys(r, ends).ravel().view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array([k for k, _, _ in found], pa.int64()), pa.array([b for _, b, _ in found], pa.int32()), pa.array(length.astype(np.int32)), bands], names=["p", "k", "begin", "length", "bands"])

        seen: set[int] = set()
        for batch in batches:
            found, n = [], 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k in seen:
                    continue
                seen.add(k)
                for a, b in paragraphs_of(text, least):
                    found.append((k, a, text[a:b]))
                    n += b - a
                if n >= CHUNK:
                    yield flush(found)
                    found, n = [], 0
            if found:
                yield flush(found)

    return run


def long_paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """(p, k, begin, length, bands) of the long paragraphs of the classes of docs (k, text); a class that was read in several tasks comes repeatedly."""
    texts = spread(docs.where(F.char_length("text") >= least).select("k", "text"))
    return written(texts.mapInArrow(scan(least), "p bigint, k bigint, begin int, length int, bands array<bigint>"))


def colliding(paragraphs: DataFrame) -> DataFrame:
    """(key, p) of the keys that several paragraphs share; only these are shuffled again."""
    keys = paragraphs.select("p", F.explode("bands").alias("key"))
    several = cut(keys.groupBy("key").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("key"))
    return cut(keys.join(bounded(several, SMALL), "key", "left_semi").distinct())


def pairs_of(one: DataFrame, other: DataFrame) -> DataFrame:
    """(pa, pb), pa < pb: paragraphs of one (key, p) and other (key, p) with a key in common."""
    joined = one.select("key", F.col("p").alias("a")).join(other.select("key", F.col("p").alias("b")), "key").where("a <> b")
    return joined.select(F.least("a", "b").alias("pa"), F.greatest("a", "b").alias("pb")).distinct()


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(p, k, text) of paragraphs (p, k, doc, begin, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p["p"], k, text[p["begin"] : p["begin"] + p["length"]]) for k, text, found in zip(*(c.to_pylist() for c in batch.columns)) for p in found]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["p", "k", "text"])

    wanted = cut(places.groupBy("doc", "k").agg(F.collect_list(F.struct("p", "begin", "length")).alias("found")))
    return docs.join(bounded(wanted, SMALL, 1 + F.size("found")), ["doc", "k"]).select("k", "text", "found").mapInArrow(run, "p bigint, k bigint, text string")


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the shingles of two paragraphs."""
    sets = []
    for t in (a, b):
        words = WORD.findall(t)
        sets.append({tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def have_run(a: str, b: str, length: int) -> bool:
    """Whether two texts have an identical run of ``length`` code points."""
    if min(len(a), len(b)) < length:
        return False
    x, y = Rolling([a]).grams(length), Rolling([b]).grams(length)
    _, i, j = np.intersect1d(x, y, return_indices=True)
    return any(a[p : p + length] == b[q : q + length] for p, q in zip(i.tolist(), j.tolist()))


def verified(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(pa, pb, alike, run) of candidate pairs, judged on texts (p, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            alike = pa.array([similarity(x, y) >= SIMILAR - 1e-12 for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), alike, pa.array([have_run(x, y, least) for x, y in zip(a, b)], pa.bool_())], names=["pa", "pb", "alike", "run"])

    one = texts.groupBy("p").agg(F.min("text").alias("text"))
    sides = [one.select(F.col("p").alias(f"p{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"]
    return pairs.join(sides[0], "pa").join(sides[1], "pb").select("pa", "pb", "text_a", "text_b").mapInArrow(run, "pa bigint, pb bigint, alike boolean, run boolean")


def judged_pairs(shared: DataFrame, texts: DataFrame, least: int, spanning: bool) -> DataFrame:
    """Verified pairs of paragraphs that share a key: all of them, or with ``spanning`` enough to connect what is connected.

    Then all paragraphs of a key are compared with its first one. Those that are alike are connected through it, so pairs
    among them are left out; those that aren't are compared with all others of the key. A key that very many paragraphs
    of one kind share costs a pair for each of them.
    """
    if not spanning:
        return cut(verified(pairs_of(shared.select("key", "p"), shared), texts, least))
    centre = shared.groupBy("key").agg(F.min("p").alias("c"))
    spokes = cut(shared.join(centre, "key").where("p <> c"))
    star = cut(verified(spokes.select(F.col("c").alias("pa"), F.col("p").alias("pb")).distinct(), texts, least))
    off = spokes.join(star.where("not alike").select(F.col("pa").alias("c"), F.col("pb").alias("p")), ["c", "p"], "left_semi").select("key", "p")
    rest = pairs_of(off, shared).join(star, ["pa", "pb"], "left_anti")
    return cut(star.union(verified(rest, texts, least)))


def linked(docs: DataFrame, firsts: DataFrame, least: int, spanning: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What banding finds among docs (doc, text, k), of which firsts (k, first) tells one document a class.

    (p, k, begin, length) of the long paragraphs, (pa, pb, alike, run) of the verified pairs, and (k, text) of the
    paragraphs that several classes have.
    """
    found = long_paragraphs(docs, least)
    places = found.select("p", "k", "begin", "length")
    shared = colliding(found)
    several = cut(found.groupBy("p").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("p"))
    wanted = cut(shared.select("p").union(several).distinct())
    once = places.join(bounded(wanted, SMALL), "p", "left_semi").groupBy("p", "k").agg(F.min("begin").alias("begin"), F.min("length").alias("length"))
    texts = cut(texts_of(docs, once.join(firsts.select("k", F.col("first").alias("doc")), "k")).distinct())
    return places, judged_pairs(shared, texts, least, spanning), texts.join(several, "p", "left_semi").select("k", "text")


def run_pairs(docs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b: classes of which a paragraph proves that they have an identical run of ``least`` code points."""
    places, pairs, shared = linked(docs, firsts, least)
    a, b = (shared.select("text", F.col("k").alias(x)) for x in "ab")
    equal = a.join(b, "text").where("a < b").select("a", "b")
    held = places.select("p", "k").distinct()
    left, right = (held.select(F.col("p").alias(f"p{x}"), F.col("k").alias(x)) for x in "ab")
    alike = pairs.where("run").join(left, "pa").join(right, "pb").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(alike).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of undirected edges (a, b): the least node that each is connected with.

    Labels spread along the edges and jump to the label of the label, so the rounds grow with the logarithm of a chain.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = cut(step.join(ahead, "to", "left").select("node", F.least("to", "further").alias("label"), "was"))
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def removals(docs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(doc, class, n_paragraphs, n_shared, removed_chars) of every document of docs (doc, text, k) with members (doc, k); those of null key take no part.

    class is the least document that a document is connected with by clusters, n_shared the number of its long
    paragraphs whose cluster has another document too, removed_chars the code points of those that aren't the first
    of their cluster.
    """
    docs, members = docs.where(F.col("doc").isNotNull()), cut(members.where(F.col("doc").isNotNull()).distinct())
    firsts = members.groupBy("k").agg(F.min("doc").alias("first"))
    places, pairs, _ = linked(docs, firsts, least, spanning=True)
    label = components(pairs.where("alike").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    clustered = places.distinct().join(label.withColumnRenamed("node", "p"), "p", "left").select("k", "begin", "length", F.coalesce("label", "p").alias("c"))
    every = cut(clustered.join(members, "k").select("doc", "begin", "length", "c"))
    per = cut(every.groupBy("c").agg(F.min(F.struct("doc", "begin")).alias("first"), F.max("doc").alias("last")))
    judged = every.join(per, "c").select("doc", "length", F.col("first.doc").alias("first"), (F.col("first.doc") != F.col("last")).alias("shared"), (F.struct("doc", "begin") != F.col("first")).alias("gone"))
    copies = members.join(firsts, "k").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    classes = components(judged.where("shared").select(F.col("first").alias("a"), F.col("doc").alias("b")).union(copies))
    counts = judged.groupBy("doc").agg(F.count("*").alias("n_paragraphs"), F.count_if("shared").alias("n_shared"), F.sum(F.when(F.col("gone"), F.col("length")).otherwise(0)).alias("removed_chars"))
    joined = docs.select("doc").distinct().join(counts, "doc", "left").join(classes.withColumnRenamed("node", "doc"), "doc", "left")
    return joined.select("doc", F.coalesce("label", "doc").alias("class"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_paragraphs", "n_shared", "removed_chars")])
