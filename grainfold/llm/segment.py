"""Splitting oversized texts at natural boundaries, by lexical cohesion.

The text is taken apart at sentence and line ends. At each such gap the terms of the blocks before
and behind are compared (cosine); the depth of a valley is how far the similarity rises on both sides
of it. Each piece ends at the deepest valley of the room it has (the last of equal ones); where no
sentence or line ends in that room at the last white space, and only in a run without any of these in the
midst of it. Each piece but the first begins with the overlap.

Defined cases: null texts have no pieces; texts within the limit, the empty one too, are one piece.
A missing name is replaced by the row key. Repeated rows come out repeatedly.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.plans.runtime import spread

LIMIT, OVERLAP, BLOCK = 4000, 200, 4
SENTENCE = re.compile(r"[.!?]+[\"')\]]*\s+|[。！？]+\s*|\n\s*")
TERM = re.compile(r"\w{3,}|[぀-ヿ一-鿿]")


def cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(n * b[t] for t, n in a.items() if t in b)
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5


def valleys(text: str) -> tuple[list[int], list[float]]:
    """Gaps (offsets in the text) and their depths."""
    gaps = [m.end() for m in SENTENCE.finditer(text) if 0 < m.end() < len(text)]
    edges = [0, *gaps, len(text)]
    units = [Counter(TERM.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])]
    near = []
    for g in range(1, len(units)):
        before, behind = Counter(), Counter()
        for u in units[max(0, g - BLOCK) : g]:
            before.update(u)
        for u in units[g : g + BLOCK]:
            behind.update(u)
        near.append(cosine(before, behind))
    n = len(near)
    left, right = list(near), list(near)  # the peak reached by climbing to either side
    for g in range(1, n):
        if near[g - 1] >= near[g]:
            left[g] = left[g - 1]
    for g in range(n - 2, -1, -1):
        if near[g + 1] >= near[g]:
            right[g] = right[g + 1]
    return gaps, [left[g] + right[g] - 2 * near[g] for g in range(n)]


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(begin, end, endless) of every piece; endless if it ends within a run of more than ``limit`` code points without any boundary.

    Every such run is cut, as none of its pieces can hold it.
    """
    if len(text) <= limit:
        return [(0, len(text), False)]
    gaps, depth = valleys(text)
    blanks = [m.span() for m in re.finditer(r"\s+|[。！？]", text)]
    starts, ends = [a for a, _ in blanks], [b for _, b in blanks]
    out, done = [], 0
    while True:
        begin = max(0, done - overlap) if out else 0
        # No piece is shorter than the overlap that the next one takes from it.
        least, most = max(done + 1, begin + overlap), begin + limit
        if len(text) <= most:
            out.append((begin, len(text), False))
            return out
        low, high = bisect.bisect_left(gaps, least), bisect.bisect_right(gaps, most)
        endless = False
        if low < high:
            end = gaps[max(range(low, high), key=lambda g: (depth[g], g))]
        elif (b := bisect.bisect_right(ends, most) - 1) >= 0 and ends[b] >= least:
            end = ends[b]
        else:
            end = most
            b, a = bisect.bisect_right(ends, end) - 1, bisect.bisect_left(starts, end)
            endless = (starts[a] if a < len(starts) else len(text)) - (ends[b] if b >= 0 else 0) > limit
        out.append((begin, end, endless))
        done = end


def piece_name(name: str | None, key: object, number: int, several: bool) -> str:
    stem, suffix = os.path.splitext(name) if name else (f"part-{key}", ".txt")
    return f"{stem}.piece{number:02d}{suffix}" if several else stem + suffix


def pieces(df: DataFrame, key: str, text: str, name: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, begin, n_chars, cut_kind, piece_name, piece) of every piece.

    cut_kind is of the whole text: ``whole`` within the limit, ``hard`` if a cut falls into a run of more than
    ``limit`` code points without any boundary, else ``natural``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "piece_no", "begin", "n_chars", "cut_kind", "piece_name", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                found = cuts(t, limit, overlap)
                how = "whole" if len(found) == 1 else "hard" if any(x for _, _, x in found) else "natural"
                rows += [(k, i, b, e - b, how, piece_name(n, k, i, len(found) > 1), t[b:e]) for i, (b, e, _) in enumerate(found, 1)]
            cols = list(zip(*rows)) or [[]] * 7
            types = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    source = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text), F.col(name))
    out = spread(source).mapInArrow(run, f"key {kind}, piece_no int, begin bigint, n_chars bigint, cut_kind string, piece_name string, piece string")
    return out.withColumnRenamed("key", key)


def oversized(split: DataFrame, key: str) -> DataFrame:
    """(key, cut_kind) of the texts that were cut."""
    last: Column = F.col("piece_no") == 1
    return split.where((F.col("cut_kind") != "whole") & last).select(key, "cut_kind")
