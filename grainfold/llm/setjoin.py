"""All similar pairs between set-valued records by recursive chosen-path splitting.

Every distinct set is a record. In each of several trees a node splits into one child for each of
its randomly chosen tokens: a record goes to the child of token j, if the random value of (node, j)
is under 1 / (RHO * size of the record), which doesn't depend on the other records. So two similar
records go on together along at least one path with good probability, and dissimilar ones part soon.
Nodes of at most ``BRUTE`` records are compared pair by pair. A record that has the share ``RHO`` of its
tokens or more in common with its whole node, on average, would stay with it however far it splits; such
records are compared with the rest of the node at once and leave it. They are not compared with everyone:
of two sets that reach the threshold the rarest tokens (by the node's own counts) overlap in prefixes whose
length follows from both sizes, so only records that meet in a prefix are candidates. Nodes over ``LOCAL``
records, such as that of a token which a third of all records have, split further over the cluster, and
those that are dense as a whole are compared by the same prefixes in an equi-join over the cluster; so is
what is still too large after ``ROUNDS`` splits. In the memory of a task, what is left after ``DEEPEST``
splits is compared by prefixes too. Candidates must agree in 64-bit bitmaps, then in their tokens, and are
checked once more on the values.

Equal sets are one class; they are expanded to records only in the result.
Defined cases: null sets, null values and values that even out to nothing don't count; repeated
values count once; sets under ``least`` values take no part. A record key with several rows has the
values of each row as sets of its own, and it is never paired with itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.rolling import U, mix
from grainfold.plans.runtime import cut, spread

#: Trees, and the rate of branching: at a Jaccard similarity of 0.7 these find more than 99 of 100 pairs (README).
TREES, RHO = 14, 0.6
#: When to compare instead of splitting on. Every way is exact for the records of a node, so these decide on time only.
BRUTE, LOCAL, DEEPEST, ROUNDS = 48, 200_000, 24, 8
#: Tokens of one task, and the widest sets that are compared as padded rows.
TASK_TOKENS, WIDE = 6_000_000, 32


def even_out(tag: str) -> str:
    """One spelling of a tag: NFKC, lower case, no leading '#', single '-' between its words."""
    tag = unicodedata.normalize("NFKC", tag).lower().strip().lstrip("#")
    return re.sub(r"[\s_-]+", "-", tag).strip("-")


def even_sets(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, tags): sorted distinct spellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            out = []
            for tags in batch.column(1).to_pylist():
                found = set()
                for t in tags or []:
                    if t is not None:
                        if t not in cache:
                            if len(cache) > 500_000:
                                cache.clear()
                            cache[t] = even_out(t)
                        found.add(cache[t])
                out.append(sorted(found - {""}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["key", "tags"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("key"), F.col(values).cast("array<string>").alias("v"))).mapInArrow(run, f"key {kind}, tags array<string>")


def children(node: np.ndarray, first: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of one split of rows whose tokens are tokens[first : first + size]."""
    row = np.repeat(np.arange(len(node)), size)
    end = np.cumsum(size)
    token = tokens[np.repeat(first - (end - size), size) + np.arange(len(row))]
    child = mix(node[row] ^ mix(token))
    chosen = (mix(child + U(1)) >> U(11)).astype(float) * 2.0**-53 < 1 / (RHO * size[row])
    return row[chosen], child[chosen]


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return offsets[:-1].astype(np.int64) - int(offsets[0]), np.diff(offsets).astype(np.int64), np.asarray(column.flatten()).view(U)


def split_once(roots: bool):
    """Flat-map of rows (node, k, tokens) to their children; from the roots of all trees if they have no node yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, tokens = ragged(batch.column(2))
            for tree in range(TREES) if roots else [0]:
                node = np.full(len(first), mix(np.array([tree + 1], U))[0]) if roots else np.asarray(batch.column(0)).view(U)
                row, child = children(node, first, size, tokens)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], names=["node", "k", "tokens"])

    return run


def places(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the token) of every token of some rows."""
    row = np.repeat(np.arange(len(first)), size)
    end = np.cumsum(size)
    return row, np.repeat(first - (end - size), size) + np.arange(len(row))


def overlap(node: np.ndarray, first: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean share of its tokens that each row has in common with the others of its node, and how many of the node have each token; ``node`` is sorted."""
    row, at = places(first, size)
    _, place, count = np.unique(mix(node[row] ^ mix(tokens[at])), return_inverse=True, return_counts=True)
    have = count[place]
    common = np.bincount(row, weights=have - 1, minlength=len(node))
    edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    n = np.diff(np.append(edge, len(node)))
    return common / (size * np.repeat(np.maximum(n - 1, 1), n)), have


def bucket_of(size: np.ndarray) -> np.ndarray:
    """Sizes up to 16 are buckets of their own, larger ones come in steps of six per cent."""
    return np.where(size <= 16, size, 16 + np.floor(np.log(np.maximum(size, 16) / 16) / np.log(1.06) + 1e-9)).astype(np.int64)


def prefix_keys(node: np.ndarray, first: np.ndarray, size: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, key of the partner) of rows whose tokens stand rarest first: rows of one node that reach the threshold have one's key as the other's partner key.

    For each bucket of sizes a partner may have, the prefix is as long as the least overlap with such a partner allows.
    """
    low, high = np.ceil(size * threshold - 1e-9), np.floor(size / threshold + 1e-9)
    from_, to = bucket_of(np.maximum(low, 1)), bucket_of(high)
    row, bucket = places(from_, to - from_ + 1)
    least = np.where(bucket <= 16, bucket, np.ceil(16 * 1.06 ** (bucket - 16.0) - 1e-6))
    least = np.maximum(least, low[row])
    shared = np.ceil(threshold / (1 + threshold) * (size[row] + least) - 1e-9)
    length = np.clip(size[row] - shared + 1, 0, size[row]).astype(np.int64)
    pick, at = places(first[row], length)
    row, other = row[pick], bucket[pick].astype(U)
    own = bucket_of(size)[row].astype(U)
    base = mix(node[row] ^ mix(tokens[at] + U(1)))
    return row, mix(base ^ mix(own * U(0x10001) + (other << U(32)))), mix(base ^ mix(other * U(0x10001) + (own << U(32))))


def rarest_first(first: np.ndarray, size: np.ndarray, tokens: np.ndarray, have: np.ndarray) -> np.ndarray:
    """The tokens of the rows one after another, each row's by how many of its node have them."""
    row, at = places(first, size)
    return tokens[at][np.lexsort((tokens[at], have, row))]


def prefix_pairs(node: np.ndarray, first: np.ndarray, size: np.ndarray, tokens: np.ndarray, have: np.ndarray, chosen: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of candidate pairs of the chosen rows with all rows of their nodes."""
    own = rarest_first(first, size, tokens, have)
    row, key, partner = prefix_keys(node, np.cumsum(size) - size, size, own, threshold)
    order = np.argsort(partner, kind="stable")
    partner, there = partner[order], row[order]
    asked = chosen[row]
    key, here = key[asked], row[asked]
    begin = np.searchsorted(partner, key)
    many = np.searchsorted(partner, key, side="right") - begin
    total = np.cumsum(many)
    k = 0
    while k < len(key):
        stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + 2_000_000, side="right")))
        m = many[k:stop]
        end = np.cumsum(m)
        yield np.repeat(here[k:stop], m), there[np.repeat(begin[k:stop] - (end - m), m) + np.arange(int(end[-1]))]
        k = stop


def pairs_within(node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j), i < j, that have the same value in the sorted ``node``."""
    edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    count = np.diff(np.append(edge, len(node)))
    last = np.repeat(edge + count, count)
    n = last - np.arange(len(node)) - 1  # partners behind each row
    total = np.cumsum(n)
    begin = 0
    while begin < len(node):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 2_000_000, side="right")))
        m = n[begin:stop]
        i = np.repeat(np.arange(begin, stop), m)
        end = np.cumsum(m)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(end - m, m)
        begin = stop


class Records:
    """The distinct records of a task: their tokens one after another, and what tells quickly that two are not alike."""

    def __init__(self, column: pa.Array) -> None:
        self.first, self.size, self.tokens = ragged(column)
        self.bits = np.bitwise_or.reduceat(U(1) << (self.tokens >> U(58)), self.first)
        # Tokens as small numbers; a record's tokens are sorted, so these keys are too.
        distinct, number = np.unique(self.tokens, return_inverse=True)
        self.many = len(distinct)
        row, at = places(self.first, self.size)
        self.number = number
        self.keys = row * self.many + number[at]
        narrow = self.size <= WIDE
        width = int(self.size[narrow].max(initial=1))
        self.place = np.cumsum(narrow) - 1
        self.table = np.full((int(narrow.sum()), width), -1, np.int32)
        self.table[np.arange(width) < self.size[narrow, None]] = number[places(self.first[narrow], self.size[narrow])[1]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many tokens two records have in common; wide ones are looked up, others compared as rows."""
        out = np.zeros(len(i), np.int64)
        wide = (self.size[i] > WIDE) | (self.size[j] > WIDE)
        at = np.flatnonzero(~wide)
        step = max(1, 8_000_000 // self.table.shape[1] ** 2)
        for k in range(0, len(at), step):
            x, y = self.table[self.place[i[at[k : k + step]]]], self.table[self.place[j[at[k : k + step]]]]
            out[at[k : k + step]] = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).sum(axis=(1, 2))
        at = np.flatnonzero(wide)
        a = np.where(self.size[i[at]] <= self.size[j[at]], i[at], j[at])
        b = i[at] + j[at] - a
        begin = 0
        total = np.cumsum(self.size[a])
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 2_000_000, side="right")))
            row, place = places(self.first[a[begin:stop]], self.size[a[begin:stop]])
            wanted = b[begin:stop][row] * self.many + self.number[place]
            hit = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
            out[at[begin:stop]] = np.bincount(row, hit, stop - begin)
            begin = stop
        return out

    def similar(self, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of records that reach the threshold."""
        both = self.size[i] + self.size[j]
        near = np.bitwise_count(self.bits[i] ^ self.bits[j]) <= both * (1 - threshold) / (1 + threshold) + 1e-9
        near &= np.minimum(self.size[i], self.size[j]) >= threshold * np.maximum(self.size[i], self.size[j]) - 1e-9
        i, j, both = i[near], j[near], both[near]
        common = self.common(i, j)
        ok = common >= threshold * (both - common) - 1e-9
        return i[ok], j[ok]


def solve(threshold: float):
    """Pairs (a, b) of record ids of all nodes in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        node = np.asarray(whole["node"].chunk(0)).view(U)
        keys, index, record = np.unique(np.asarray(whole["k"].chunk(0)), return_index=True, return_inverse=True)
        known = Records(whole["tokens"].chunk(0).take(pa.array(index)))
        first, size, tokens = known.first, known.size, known.tokens
        del whole, got
        found: list[np.ndarray] = []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            differ = i != j
            a, b = known.similar(i[differ], j[differ], threshold)
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))

        for depth in range(DEEPEST):
            order = np.lexsort((record, node))
            node, record = node[order], record[order]
            edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            count = np.diff(np.append(edge, len(node)))
            small = np.repeat(count <= BRUTE, count)
            for i, j in pairs_within(node[small]):
                keep(record[small][i], record[small][j])
            node, record = node[~small], record[~small]
            if not len(node):
                break
            share, have = overlap(node, first[record], size[record], tokens)
            dense = (share >= RHO) | (depth == DEEPEST - 1)
            if dense.any():
                edge = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                inside = np.repeat(np.logical_or.reduceat(dense, edge), np.diff(np.append(edge, len(node))))
                rows = record[inside]
                for i, j in prefix_pairs(node[inside], first[rows], size[rows], tokens, have[np.repeat(inside, size[record])], dense[inside], threshold):
                    keep(rows[i], rows[j])
            node, record = node[~dense], record[~dense]
            row, child = children(node, first[record], size[record], tokens)
            node, record = child, record[row]
        if found:
            pair = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[pair[:, 0]]), pa.array(keys[pair[:, 1]])], names=["a", "b"])

    return run


def prefix_rows(threshold: float):
    """Flat-map of rows (node, k, tokens rarest first) to (k, key, partner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, tokens = ragged(batch.column(2))
            row, key, partner = prefix_keys(np.asarray(batch.column(0)).view(U), first, size, tokens, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(partner.view(np.int64))], names=["k", "key", "partner"])

    return run


def dense_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) of the records of large dense nodes (node, k, tokens), over the cluster."""
    each = rows.select("node", "k", F.explode("tokens").alias("token"))
    have = each.groupBy("node", "token").agg(F.count("*").alias("have"))
    ordered = each.join(have, ["node", "token"]).groupBy("node", "k").agg(F.sort_array(F.collect_list(F.struct("have", "token"))).alias("t")).select("node", "k", F.col("t.token").alias("tokens"))
    keyed = cut(ordered.mapInArrow(prefix_rows(threshold), "k bigint, key bigint, partner bigint"))
    a, b = keyed.select(F.col("k").alias("a"), "key"), keyed.select(F.col("k").alias("b"), F.col("partner").alias("key"))
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def similar_sets(df: DataFrame, key: str, values: str, threshold: float, least: int = 1) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records whose evened-out sets of values have a Jaccard similarity of ``threshold`` or more."""
    sets = even_sets(df, key, values).where((F.size("tags") >= least) & F.col("key").isNotNull()).distinct()
    members = cut(sets.withColumn("k", F.xxhash64("tags")))
    classes = cut(members.groupBy("k").agg(F.first("tags").alias("tags")))
    tokens = F.array_sort(F.transform("tags", lambda t: F.xxhash64(t)))
    rows = spread(classes.select(F.lit(0).cast("bigint").alias("node"), "k", tokens.alias("tokens")))
    schema = "node bigint, k bigint, tokens array<bigint>"
    open_ = cut(rows.mapInArrow(split_once(True), schema))
    ready, dense = [], []
    for n in range(ROUNDS + 1):
        # Of the large nodes, how much of its tokens a record has in common with another one, on average.
        large = open_.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("m")).where(F.col("n") > LOCAL)
        if large.isEmpty():
            break
        large = cut(large)
        per_token = open_.join(large, "node", "left_semi").select("node", F.explode("tokens").alias("token")).groupBy("node", "token").agg(F.count("*").alias("c"))
        common = per_token.groupBy("node").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("common"))
        judged = cut(large.join(common, "node").select("node", ((F.col("common") / (F.col("m") * (F.col("n") - 1)) >= RHO) | F.lit(n == ROUNDS)).alias("dense")))
        ready.append(open_.join(judged, "node", "left_anti"))
        dense.append(open_.join(judged.where("dense"), "node", "left_semi"))
        open_ = cut(open_.join(judged.where("not dense"), "node", "left_semi").select("node", "k", "tokens").mapInArrow(split_once(False), schema))
    ready.append(open_)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    held = every.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_TOKENS))
    found = every.repartition(parts, "node").mapInArrow(solve(threshold), "a bigint, b bigint")
    for rows_ in dense:
        found = found.union(dense_pairs(rows_, threshold))
    found = found.distinct()
    # The exact check, on the values.
    a, b = (classes.select(F.col("k").alias(x), F.col("tags").alias(f"tags_{x}")) for x in "ab")
    checked = found.join(a, "a").join(b, "b").where(F.size(F.array_intersect("tags_a", "tags_b")) >= threshold * F.size(F.array_union("tags_a", "tags_b")) - 1e-9).select("a", "b")
    left, right = (members.select(F.col("k").alias(x), F.col("key").alias(f"key_{x}")) for x in "ab")
    between = checked.join(left, "a").join(right, "b").select("key_a", "key_b")
    same = members.groupBy("k").count().where("count > 1").select("k")
    twins = members.join(same, "k", "left_semi")
    within = twins.select("k", F.col("key").alias("key_a")).join(twins.select("k", F.col("key").alias("key_b")), "k").select("key_a", "key_b")
    return between.union(within).where("key_a <> key_b").select(F.least("key_a", "key_b").alias(f"{key}_a"), F.greatest("key_a", "key_b").alias(f"{key}_b")).distinct()


def similar_between(left: DataFrame, right: DataFrame, key: str, values: str, threshold: float, least: int = 1) -> DataFrame:
    """(left, right): keys of records of two tables, one of each, whose evened-out sets of values reach the threshold; equal keys are different records."""
    sided = lambda df, side: df.where(F.col(key).isNotNull()).select(F.struct(F.lit(side).alias("side"), F.col(key).alias("key")).alias("key"), F.col(values).alias("values"))
    pairs = similar_sets(sided(left, 0).union(sided(right, 1)), "key", "values", threshold, least)
    # The left side is the lesser one.
    return pairs.where("key_a.side = 0 and key_b.side = 1").select(F.col("key_a.key").alias("left"), F.col("key_b.key").alias("right"))
