"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import bpe, markup, oracles, packing, segment, setjoin, spans, terms
from grainfold.plans.runtime import table

#: Tokens of one container.
CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of concepts with at least five tags each that agree in 0.7 of them."""
    pairs = setjoin.similar_sets(table(spark, sf_dir, "concepts"), "concept_id", "tags", 0.7, 5)
    return pairs.select(F.col("concept_id_a").alias("concept_a"), F.col("concept_id_b").alias("concept_b"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.weights(table(spark, sf_dir, "retrieved_concepts"), "concept_id", "content_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that occur three times or more in a concept and in five concepts at most."""
    return terms.distinctive(table(spark, sf_dir, "retrieved_concepts"), "concept_id", "content_text", 3, 5)


def p4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z-score of every term of every retrieved concept."""
    w = weighted(spark, sf_dir)
    return w.select("concept_id", "term", F.col("n").cast("bigint").alias("n"), F.col("n_records").cast("bigint").alias("n_records"), F.round("z", 6).alias("z"))


def p4_against_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded score and distinctiveness of every hit, with their ranks within the question."""
    hits = table(spark, sf_dir, "retrieved_concepts")
    return terms.against_score(hits, weighted(spark, sf_dir), "concept_id", "hit_id", "question_id", "score").withColumn("weight", F.round("weight", 6))


#: Texts with markup: table, key, text.
MARKED = (("extracted_parts", "part_row", "part_text"), ("retrieved_concepts", "hit_id", "content_text"))


def marked(spark: SparkSession, sf_dir: str, clean: bool) -> DataFrame:
    found = [markup.apply(table(spark, sf_dir, name), key, text, clean).withColumnRenamed(key, "ref_id").withColumn("ref_table", F.lit(name)) for name, key, text in MARKED]
    return found[0].union(found[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of markup in each text."""
    return marked(spark, sf_dir, False).select("ref_table", "ref_id", "markup")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its markup, with headings, lists, tables, code and formulas kept."""
    return marked(spark, sf_dir, True).select("ref_table", "ref_id", "clean_text", F.array_join("kinds", ",").alias("kinds"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts over 4,000 code points and how they must be cut."""
    return segment.oversized(p7_pieces(spark, sf_dir), "part_row")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all parts."""
    return segment.pieces(table(spark, sf_dir, "extracted_parts"), "part_row", "part_text", "staged_name")


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its pieces without their overlaps, and whether their lengths and names hold."""
    p = p7_pieces(spark, sf_dir)
    own = F.struct("piece_no", F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", F.lit(segment.OVERLAP + 1), F.col("n_chars").cast("int"))).alias("t"))
    # A text's pieces are one text again.
    text = F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["t"]), "")
    return p.groupBy("part_row").agg(F.md5(text.cast("binary")).alias("md5"), (F.max(F.char_length("piece")) <= segment.LIMIT).alias("within"), (F.count_distinct("piece_name") == F.count("*")).alias("named"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document decoded again, as the digest of the text."""
    return bpe.decode_documents(p8_ids(spark, sf_dir), "doc_id", "ids").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, measured in tokens."""
    sizes = bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", only_count=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers must hold: no document lost, none overfull, none split that fits."""
    sizes = bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", only_count=True)
    packed = packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)
    per = packed.groupBy("doc_id").agg(F.sum("piece_size").alias("held"), F.count("*").alias("pieces"))
    counted = sizes.join(per, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("held", F.lit(-1)) != F.col("n_tokens")).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("split_needlessly"))
    fills = packed.where("container is not null").groupBy("container").agg(F.sum("piece_size").alias("fill")).agg(F.count_if(F.col("fill") > CAPACITY).alias("overfull"))
    # One row each.
    return counted.join(F.broadcast(fills)).select("documents", "lost", "overfull", "split_needlessly")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with an identical run of 200 code points or more."""
    return spans.shared_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document also stands in another one."""
    return spans.shared_share(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


def p10_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every document, and how much of it stands in paragraphs that an earlier place has alike."""
    return spans.removals(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p4_found": p4_found,
        "p4_weights": p4_weights,
        "p4_against_score": p4_against_score,
        "p6_found": p6_found,
        "p6_clean": p6_clean,
        "p7_found": p7_found,
        "p7_pieces": p7_pieces,
        "p7_rebuilt": p7_rebuilt,
        "p8_ids": p8_ids,
        "p8_decoded": p8_decoded,
        "p9_containers": p9_containers,
        "p9_checked": p9_checked,
        "p10_found": p10_found,
        "p10_shared": p10_shared,
        "p10_removals": p10_removals,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
