"""TF-IDF cosine retrieval over a corpus of texts.

Smoothed idf ln((N + 1) / (df + 1)) + 1; terms of the question that no text has count in its norm.
The terms of a text are counted within its row, so no (key, term) pair is ever shuffled to be counted:
document frequencies are partially aggregated sums over distinct terms, and weights are found by joining
the vocabulary, which is broadcast up to ``VOCABULARY`` terms and joined by term beyond that. A question
looks only at texts that have one of its terms. ``index`` writes the document frequencies once for several
questions.

Defined cases: texts without terms and texts that share no term with the question aren't found; a
question without terms finds nothing; ties go to the smaller key. Null texts count among N. Every row is a
text of its own; of rows of one key the results are summed up, so keys should be unique.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.text import tokens
from grainfold.plans.runtime import bounded, cut, once, spread

#: Most terms of a vocabulary that is broadcast, about 60 MB; a term over 32 bytes counts for several.
VOCABULARY = 1_000_000

#: The extension point: corpus (key, text), question and limit to (key, score).
Retriever = Callable[[DataFrame, str, int], DataFrame]


def counted(terms: Column) -> Column:
    """Array of (term, tf) of an array of terms: sorted, then cut where the term changes."""
    ordered = F.array_sort(terms)

    def runs(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
        ends = F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins), F.lit(1))), F.array(F.size(t) + 1))
        return F.zip_with(begins, ends, lambda i, j: F.struct(F.element_at(t, i).alias("term"), (j - i).cast("bigint").alias("tf")))

    # The sorted array is bound once, as the only element of an array.
    return F.when(F.size(terms) > 0, F.element_at(F.transform(F.array(ordered), runs), 1)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """(key, term, tf) of a corpus (key, text); no shuffle."""
    each = once(spread(corpus).select("key", "text"), "terms", tokens(F.col("text")))
    return each.select("key", F.inline(counted(F.col("terms"))))


def document_frequencies(corpus: DataFrame) -> DataFrame:
    """(term, df) of a corpus (key, text)."""
    return spread(corpus).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse(n: int) -> Column:
    return F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1


@dataclass(frozen=True)
class Index:
    """Number of texts, idf (term, idf) and, if they are wanted, norms (key, norm) of a corpus, written once."""

    n: int
    idf: DataFrame
    norms: DataFrame | None = None


def index(corpus: DataFrame, with_norms: bool = False) -> Index:
    """The index of a corpus; with norms a question needs no more than its own terms of each text."""
    n = corpus.count()
    idf = cut(document_frequencies(corpus).select("term", inverse(n).alias("idf")))
    known = Index(n, bounded(idf, VOCABULARY, 1 + F.floor(F.octet_length("term") / 32)))
    return Index(n, known.idf, cut(norms(corpus, known))) if with_norms else known


def weights(corpus: DataFrame, known: Index | None = None) -> DataFrame:
    """(key, term, tf, idf, w)."""
    known = known or index(corpus)
    return term_frequencies(corpus).join(known.idf, "term").select("key", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("w"))


def norms(corpus: DataFrame, known: Index | None = None) -> DataFrame:
    """(key, norm) of the texts that have terms."""
    return weights(corpus, known).groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def question_terms(question: str) -> Counter:
    return Counter(t for t in re.findall(r"[^\W_]+", question.lower()) if len(t) > 2)


def scores(corpus: DataFrame, question: str, known: Index | None = None) -> DataFrame:
    """(key, score) of every text that shares a term with the question."""
    asked = question_terms(question)
    if not asked:
        return corpus.select("key", F.lit(0.0).alias("score")).where("false")
    known = known or index(corpus)
    # As many rows as the question has terms.
    idf = {r["term"]: r["idf"] for r in known.idf.where(F.col("term").isin(list(asked))).collect()}
    unseen = math.log(known.n + 1.0) + 1
    weighed = {t: k * idf.get(t, unseen) for t, k in asked.items()}
    norm = math.sqrt(sum(w * w for w in weighed.values()))
    each = once(spread(corpus).select("key", "text"), "terms", tokens(F.col("text")))
    found = each.where(F.arrays_overlap("terms", F.array(*map(F.lit, weighed))))
    if known.norms is not None:
        each_time = F.create_map(*[F.lit(x) for t, w in weighed.items() for x in (t, w * idf.get(t, unseen))])
        dot = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(each_time, t), F.lit(0.0)))
        sums = found.select("key", dot.alias("dot")).groupBy("key").agg(F.sum("dot").alias("dot")).join(known.norms, "key")
        return sums.where("dot > 0").select("key", (F.col("dot") / (F.col("norm") * F.lit(norm))).alias("score"))
    found = found.select("key", F.inline(counted(F.col("terms"))))
    hit = F.create_map(*[F.lit(x) for item in weighed.items() for x in item])
    w = F.col("tf") * F.col("idf")
    sums = found.join(known.idf, "term").groupBy("key").agg(F.sum(w * w).alias("norm2"), F.sum(w * F.coalesce(F.try_element_at(hit, F.col("term")), F.lit(0.0))).alias("dot"))
    return sums.where("dot > 0").select("key", (F.col("dot") / (F.sqrt("norm2") * F.lit(norm))).alias("score"))


def retrieve(corpus: DataFrame, question: str, limit: int = 10, known: Index | None = None) -> DataFrame:
    """The ``limit`` best (key, score)."""
    return scores(corpus, question, known).orderBy(F.desc("score"), "key").limit(limit)
