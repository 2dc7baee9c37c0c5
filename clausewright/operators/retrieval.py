"""Keyword, vector and hybrid retrieval over chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import chain

c = F.col
#: BM25's constants, the fusion constant and the boosts.
K1, B, RRF_K = 1.2, 0.75, 60
#: Queries of a vector search that are broadcast at once.
QUERY_BLOCK = 1000
BOOSTS = {"named_category": 1.6, "other_category": 0.75, "definition": 1.5, "requirement": 1.25, "boilerplate": 0.55}


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", words: Callable[[Column], Column] = terms) -> DataFrame:
    """term, key, tf, length: the inverted index, map-side combined."""
    words = chunks.select(c(key), words(c(text)).alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return words.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, questions: DataFrame, key: str = "chunk_id", question: str = "question_id", text: str = "text", words: Callable[[Column], Column] = terms, weight: Column | None = None) -> DataFrame:
    """question, key, score for every chunk that shares a term with a question; weight: another one of a term, from N and df.

    Only the questions' terms are kept of the index: the questions are the small side, and document
    frequencies come from the same pruned postings.
    """
    asked = questions.select(question, F.explode(F.array_distinct(words(c(text)))).alias("term"))
    sizes = chunks.select(F.size(words(c(text))).alias("n")).agg(F.count(F.lit(1)).alias("N"), F.avg("n").alias("mean"))
    index = postings(chunks, key, text, words).join(asked.select("term").distinct(), "term", "left_semi")
    spread = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = weight if weight is not None else F.ln(1 + (c("N") - c("df") + 0.5) / (c("df") + 0.5))
    gain = idf * c("tf") * (K1 + 1) / (c("tf") + K1 * (1 - B + B * c("length") / c("mean")))
    weighted = index.join(spread, "term").join(F.broadcast(sizes)).select("term", key, gain.alias("gain"))
    return weighted.join(asked, "term").groupBy(question, key).agg(F.sum("gain").alias("score"))


def coverage(text: Column, words: Column) -> Column:
    """The share of the words that occur in the text, as parts of words too."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: low.contains(w))) / F.greatest(F.size(words), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score: the k nearest other vectors of each query, exactly, the first of equals first.

    The stated queries go to every partition of the vectors in blocks of about QUERY_BLOCK, a pass for each block; each
    partition keeps its k best for each query before anything is shuffled.
    """
    asked = queries.select(c(key).alias("query_id"), c(vector).alias("q"))
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        pairs = vectors.select(key, vector).crossJoin(F.broadcast(part)).where(c("query_id") != c(key))
        scored = pairs.select("query_id", key, F.round(dot(c("q"), c(vector)), 9).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(c("score").desc(), key))
        best = scored.withColumn("_rank", rank).where(c("_rank") <= k).drop("_rank")
        found = best if found is None else found.union(best)
    return found


def ranked(scores: DataFrame, question: str, key: str, score: str = "score") -> DataFrame:
    """Scores with a 0-based rank, the lower key first among equals."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(c(score).desc(), key)) - 1)


def fuse(lexical: DataFrame, semantic: DataFrame, question: str, key: str) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + c(r) + 1), F.lit(0.0))
    a = lexical.select(question, key, c("rank").alias("lexical_rank"))
    b = semantic.select(question, key, c("rank").alias("semantic_rank"))
    return a.join(b, [question, key], "full_outer").withColumn("score", part("lexical_rank") + part("semantic_rank"))


def boosted(score: Column, named: Column, other: Column, definition: Column, requirement: Column, boilerplate: Column) -> tuple[Column, Column]:
    """The boosted score and the reasons for it."""
    flags = {"named_category": named, "other_category": other, "definition": definition, "requirement": requirement, "boilerplate": boilerplate}
    for name, flag in flags.items():
        score = score * F.when(flag, BOOSTS[name]).otherwise(1.0)
    return score, F.array_compact(F.array(*[F.when(flag, name) for name, flag in flags.items()]))


def diversified(scores: DataFrame, question: str, key: str, doc: str, per_doc: int, k: int) -> DataFrame:
    """At most per_doc of a document for a question, then the k best."""
    in_doc = F.row_number().over(Window.partitionBy(question, doc).orderBy(c("score").desc(), key))
    overall = F.row_number().over(Window.partitionBy(question).orderBy(c("score").desc(), key))
    return scores.withColumn("_d", in_doc).where(c("_d") <= per_doc).withColumn("place", overall).where(c("place") <= k).drop("_d")


def sliding_windows(rows: DataFrame, key: str, text: str, width: int, overlap: int) -> DataFrame:
    """Character windows of a width; the last one stops at the text's end."""
    step = width - overlap
    n = F.ceil(F.greatest(F.length(text) - width, F.lit(0)) / step).cast("long")
    windows = rows.select(key, text, F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"))
    return windows.select(key, "i", F.substring(c(text), (c("i") * step + 1).cast("int"), F.lit(width)).alias("piece"))


def confidence_band(score: Column, coverage_share: Column) -> Column:
    """How far a result can be trusted, from its best score and the words covered."""
    return chain([((score >= 0.75) & (coverage_share >= 0.5), F.lit("high")), ((score >= 0.6) | (coverage_share >= 0.5), F.lit("medium"))], F.lit("low"))


def packed_context(rows: DataFrame, question: str, order: list[Column], size: Column, limit: int, least: int = 3) -> DataFrame:
    """Blocks that fit into a context, in order: one that would overflow is skipped once `least` are in,
    and smaller ones after it may still be taken."""

    ordered = rows.groupBy(question).agg(F.sort_array(F.collect_list(F.struct(*order, size.alias("size")))).alias("blocks"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(ordered.schema["blocks"].dataType).alias("taken"))

    def take(state: Column, block: Column) -> Column:
        fits = (state["used"] + block["size"] <= limit) | (F.size(state["taken"]) < least)
        return F.when(fits, F.struct((state["used"] + block["size"]).alias("used"), F.concat(state["taken"], F.array(block)).alias("taken"))).otherwise(state)

    return ordered.select(question, F.aggregate("blocks", start, take).alias("s")).select(question, "s.used", F.explode("s.taken").alias("block"))
