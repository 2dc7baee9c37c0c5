"""Answering in batches: what becomes of each question, and ranking by word stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .retrieval import bm25, confidence_band, terms

c = F.col


def standalone(question: Column, before: Column) -> Column:
    """A follow-up with the question before it as context; other questions as they are."""
    follows = question.rlike(r"(?i)^(?:and|also|what about|how about|same (?:for|about)|for |then|what if|in that case|is it|does it|can it|are they|do they|what are its|its |it |this |that |those |these )")
    return F.when(follows & before.isNotNull(), F.concat(question, F.lit(" (context: "), before, F.lit(")"))).otherwise(question)


def answers(asked: DataFrame, narrow: DataFrame, wide: DataFrame, defined: DataFrame, extra: DataFrame, most: int = 8) -> DataFrame:
    """question, mode, confidence, fallbacks, clauses: the state that each question ends in.

    asked: question, smalltalk, limited (to one kind of institution), defines (asks what a term means); narrow and wide: question,
    clause, place, semantic, coverage of the search as asked and over all institutions; defined: question, clause of matching
    definitions; extra: question, clause, place of a search for them. Results are weak where the first is neither near (0.6) nor
    covers a third of the words. Weak ones of a limited search give way to wide ones that are not; clauses of a definition that was
    asked for and not found replace the last; weak ones of low confidence mean that nothing was found. Lists hold `most` clauses.
    """
    none = F.array().cast(f"array<{narrow.schema['clause'].dataType.simpleString()}>")
    first = lambda rows, name: rows.where(c("place") <= most).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", "clause", "semantic", "coverage"))).alias(name))
    ids = lambda rows: F.coalesce(F.transform(rows, lambda r: r["clause"]), none)
    top = lambda rows, field: F.coalesce(F.get(rows, F.lit(0))[field], F.lit(0.0))
    weak = lambda rows: (top(rows, "semantic") < 0.6) & (top(rows, "coverage") < 0.34)
    means = defined.join(asked.where("defines").select("question"), "question", "left_semi").groupBy("question").agg(F.collect_set("clause").alias("_means"))
    more = extra.where(c("place") <= 3).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", "clause"))).alias("_more"))
    rows = asked.join(first(narrow, "_narrow"), "question", "left").join(first(wide, "_wide"), "question", "left").join(means, "question", "left").join(more, "question", "left")
    rows = rows.withColumn("_widened", c("limited") & weak(c("_narrow")) & ~weak(c("_wide")))
    rows = rows.withColumn("_found", F.when(c("_widened"), c("_wide")).otherwise(c("_narrow")))
    rows = rows.withColumn("_defined", c("_means").isNotNull() & ~F.arrays_overlap(ids(c("_found")), F.coalesce("_means", none)))
    joined = F.slice(F.concat(F.slice(ids(c("_found")), 1, 6), F.array_except(ids(c("_more")), ids(c("_found")))), 1, most)
    rows = rows.withColumn("_clauses", F.when(c("_defined"), joined).otherwise(ids(c("_found"))))
    rows = rows.withColumn("_band", F.when(F.size("_clauses") == 0, "low").otherwise(confidence_band(top(c("_found"), "semantic"), top(c("_found"), "coverage"))))
    lost = (F.size("_clauses") == 0) | ((c("_band") == "low") & weak(c("_found")))
    rows = rows.withColumn("mode", F.when(c("smalltalk"), "smalltalk").when(lost, "not_found").otherwise("extractive"))
    answered = c("mode") == "extractive"
    fallbacks = F.array_compact(F.array(F.when(c("_widened") & ~c("smalltalk"), "wider"), F.when(c("_defined") & ~c("smalltalk"), "definitions")))
    return rows.select("question", "mode", F.when(answered, c("_band")).otherwise("low").alias("confidence"), fallbacks.alias("fallbacks"), F.when(answered, c("_clauses")).otherwise(none).alias("clauses"))


# --- stems (Porter, 1980) ---------------------------------------------------------------------------------------

_SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel) letters."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _ended(word: str, endings: dict[str, str], least: int) -> str:
    """The word with its longest listed ending replaced, if what is before it measures more than `least`."""
    for end in sorted((e for e in endings if word.endswith(e)), key=len, reverse=True)[:1]:
        stem = word[: -len(end)]
        return stem + endings[end] if _measure(stem) > least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and ones with other characters than a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
                cut += "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
                cut = cut[:-1]
            word = cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _ended(_ended(word, _SECOND, 0), _THIRD, 0)
    for end in sorted((e for e in _FOURTH if word.endswith(e)), key=len, reverse=True)[:1]:
        before = word[: -len(end)]
        if _measure(before) > 1 and (end != "ion" or before.endswith(("s", "t"))):
            word = before
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stemmed_terms(text: Column) -> Column:
    """The stems of a text's words, in Arrow batches."""
    return _stems(terms(text))


def stemmed_bm25(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, chunk_id, score as full-text engines give it: by stems, and the lower the better. A stem in more than half of the
    chunks weighs next to nothing instead of less than nothing."""
    idf = F.greatest(F.ln((c("N") - c("df") + 0.5) / (c("df") + 0.5)), F.lit(1e-6))
    return bm25(chunks, questions, words=stemmed_terms, weight=idf).withColumn("score", -c("score"))
