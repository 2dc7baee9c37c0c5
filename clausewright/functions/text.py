"""Text expressions: normalising, parsing and classifying regulatory wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import chain

# Number words before "per cent", unit factors to crore, and rule types with their patterns.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "fifteen": 15, "twenty": 20, "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy-five": 75, "ninety": 90}
CRORE = {"crore": 1.0, "lakh": 0.01, "million": 0.1, "billion": 100.0, "thousand": 0.0001}
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def normal_key(x: Column, gap: str = " ") -> Column:
    """Lower case, with a gap for every run of other characters than letters and digits."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", gap))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def number(x: Column) -> Column:
    """A number as written: grouping commas of any width, percent signs, brackets for negatives."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?i)\s*(?:%|per cent|percent)\s*", ""), r"[,()\s]", "")
    value = bare.try_cast("double")
    return F.when(x.rlike(r"^\s*\(.*\)\s*%?\s*$"), -value).otherwise(value)


def crore_factor(unit: Column) -> Column:
    return chain([(F.lower(unit).contains(name), F.lit(factor)) for name, factor in CRORE.items()], F.lit(1.0))


def digits_for_words(x: Column) -> Column:
    """Number words before "per cent" as digits, the longer words first."""
    for word, n in sorted(NUMBER_WORDS.items(), key=lambda p: -len(p[0])):
        x = F.regexp_replace(x, rf"(?i)\b{word} per cent\b", f"{n} per cent")
    return x


def value_and_unit(x: Column) -> tuple[Column, Column]:
    """The first amount of a sentence and its unit."""
    text = digits_for_words(x)
    money = r"(?i)(?:Rs\.?|₹)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|lakh)?"
    percent, days, times = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:%|per cent)", r"(?i)([0-9]+)\s*(?:working )?(days?|months?|years?)", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*times"
    pick = lambda p: F.regexp_extract(text, p, 1)
    cases = [(pick(percent), F.lit("%")), (pick(money), F.concat_ws(" ", F.lit("₹"), F.nullif(F.lower(F.regexp_extract(text, money, 2)), F.lit("")))), (pick(days), F.concat(F.regexp_replace(F.lower(F.regexp_extract(text, days, 2)), "s$", ""), F.lit("s"))), (pick(times), F.lit("times"))]
    return chain([(v != "", F.regexp_replace(v, ",", "").try_cast("double")) for v, _ in cases], F.lit(None).cast("double")), chain([(v != "", u) for v, u in cases], F.lit(None).cast("string"))


def limit_operator(x: Column) -> Column:
    """The comparison that a sentence states for its amount."""
    return chain(
        [
            (x.rlike(r"(?i)\b(?:shall|should|must|may|does|do) not exceed\b|\bnot more than\b|\bmaximum of\b|\bup to\b|\bceiling of\b"), F.lit("<=")),
            (x.rlike(r"(?i)\bnot less than\b|\bminimum of\b|\bat least\b|\bnot be less than\b"), F.lit(">=")),
            (x.rlike(r"(?i)\bwithin\b.*\b(?:days?|months?|years?)\b"), F.lit("within_days")),
            (x.rlike(r"(?i)\bless than\b|\bbelow\b"), F.lit("<")),
            (x.rlike(r"(?i)\bmore than\b|\bexceed(?:s|ing)?\b|\babove\b"), F.lit(">")),
        ],
        F.lit(None).cast("string"),
    )


# Wording of duties, and of an item of definitions.
DUTY = r"(?i)\b(?:shall|must|should|required\s+to|(?:is|are)\s+prohibited|not\s+permitted|may\s+not|(?:is|are)\s+advised\s+to|ensure|mandatory|obligat\w+|directed\s+to)\b"
DEFINED = r"(?i)[‘'“\"][^’'”\"]{2,150}[’'”\"]\s*(?:\([^)]{1,40}\)\s*)?(?:means|shall\s+mean|includes|shall\s+include|refers?\s+to|is\s+defined)"


def clause_role(x: Column, heading: Column | None = None) -> Column:
    """What a clause does: the first of these that its words or its heading say."""
    head = F.lower(F.coalesce(heading, F.lit(""))) if heading is not None else F.lit("")
    first = F.lower(F.substring(F.trim(x), 1, 300))
    return chain(
        [
            (x.rlike(r"(?i)^[\s\[\]*.]*(?:deleted|omitted|\*{3,})?[\s\[\]*.]*$"), F.lit("deleted")),
            (head.contains("definition") | (F.regexp_count(x, F.lit(DEFINED)) >= 2), F.lit("definition")),
            (first.rlike(r"shall be called|come into (?:force|effect)|short title"), F.lit("short_title")),
            (head.contains("applicab") | first.rlike(r"shall (?:be )?(?:applicable|apply) to"), F.lit("applicability")),
            (head.contains("repeal") | first.rlike(r"stands? repealed|hereby repealed"), F.lit("repeal")),
            (x.rlike(DUTY), F.lit("obligation")),
        ],
        F.lit("information"),
    )


def clause_type(x: Column, role: Column) -> Column:
    """quantitative, relational, hybrid of the two, or qualitative."""
    measured = x.rlike(r"(?i)[0-9]\s*(?:%|per\s*cent|days?\b|months?\b|years?\b|times\b|bps\b)|(?:₹|\bRs\.?)\s*[0-9]|\bratio\b") & (role != "deleted")
    related = x.rlike(r"(?i)connected counterpart|beneficial owner|single (?:borrower|counterparty)|group exposure|related part|subsidiary|holding company|group entities")
    return chain([(measured & related, F.lit("hybrid")), (measured, F.lit("quantitative")), (related, F.lit("relational"))], F.lit("qualitative"))


def cross_references(x: Column) -> Column:
    """Paragraphs, with the last one of a range, annexes and documents that a clause points to."""
    found = lambda kind, p: F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))
    number = r"[0-9]{1,3}[A-Z]?(?:\.[0-9]{1,3}){0,3}(?:\([0-9a-z]+\))*"
    return F.concat(
        found("paragraph", rf"(?i)\bpara(?:graph)?s?\s+({number})"),
        found("range_end", rf"(?i)\bpara(?:graph)?s?\s+{number}\s*(?:to|and|-|–)\s*({number})"),
        found("annex", r"(?i)\bannex(?:ure)?[\s\-–]*([IVXLC]+|[0-9]{1,2})\b"),
        found("document", r"(Reserve Bank of India \((?:[^()]|\([^()]*\))+\) (?:Directions|Guidelines),? [0-9]{4})"),
    )


def content_terms(x: Column) -> Column:
    """Words that carry meaning, at least two characters long."""
    words = F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9][a-z0-9.\-]*)"), F.lit(1)), lambda w: F.regexp_replace(w, r"[.\-]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def any_of_terms(terms: Column, most: int = 24) -> Column:
    """The terms, quoted and joined by OR, 24 at most."""
    return F.array_join(F.transform(F.slice(terms, 1, most), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def iso_date(x: Column) -> Column:
    """A date in one of four written forms; null where it is none."""
    tidy = F.regexp_replace(F.trim(x), r"(?<=[0-9])(?:st|nd|rd|th)\b", "")
    return F.coalesce(*[F.try_to_date(tidy, f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "d MMMM yyyy", "MMMM d, yyyy")])


def sentences(x: Column) -> Column:
    """Sentences, with abbreviations and decimals left whole."""
    guarded = F.regexp_replace(x, r"\b(No|Rs|Dr|Mr|Mrs|viz|i\.e|e\.g|etc|Sr|Co|Ltd)\.", "$1\u0001")
    parts = F.split(guarded, r"(?<=[.!?;])\s+(?=[A-Z(\"“])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def sub_clauses(x: Column) -> Column:
    """The parts of a clause at its (1), (2), (a) marks, if it has two of them; else the whole."""
    parts = F.filter(F.split(x, r"\s+(?=\((?:[0-9]{1,2}|[a-z]|[ivx]+)\)\s)"), lambda s: F.trim(s) != "")
    return F.when(F.size(F.regexp_extract_all(x, F.lit(r"(\((?:[0-9]{1,2}|[a-z]|[ivx]+)\))\s"), F.lit(1))) >= 2, parts).otherwise(F.array(x))


def packed(parts: Column, limit: int) -> Column:
    """Neighbouring parts joined while they stay within a size; a part that is longer stands alone."""

    def take(state: Column, part: Column) -> Column:
        joined = F.concat(F.element_at(state, -1), F.lit(" "), part)
        fits = (F.size(state) > 0) & (F.length(joined) <= limit)
        return F.when(F.size(state) == 0, F.array(part)).when(fits, F.concat(F.slice(state, 1, F.size(state) - 1), F.array(joined))).otherwise(F.concat(state, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), take)


def meaning_kept(before: Column, after: Column) -> Column:
    """A rewriting keeps all numbers with their units, prohibitions, duties, exceptions and conditions, and adds no number."""
    measured = F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?(?:\s*(?:%|per cent|days?|months?|years?|crore|lakh))?)")
    numbers = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, measured, F.lit(1)), lambda n: F.regexp_replace(F.regexp_replace(F.lower(n), r"\s*per cent", "%"), r"\s+", "")))
    marks = F.lit(r"\b(provided that|unless|except|subject to|other than|excluding|despite)\b")
    exceptions = lambda t: F.regexp_extract_all(F.replace(F.lower(t), F.lit("notwithstanding"), F.lit("despite")), marks, F.lit(1))
    forbidden, duty = r"(?i)\b(?:shall not|must not|may not|cannot|is not permitted|are not permitted|no bank shall)\b", r"(?i)\b(?:shall|must|is required to|are required to)\b"
    same_numbers = (F.size(F.array_except(numbers(before), numbers(after))) == 0) & (F.size(F.array_except(numbers(after), numbers(before))) == 0)
    same_force = (before.rlike(forbidden) == after.rlike(forbidden)) & (~before.rlike(duty) | after.rlike(duty) | after.rlike(forbidden))
    return same_numbers & same_force & (F.size(F.array_except(exceptions(before), exceptions(after))) == 0)


def reading_grade(x: Column) -> Column:
    """Flesch-Kincaid grade: words a sentence and syllables (vowel groups) a word."""
    words, ends, vowels = F.regexp_count(x, F.lit(r"[A-Za-z]+")), F.greatest(F.regexp_count(x, F.lit(r"[.!?]+")), F.lit(1)), F.regexp_count(F.lower(x), F.lit("[aeiouy]+"))
    return F.when(words > 0, 0.39 * words / ends + 11.8 * vowels / words - 15.59)


def html_lines(x: Column) -> Column:
    """The text of a page: scripts and styles dropped, cells parted by a bar, blocks by a line break."""
    for pattern, by in ((r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</t[dh]>", " | "), (r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|table|article|ul)>", "\n"), (r"(?s)<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"[ \t]+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != "")
