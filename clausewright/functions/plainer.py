"""Plain wording of provisions: split, reworded by fixed phrases, and kept as they are where that would change the meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_for_words, meaning_kept

# Phrases and plainer ones, in order.
PLAINER = (
    ("shall not", "must not"),
    ("shall", "must"),
    ("is required to", "must"),
    ("are required to", "must"),
    ("it shall be ensured that", "make sure that"),
    ("in terms of", "under"),
    ("in respect of", "for"),
    ("with respect to", "for"),
    ("prior to", "before"),
    ("subsequent to", "after"),
    ("with effect from", "from"),
    ("in the event that", "if"),
    ("in the event of", "if there is"),
    ("notwithstanding", "despite"),
    ("inter alia", "among other things"),
    ("vis-[àa]-vis", "compared with"),
    ("on an ongoing basis", "at all times"),
    ("hereinafter", ""),
    ("thereof", "of it"),
    ("therein", "in it"),
    ("commenced", "started"),
    ("commences", "starts"),
    ("commence", "start"),
    ("utili[sz]ed", "used"),
    ("utili[sz]es", "uses"),
    ("utili[sz]e", "use"),
    ("endeavour", "try"),
    ("such(?= (?:bank|entity|account|loan|borrower))", "that"),
    ("in accordance with", "under"),
    ("pursuant to", "under"),
    ("in order to", "to"),
    ("for the purposes? of", "for"),
    ("on account of", "because of"),
    ("by virtue of", "because of"),
    ("in lieu of", "instead of"),
    ("in the case of", "for"),
    ("in case of", "for"),
    ("with a view to", "to"),
    ("at the time of", "when"),
    ("a period of ", ""),
    ("furnished", "given"),
    ("furnishes", "gives"),
    ("furnish", "give"),
    ("ascertain", "check"),
    ("wherein", "where"),
    ("whereby", "by which"),
    ("henceforth", "from now on"),
    ("aforesaid", "above"),
    ("forthwith", "immediately"),
    ("must (require|apply|mean|include|be deemed|stand|continue|cease)", "will $1"),
)
# Asides that are dropped.
DROPPED = (r"\s*\((?:refer|see|as specified in|please refer)[^)]{0,120}\)", r"\s*\[(?:\d{1,3}|[ivx]+)\]", r"\bof these Directions\b", r"\s*\((?:hereinafter|herein)[^)]{0,120}\)")
#: Where provisions part, where a long sentence parts, and how many words make one long.
_PARTS = r"(?:;\s*|[.:]\s+)(?=\(?(?:[ivx]{1,4}|[a-z]|\d{1,2})\)\s)|;\s+(?=[A-Za-z(])|(?<=\.)\s+(?=[A-Z(])"
_HALVES = r"(?i)(,?\s+(?=provided that\b)|;\s+(?:and|or)\s+(?=[a-z])|,\s+and\s+(?=(?:it|the bank|banks|they|such|the entity)\s+(?:shall|must|should)\b))"
LONG_WORDS = 25


def provisions(x: Column) -> Column:
    """The provisions of a clause: its sentences and list items."""
    flat = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s*\|\s*", " ")
    return F.filter(F.transform(F.split(flat, _PARTS), lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def _capital(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def halves(sentence: Column) -> Column:
    """A long sentence parted before a proviso or a second duty, as often as it stays long; each part keeps 40 and 30 characters."""
    parts = F.split(F.regexp_replace(sentence, _HALVES, "\u0001$1\u0002"), "\u0001")
    clean = lambda s: F.regexp_replace(s, "^[^\u0002]*\u0002", "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("whole"))

    def take(state: Column, i: Column) -> Column:
        head = clean(F.get(parts, i))
        rest = F.replace(F.concat(head, F.array_join(F.slice(parts, i + 2, F.size(parts)), "")), F.lit("\u0002"))
        long = (F.regexp_count(rest, F.lit(r"\S+")) > LONG_WORDS) & (i < F.size(parts) - 1) & (F.length(head) >= 40) & (F.length(rest) - F.length(head) >= 30)
        said = F.when(long, F.regexp_replace(head, r"[,;]\s*$", "")).otherwise(rest)
        grown = F.concat(state["done"], F.array(F.when(i == 0, said).otherwise(_capital(said))))
        return F.when(state["whole"], state).otherwise(F.struct(grown.alias("done"), (~long).alias("whole")))

    return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, take)["done"]


def plainer(sentence: Column) -> Column:
    """A sentence in plainer words."""
    x = sentence
    for pattern in DROPPED:
        x = F.regexp_replace(x, f"(?i){pattern}", "")
    for phrase, by in PLAINER:
        x = F.regexp_replace(x, rf"(?i)\b{phrase}\b" if not phrase.endswith((" ", ")")) else rf"(?i)\b{phrase}", by)
    x = F.regexp_replace(digits_for_words(F.regexp_replace(x, r"(?i)\bpercent\b", "per cent")), r"(?i)\s*\bper cent\b", "%")
    x = F.regexp_replace(x, r"\bRWAs\b", "risk-weighted assets (RWAs)")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"\s{2,}", " "), r"\s+([,.;])", "$1"))
    return _capital(F.when((x != "") & ~x.rlike(r"[.:!?]$"), F.concat(x, F.lit("."))).otherwise(x))


def simplified(x: Column) -> Column:
    """said and kept of each sentence of a clause: the plainer wording, or the sentence itself (kept) where numbers, duties,
    prohibitions or exceptions would not come through."""
    sentences = F.flatten(F.transform(provisions(x), halves))

    def reword(s: Column) -> Column:
        new = plainer(s)
        safe = meaning_kept(digits_for_words(F.regexp_replace(s, r"(?i)\bpercent\b", "per cent")), new)
        return F.struct(F.when(safe, new).otherwise(s).alias("said"), (~safe).alias("kept"))

    return F.transform(sentences, reword)
