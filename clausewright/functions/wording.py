"""Reading regulatory wording: numbers, rule atoms, taxonomy, a rule-based judge, recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import chain, compare
from .text import digits_for_words

# Names of quantities with the wording that means them, in order.
VARIABLES = (
    ("liquidity_coverage_ratio", r"liquidity coverage ratio|\bLCR\b"),
    ("nsfr", r"net stable funding ratio|\bNSFR\b"),
    ("crar", r"capital to risk[- ]weighted assets ratio|\bCRAR\b|capital adequacy ratio"),
    ("cet1_ratio", r"common equity tier 1|\bCET\s?1\b"),
    ("tier1_capital", r"tier[ -]?(?:1|I) capital"),
    ("tier2_capital", r"tier[ -]?(?:2|II) capital"),
    ("leverage_ratio", r"leverage ratio"),
    ("slr", r"statutory liquidity ratio|\bSLR\b"),
    ("crr", r"cash reserve ratio|\bCRR\b"),
    ("net_owned_fund", r"net owned fund|\bNOF\b"),
    ("psl_target", r"priority sector"),
    ("gross_npa_ratio", r"gross NPA|gross non-performing"),
    ("net_npa_ratio", r"net NPA|net non-performing"),
    ("htm_share", r"held to maturity|\bHTM\b"),
    ("single_counterparty_exposure", r"single (?:borrower|counterparty)"),
    ("group_exposure", r"group of (?:connected )?(?:borrowers|counterparties)"),
    ("paid_up_capital", r"paid-up (?:equity )?capital"),
    ("ltv_ratio", r"loan[- ]to[- ]value|\bLTV\b"),
    ("provision_coverage_ratio", r"provision coverage"),
    ("dividend_payout_ratio", r"dividend payout"),
)
# Rule types and their names; words of high and of medium risk.
RULE_TYPES = {"A": "Quantitative", "B": "Boolean / procedural", "C": "Conditional", "D": "Temporal", "E": "Qualitative / semantic", "F": "Relational", "G": "Multi-entity / connected-counterparty"}
HIGH_RISK = r"capital|crar|cet\s*1|tier\s*[12]|leverage|liquidity|lcr|nsfr|exposure|concentration|large exposure|related part|kyc|know your customer|money laundering|\baml\b|\bnpa\b|provision|fraud|cash reserve|statutory liquidity|\bcrr\b|\bslr\b"
MEDIUM_RISK = r"report|return|submit|disclos|within \d+ days|timeline|interest rate|priority sector|grievance|complaint|outsourc|cyber|audit"

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}"
_FIGURE = r"\d{1,3}(?:,\d{2,3})++(?:\.\d++)?|\d++(?:\.\d++)?"
_NUMBER = (
    rf"(?i)(?<![A-Za-z0-9.,])(?<![A-Za-z]-)(?<!\d[./-])(?<!\b{_MONTH}[., ]{{1,3}})(?:\(\s*(?:{_FIGURE})\s*\)|-?(?:{_FIGURE}))(?:\s*(?:%|per\s*cent\b))?"
    rf"(?![./-]\d)(?!(?!cr)[A-Za-z])(?!\s*(?:st|nd|rd|th)?\s*{_MONTH}\b)(?!\d)"
)


def numbers_in(text: Column) -> Column:
    """The numbers of a text with whether they are percentages. Dates, years from 1990 to 2100, ordinals before months and
    digits glued to letters are none; a bracketed number is negative."""
    read = lambda t: F.regexp_replace(t, r"(?i)[(),%\s-]|per\s*cent", "").try_cast("double")
    sign = lambda t: F.when(t.rlike(r"^\s*(?:\(|-)"), -1.0).otherwise(1.0)
    found = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda t: F.struct((sign(t) * read(t)).alias("value"), t.rlike(r"(?i)%|per\s*cent").alias("percent"), t.alias("raw")))
    year = lambda x: ~x["percent"] & (x["value"] == F.floor(x["value"])) & x["value"].between(1990, 2100) & ~x["raw"].contains(",")
    return F.filter(found, lambda x: x["value"].isNotNull() & ~year(x))


def variable_name(variable: Column, sentence: Column) -> Column:
    """The quantity's name: by the constrained phrase, else by the sentence."""
    of = lambda x: chain([(x.rlike(f"(?i){p}"), F.lit(name)) for name, p in VARIABLES], F.lit(None).cast("string"))
    return F.coalesce(of(variable), of(sentence))


# How sentences state limits, strong phrases first; the strict and the scope-setting ones need a modal verb.
_AT_MOST = r"(?:(?:shall|should|must|will|do|does)\s+not\s+exceed|not\s+(?:to\s+)?exceed(?:ing)?|(?:shall\s+|should\s+)?not\s+be\s+(?:more|higher)\s+than|no[t]?\s+more\s+than|(?:a\s+)?maximum\s+of|ceiling\s+of|cap(?:ped)?\s+(?:at|of)|(?:limited|restricted)\s+to|at\s+(?:the\s+)?most)"
_AT_LEAST = r"(?:no[t]?\s+(?:be\s+)?(?:less|lower)\s+than|not\s+(?:be\s+)?below|at\s+least|(?:a\s+)?minimum\s+of)"
_VALUE = r"(?:(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d+)?(?:\s*(?:crores?|lakhs?|million|billion))?|[\d,]+(?:\.\d+)?\s*(?:per\s*cent|percent|%|(?:working\s+|calendar\s+)?days?|months?|years?|weeks?|times|bps|basis\s+points))"
_SUBJECT = r"[A-Za-z][\w\s/()'&-]{1,60}?"
_ATOM = "(?i)" + "|".join((
    rf"\b(?:minimum|maximum)\s+{_SUBJECT}\s+(?:shall|should|must|will)\s+be\s+{_VALUE}",
    rf"\b(?:minimum|maximum|ceiling|cap|limit)\s+(?:(?:on|for)\s+)?{_SUBJECT}\s+(?:of|at)\s+{_VALUE}",
    rf"\b(?:{_AT_MOST}|{_AT_LEAST})\s+{_VALUE}(?:\s+(?:and|or)\s+{_VALUE})?",
    rf"\b(?:within|not\s+later\s+than)\s+(?:a\s+period\s+of\s+)?{_VALUE}",
    rf"\b(?:up\s*to|less\s+than|below|lower\s+than|more\s+than|greater\s+than|exceeding|in\s+excess\s+of|above|over)\s+{_VALUE}",
    rf"{_VALUE}\s+or\s+(?:more|above|higher|less|below|lower)\b",
))
_MODAL = r"(?i)\b(?:shall|should|must|required\s+to|has\s+to|have\s+to|may\s+not|cannot|prohibited|advised\s+to)\b"
_SCOPE = r"(?i)^\s*(?:if|where|unless|provided that|in case|when)\b"


def rule_atoms(sentence: Column) -> Column:
    """The limits that a sentence states: operator, value, unit, variable, base and kind of each.

    Limits are read from left to right, and what one has claimed is not read again; a second value after "and" or "or" has
    the same operator. A strong phrase is a requirement. A weak one ("up to", "more than") is one only behind a modal verb, and
    any limit in a condition's clause ("if ...,") is a condition.
    """
    s = digits_for_words(sentence)
    matches = F.regexp_extract_all(s, F.lit(_ATOM), F.lit(0))

    def atoms(m: Column) -> Column:
        before = F.substring(s, F.lit(1), F.instr(s, m) - 1)
        behind = F.substring(s, F.instr(s, m) + F.length(m), F.lit(120))
        strong = m.rlike(rf"(?i)^(?:{_AT_MOST}|{_AT_LEAST}|minimum|maximum|ceiling|cap|limit)")
        upper = m.rlike(rf"(?i)^(?:{_AT_MOST}|maximum|ceiling|cap\b|limit\b|up\s*to)|\bor\s+(?:less|below|lower)$")
        operator = chain(
            [
                (m.rlike(r"(?i)^(?:within|not\s+later)") & m.rlike(r"(?i)days?|months?|years?|weeks?"), F.lit("within_days")),
                (upper | m.rlike(r"(?i)^within"), F.lit("<=")),
                (m.rlike(rf"(?i)^(?:{_AT_LEAST}|minimum)|\bor\s+(?:more|above|higher)$"), F.lit(">=")),
                (m.rlike(r"(?i)^(?:less|below|lower)"), F.lit("<")),
            ],
            F.lit(">"),
        )
        clause = F.element_at(F.split(before, r"[;:]|,\s+(?=and\b|or\b|but\b|while\b|where\b|if\b|which\b)"), -1)
        subject = F.when(m.rlike(r"(?i)^(?:minimum|maximum|ceiling|cap|limit)\s+(?!of\b|at\b)"), F.regexp_extract(m, rf"(?i)^\w+\s+(?:(?:on|for)\s+)?({_SUBJECT})\s+(?:of|at|shall|should|must|will)\b", 1)).otherwise(F.element_at(F.split(clause, _MODAL), 1))
        governed = before.rlike(_MODAL) | m.rlike(r"(?i)\b(?:shall|should|must)\b")
        scope = clause.rlike(_SCOPE) & ~F.regexp_replace(clause, r"^[^,]*,", "").rlike(_MODAL)
        kind = F.when(scope, "condition").when(strong | governed, "requirement").otherwise("condition")
        values = F.regexp_extract_all(m, F.lit(f"(?i){_VALUE}"), F.lit(0))
        return F.transform(
            values,
            lambda v: F.struct(
                operator.alias("operator"),
                F.regexp_replace(F.regexp_extract(v, r"([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double").alias("value"),
                _unit(v).alias("unit"),
                _phrase(subject).alias("variable"),
                F.nullif(F.trim(F.regexp_extract(behind, r"(?i)^\s+of\s+(?:the\s+|its\s+|their\s+|a\s+)?([^,;.()]{3,90}?)(?=\s+(?:shall|should|must|which|as\s+on|during|for\s+the|subject)\b|[,;.()]|$)", 1)), F.lit("")).alias("base"),
                kind.alias("kind"),
            ),
        )

    return F.array_distinct(F.flatten(F.transform(matches, atoms)))


def _unit(v: Column) -> Column:
    money = F.lower(F.regexp_extract(v, r"(?i)(crore|lakh|million|billion)s?$", 1))
    return chain(
        [
            (v.rlike(r"(?i)₹|Rs|INR"), F.trim(F.concat(F.lit("₹ "), money))),
            (v.rlike(r"(?i)%|cent"), F.lit("%")),
            (v.rlike(r"(?i)working\s+days?"), F.lit("working_days")),
            (v.rlike(r"(?i)bps|basis"), F.lit("bps")),
            (v.rlike(r"(?i)times"), F.lit("times")),
        ],
        F.concat(F.lower(F.regexp_extract(v, r"(?i)(day|month|year|week)s?$", 1)), F.lit("s")),
    )


def _phrase(x: Column) -> Column:
    """A constrained phrase without its list mark, its articles and what leads over to the limit."""
    bare = F.regexp_replace(F.trim(x), r"^\s*(?:\(?[a-z0-9ivx]{1,4}\)|[a-z]\.)\s+", "")
    bare = F.regexp_replace(bare, r"(?i)^(?:(?:that|the|an|a|its|their|any|such|of|and|or|in|which|where|if|provided\s+that)\s+)+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)(?:\s+(?:is|are|shall|should|must|will|be|was|were|has|have|of|to|at|by))+\s*$", ""), r"\s+", " "))


# Wording of connected groups, relations, conditions, deadlines, required arrangements and soft standards.
_CONNECTED = r"(?i)group of connected|connected (?:counterpart|nbfcs)|borrower group|group (?:borrower|obligor|exposure)|aggregate (?:group )?exposure to (?:a|the) group|economic(?:ally)? dependen"
_RELATED = r"(?i)\b(?:subsidiar(?:y|ies)|holding company|parent (?:bank|company|entity)|related part(?:y|ies)|relatives? of|directors? (?:of|or)|promoters?|joint venture|group entit(?:y|ies)|intra-group)\b"
_IF = r"(?i)\b(?:if|unless|provided that|in case|where (?:a|the) (?:bank|entity)|only when|in the event)\b"
_WHEN = r"(?i)\bwithin (?:a period of )?(?:\d+|one|two|three|six|ten|thirty|sixty|ninety)\s+(?:working\s+)?(?:days?|months?|weeks?|years?)|\bnot later than\b|\bon or before\b|\b(?:monthly|quarterly|half[- ]yearly|annually)\b|\bevery (?:month|quarter|year)\b"
_HAVE = r"(?i)\bshall (?:have|put in place|frame|formulate|adopt|constitute|set up|establish|maintain) (?:a|an|its own)?\s*(?:(?:comprehensive|well[- ]documented|board[- ]approved|written)\s+)*(?:policy|committee|framework|system|mechanism|procedure|register|process|plan|charter|code)\b|\bboard[- ]approved (?:policy|framework)\b"
_SOFT = r"(?i)\b(?:adequate|appropriate|reasonable|sufficient|effective|robust|proper|satisfactory|prudent|due diligence|fit and proper|best efforts?|commensurate)\b"


def rule_type(text: Column, operator: Column, unit: Column, kind: Column, clause_type: Column) -> Column:
    """A to G: what it takes to test a requirement. operator, unit and kind are its limit's, null where it has none."""
    measured = unit.rlike(r"(?i)^(?:%|₹.*|crore|lakh|times|bps)$")
    timed = (operator == "within_days") | unit.isin("days", "working_days", "months", "years", "weeks")
    has = lambda x: F.coalesce(x, F.lit(False))
    return chain(
        [
            (text.rlike(_CONNECTED), F.lit("G")),
            (has(timed), F.lit("D")),
            (has(measured) & text.rlike(_IF) & (kind != "condition"), F.lit("C")),
            (has(measured), F.lit("A")),
            (has(clause_type == "relational") | text.rlike(_RELATED), F.lit("F")),
            (text.rlike(_WHEN), F.lit("D")),
            (text.rlike(_HAVE), F.lit("B")),
        ],
        F.lit("E"),
    )


def needs_reading(kind: Column, text: Column) -> Column:
    """Whether a requirement has no closed test."""
    return kind.isin("E", "F") | ((kind == "B") & text.rlike(_SOFT))


def risk_level(title: Column, text: Column) -> Column:
    said = F.concat_ws(" ", title, text)
    return chain([(said.rlike(f"(?i){HIGH_RISK}"), F.lit("high")), (said.rlike(f"(?i){MEDIUM_RISK}"), F.lit("medium"))], F.lit("low"))


# Wording of thresholds, denials and intentions.
_CEILING = r"(?i)(?:not exceed|not be more than|not more than|up to|maximum of|ceiling of|within|no later than|not be higher than|capp?(?:ed)? at|less than)[^.;]{0,80}?(\d+(?:\.\d+)?)\s*(per ?cent|%|(?:calendar |working )?days|months)"
_FLOOR = r"(?i)(?:at least|not less than|minimum(?: of)?|not be less than)[^.;]{0,80}?(\d+(?:\.\d+)?)\s*(per ?cent|%)"
_NOT = r"(?i)\b(?:not|no|never|none|failed to|fails to|without|yet to|absence of|lack(?:s|ing)?)\b"
_SOON = r"(?i)\b(?:plans? to|intends? to|proposes? to|will be|in due course|under preparation|draft|partially|expected to be completed|in the process|being considered|awaited|approximately|around)\b"


def judge(clause: Column, evidence: Column, relevant: Column) -> Column:
    """A decision on evidence by rules alone. relevant: whether it is about the clause (a similarity of 0.6 or more).

    Figures against the clause's threshold come first: ranges and figures on both sides of it are ambiguous. Then what the
    sentences say: affirmed, denied, both, or only intended.
    """
    high, low = F.regexp_extract(clause, _CEILING, 1).try_cast("double"), F.regexp_extract(clause, _FLOOR, 1).try_cast("double")
    at = lambda p: F.regexp_instr(clause, F.lit(p))
    upper = high.isNotNull() & (low.isNull() | (at(_CEILING) < at(_FLOOR)))
    limit, operator = F.when(upper, high).otherwise(low), F.when(upper, "<=").otherwise(">=")
    days = upper & F.regexp_extract(clause, _CEILING, 2).rlike("(?i)day|month")
    doubles = lambda found: F.transform(found, lambda v: v.cast("double"))
    span = r"(?i)range of (\d+(?:\.\d+)?)\s*%?\s*(?:to|-|and)\s*(\d+(?:\.\d+)?)"
    ends = F.array(F.regexp_extract(evidence, span, 1).try_cast("double"), F.regexp_extract(evidence, span, 2).try_cast("double"))
    said = lambda p: doubles(F.regexp_extract_all(evidence, F.lit(p), F.lit(1)))
    figures = F.when(ends[0].isNotNull(), ends).when(days, said(r"(?i)(\d+(?:\.\d+)?)\s*(?:working |calendar )?days?\b")).otherwise(said(r"(?i)(\d+(?:\.\d+)?)\s*(?:%|per ?cent)"))
    passed = F.filter(figures, lambda v: compare(v, operator, limit))
    sentences = F.filter(F.split(evidence, r"(?<=[.;])\s+(?=[A-Z(])"), lambda s: F.length(s) > 3)
    some = lambda test: F.exists(sentences, test)
    denied, soon = some(lambda s: s.rlike(_NOT)), some(lambda s: s.rlike(_SOON))
    affirmed = some(lambda s: ~s.rlike(_NOT) & ~s.rlike(_SOON))
    return chain(
        [
            (F.size(sentences) < 1, F.lit("INSUFFICIENT_DATA")),
            (evidence.rlike(r"(?i)\b(?:does not apply|not applicable|is not triggered)\b"), F.lit("COMPLIANT")),
            (limit.isNotNull() & (F.size(figures) > 0), chain([(F.size(passed) == F.size(figures), F.lit("COMPLIANT")), (F.size(passed) == 0, F.lit("NON_COMPLIANT"))], F.lit("AMBIGUOUS"))),
            (~relevant, F.lit("INSUFFICIENT_DATA")),
            (denied & affirmed, F.lit("AMBIGUOUS")),
            (denied, F.lit("NON_COMPLIANT")),
            (soon, F.lit("AMBIGUOUS")),
        ],
        F.lit("COMPLIANT"),
    )


def indian_number(x: Column) -> Column:
    """A number with lakh and crore grouping and at most two decimals."""
    rounded = F.round(F.abs(x), 2)
    whole = F.floor(rounded).cast("long").cast("string")
    grouped = F.when(F.length(whole) > 3, F.concat(F.reverse(F.regexp_replace(F.reverse(F.substring(whole, F.lit(1), F.length(whole) - 3)), r"(\d{2})(?=\d)", "$1,")), F.lit(","), F.substring(whole, -3, 3))).otherwise(whole)
    cents = F.round((rounded - F.floor(rounded)) * 100).cast("int")
    decimals = F.regexp_replace(F.concat(F.lit("."), F.lpad(cents.cast("string"), 2, "0")), r"\.?0+$", "")
    return F.concat(F.when(x < 0, "-").otherwise(""), grouped, decimals)


def recommendation(label: Column, value: Column, operator: Column, threshold: Column, unit: Column, level: Column) -> Column:
    """What to do about a missed figure, with the gap that remains."""
    shown = lambda v: F.concat(indian_number(v), F.when(unit == "%", "%").when(F.coalesce(unit, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), unit)))
    gap = F.abs(threshold - value)
    gap_text = F.when(unit == "%", F.concat(indian_number(gap), F.lit(" percentage points"))).otherwise(shown(gap))
    bound = chain([(operator == "<", F.lit("below")), (operator == "<=", F.lit("at most")), (operator == ">", F.lit("above"))], F.lit("at least"))
    base = F.concat(F.when(operator.isin("<", "<="), "Reduce ").otherwise("Raise "), label, F.lit(" from "), shown(value), F.lit(" to "), bound, F.lit(" "), shown(threshold))
    rest = chain(
        [
            (level == "buffer", F.concat(F.lit(" (a gap of "), gap_text, F.lit(") to restore the capital conservation buffer."))),
            (level == "target", F.concat(F.lit(" (a shortfall of "), gap_text, F.lit(")."))),
        ],
        F.concat(F.lit(" (a gap of "), gap_text, F.lit(") and document the remediation plan for the Board.")),
    )
    return F.concat(base, rest)


def excerpt(text: Column, pattern: str, most: int = 700) -> Column:
    """The sentence around the first match of a pattern, cut at a word after `most` characters; null without a match."""
    around = F.regexp_extract(text, rf"(?is)(?:^|(?<=[.;:]\s))((?:(?![.;:]\s).){{0,300}}?(?:{pattern}).*?(?:[.;](?=\s|$)|\n|$))", 1)
    cut = F.when(F.length(around) > most, F.concat(F.regexp_replace(F.substring(around, 1, most - 1), r"\s+\S*$", ""), F.lit("…"))).otherwise(around)
    return F.nullif(F.trim(cut), F.lit(""))


def syllables(word: Column) -> Column:
    """Vowel groups of up to two letters; a silent e, es or ed at the end and a y at the start count for nothing."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    bare = F.regexp_replace(F.regexp_replace(w, r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]{1,2}"))))


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade; null for a text without words."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0))
    parts = F.size(F.filter(F.split(text, r"[.!?;:]+(?:\s|$)"), lambda s: s.rlike("[A-Za-z]")))
    total = F.aggregate(words, F.lit(0), lambda n, w: n + syllables(w))
    return F.when((F.size(words) > 0) & (parts > 0), 0.39 * F.size(words) / parts + 11.8 * total / F.size(words) - 15.59)
