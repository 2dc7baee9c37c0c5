"""What a document's title and opening say: institution categories, topics, addressees, reference, date, profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import chain

# Institution categories with the wording that names them, in order.
CATEGORIES = (
    ("commercial_banks", r"commercial banks?|universal banks?|\bSCBs?\b|foreign banks?"),
    ("small_finance_banks", r"small finance banks?"),
    ("payments_banks", r"payments? banks?"),
    ("local_area_banks", r"local area banks?"),
    ("regional_rural_banks", r"regional rural banks?|\bRRBs?\b"),
    ("urban_cooperative_banks", r"urban co-?operative banks?|\bUCBs?\b"),
    ("rural_cooperative_banks", r"rural co-?operative banks?|state co-?operative banks?|district central co-?operative banks?"),
    ("all_india_financial_institutions", r"all india financial institutions?|\bAIFIs?\b"),
    ("nbfc", r"non-?banking financial compan(?:y|ies)|\bNBFCs?\b|housing finance compan(?:y|ies)|core investment compan(?:y|ies)|standalone primary dealers?|mortgage guarantee compan(?:y|ies)|non-operative financial holding compan(?:y|ies)"),
    ("asset_reconstruction_companies", r"asset reconstruction compan(?:y|ies)"),
    ("credit_information_companies", r"credit information compan(?:y|ies)"),
    ("non_bank_ppi_issuers", r"non-?bank prepaid payment instruments? issuers?|\bPPI issuers?\b"),
    ("primary_dealers", r"(?<!standalone )primary dealers?"),
)
MULTIPLE = "multiple"
# Topic families with the wording of their topics, in order.
FAMILIES = (
    ("kyc_aml", r"know your customer|\bkyc\b|money laundering|\bpmla\b|\bcft\b|beneficial owner"),
    ("capital_adequacy", r"capital adequacy|capital requirement|basel|leverage ratio|resource raising|capital instruments|prudential norms on capital"),
    ("asset_quality", r"income recognition|asset classification|provisioning|non-?performing"),
    ("credit_risk", r"credit facilities|credit risk|concentration risk|large exposure|exposure norms|lending to related|interest rates? on advances|wilful defaulter|credit information reporting"),
    ("stressed_assets", r"stressed assets|resolution|securiti[sz]ation|transfer and distribution of credit risk|sale of loan|restructur|asset reconstruction"),
    ("liquidity_alm", r"liquidity|asset liability|\balm\b|cash reserve ratio|statutory liquidity|\bcrr\b|\bslr\b"),
    ("investments", r"investment portfolio|classification, valuation|operation of investment|primary dealers?|government securities|relief/savings bonds|savings bonds|market risk|derivative"),
    ("governance", r"governance|board|directors?|remuneration|acquisition (?:and holding )?of shar|voting rights|shareholding|fit and proper|holding company"),
    ("licensing", r"licens|registration|authoris|branch|amalgamation|wholly owned subsidiar|setting up|scheduling|regulatory classification|undertaking of financial services|exemptions"),
    ("customer_protection", r"ombudsman|grievance|responsible business conduct|customer service|fair practice|customer protection|complaint"),
    ("deposits", r"deposits?|interest rates? on deposits"),
    ("cards_payments", r"credit cards?|debit cards?|payment|prepaid|digital banking|account aggregator|peer to peer"),
    ("outsourcing_it", r"outsourcing|information technology|\bit framework\b|cyber"),
    ("fraud_risk", r"fraud|operational risk"),
    ("reporting", r"financial statements|disclosures?|returns?|reporting|auditor|audit"),
    ("dividends", r"dividend|profit remittance"),
    ("priority_sector", r"priority sector|msme|micro, small|agricultur|natural calamit|relief measures|financial inclusion|microfinance"),
    ("climate", r"climate|sustainab|green"),
    ("entity_frameworks", r"^(?:housing finance|core investment|mortgage guarantee|credit information|asset reconstruction|non-operative financial holding)\s+compan|^standalone primary dealers|^operational guidelines for primary dealers"),
    ("miscellaneous", r"miscellaneous|forthcoming instructions"),
)
# Systemically important banks, categories by a bank's name, kinds of documents, all in order.
DSIB = r"(?i)state\s+bank\s+of\s+india|\bhdfc\s+bank\b|\bicici\s+bank\b"
NAMED_LIKE = (
    ("small_finance_banks", r"small\s+finance\s+bank"),
    ("payments_banks", r"payments?\s+bank"),
    ("rural_cooperative_banks", r"(?:state|district\s+central)\s+co-?\s?operative\s+bank|\bdccb\b|\bstcb\b"),
    ("urban_cooperative_banks", r"co-?\s?operative\s+bank|sahakari\s+bank|\bco-?op\.?\s+bank|urban\s+bank"),
    ("regional_rural_banks", r"gramin\s+bank|grameen\s+bank|regional\s+rural\s+bank|gramin\s+vikas\s+bank"),
    ("local_area_banks", r"local\s+area\s+bank"),
    ("all_india_financial_institutions", r"national\s+housing\s+bank|\bnabard\b|national\s+bank\s+for\s+(?:agriculture|financing\s+infrastructure)|\bsidbi\b|small\s+industries\s+development\s+bank|export[\s-]import\s+bank|exim\s+bank"),
    ("commercial_banks", r"\bbank\b"),
    ("nbfc", r"finance\s+(?:ltd|limited|company)|financial\s+services\s+(?:ltd|limited)|housing\s+finance|\bnbfc\b|capital\s+(?:ltd|limited)"),
)
DOCUMENT_KINDS = (
    ("pillar3", r"pillar[\s-]*(?:3|iii)\b|\bKM1\b|\bDF-\d{1,2}\b|basel\s+iii\s+disclosures?|market\s+discipline"),
    ("annual_report", r"annual\s+report|directors'?\s+report|notes\s+(?:to|forming\s+part\s+of\s+the)\s+(?:the\s+)?accounts|schedule\s+1[78]\b|significant\s+accounting\s+policies|auditors?'?\s+report"),
    ("financial_results", r"(?:un)?audited\s+(?:standalone\s+|consolidated\s+)?financial\s+results|regulation\s+33|analytical\s+ratios|segment\s+(?:wise\s+)?results|quarter\s+ended"),
    ("board_minutes", r"minutes\s+of\s+the|board\s+meeting|resolved\s+that|the\s+board\s+(?:noted|approved|reviewed)"),
    ("policy", r"\bpolicy\b.{0,40}\b(?:approved\s+by\s+the\s+board|review(?:ed)?\s+annually|objective|scope)|this\s+policy"),
)
_SET_ASIDE = r"exclud\w*|other\s+than|except"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: A day as it is written in running text.
WRITTEN_DAY = rf"\d{{1,2}}(?:st|nd|rd|th)?\s*{_MONTH}\.?,?\s*\d{{4}}|{_MONTH}\.?\s*\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}"
_BETWEEN = r"\s*[–—]\s*|\s+-\s*|-\s+|:\s+"


def _first(x: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return chain([(x.rlike(f"(?i){p}"), F.lit(name)) for name, p in patterns], F.lit(None).cast("string"))


def _all(x: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return F.array_compact(F.array(*[F.when(x.rlike(f"(?i){p}"), F.lit(name)) for name, p in patterns]))


def title_category(title: Column) -> Column:
    """The institutions that a title names, before the dash within its brackets first, then anywhere; null where it names none."""
    head = F.regexp_extract(title, r"\(((?:[^()]|\([^()]*\))+?)\s*[-–—:]\s*[^()]+\)", 1)
    return F.coalesce(_first(head, CATEGORIES), _first(title, CATEGORIES), F.when(title.rlike("(?i)regulated entities"), MULTIPLE))


def covered_categories(text: Column) -> Column:
    """The institutions that a statement covers: those within an "excluding", "other than" or "except" are left out. What is set
    aside ends with a closing bracket, with "including", or after 160 characters."""
    aside = rf"(?i)\b(?:{_SET_ASIDE})\b(?:(?!\b(?:including|{_SET_ASIDE})\b)[^)}}]){{0,160}}"
    return _all(F.regexp_replace(text, aside, " | "), CATEGORIES)


def applicability(paragraphs: Column, preamble: Column) -> Column:
    """What says to whom a document applies: in its first 25 paragraphs up to 1,500 characters from "these directions shall apply
    to" on, and the addressees before a letter's salutation."""
    applies = r"(?is)(?:these|this|the\s+provisions\s+of\s+these)\s+(?:master\s+)?directions?\b[^.]{0,120}?\b(?:shall|will|are|is)\b[^.]{0,60}?\b(?:apply|applicable)\s+to.*"
    said = F.transform(F.slice(paragraphs, 1, 25), lambda p: F.substring(F.regexp_extract(F.regexp_replace(p, r"\s+", " "), applies, 0), 1, 1500))
    letter = F.regexp_extract(F.substring(preamble, 1, 1500), r"(?s)^(.*?)(?:Madam|Dear\s+Sir|Sir\s*/\s*Madam|Sir,)", 1)
    return F.array_join(F.filter(F.concat(said, F.array(F.coalesce(letter, F.lit("")))), lambda s: s != ""), " ")


def categories(title: Column, hint: Column, applies: Column) -> Column:
    """category and source of all that a document covers, the primary first: its title, then the caller's hint, and only without
    both its statement of applicability. Several without one in the title, or "all banks" in a statement, make it `multiple`."""
    row = lambda x, source: F.struct(x.alias("category"), F.lit(source).alias("source"))
    named = F.when(title_category(title) != MULTIPLE, title_category(title))
    known = F.filter(F.array(row(named, "title"), row(F.when((hint != MULTIPLE) & ~F.coalesce(hint == named, F.lit(False)), hint), "hint")), lambda r: r["category"].isNotNull())
    stated = F.transform(covered_categories(F.coalesce(applies, F.lit(""))), lambda x: row(x, "applicability"))
    found = F.when(F.size(known) > 0, known).otherwise(stated)
    wide = (F.size(known) == 0) & applies.rlike(r"(?i)\b(?:every|all)\s+(?:scheduled\s+)?banks?\b|\bscheduled\s+banks?\b")
    several = (F.size(found) == 0) | (named.isNull() & (F.size(found) > 1)) | F.coalesce(wide, F.lit(False))
    return F.when(several, F.concat(F.array(row(F.lit(MULTIPLE), "inferred")), found)).otherwise(found)


def topic(title: Column) -> Column:
    """A document's subject as its title words it: what follows the institution within the brackets, else the title without its
    frame; years, abbreviations, exceptions and dangling words go."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    inner = F.regexp_extract(t, r"(?i)[\[(]((?:[^()\[\]]|\([^()]*\))+)[\])]\s*(?:Directions?|Guidelines)", 1)
    inner = F.when(F.lower(F.trim(inner)).isin("", "reserve bank"), None).otherwise(F.trim(inner))
    sides = F.split(inner, _BETWEEN, 2)
    within = F.when((F.size(sides) == 2) & _first(F.get(sides, F.lit(0)), CATEGORIES).isNotNull(), F.get(sides, F.lit(1))).otherwise(inner)
    bare = F.replace(F.regexp_replace(t, r"(?i)^\s*Master\s+Directions?\s*(?:on\b|[-–—:])?\s*", ""), F.lit("(Reserve Bank)"))
    without = F.trim(F.regexp_replace(bare, "(?i)" + "|".join(p for _, p in CATEGORIES), ""), F.lit(" -–—:,"))
    x = F.coalesce(within, F.when(F.length(without) > 3, without).otherwise(bare))
    for pattern in (r"(?i)\s*\((?:including|excluding)[^)]*\)", r"\s*\(\s*[A-Z]{2,6}s?\s*\)", r"(?i)\b(?:Directions?|Guidelines),?\s*\d{4}.*$", r"\s*[-–—]\s*(?:SCBs|RRBs|UCBs)\s*$", r"\s+(?:in|for|of|to)\s*$", r"(?i)^\s*(?:for|on|in)\s+(?:the\s+)?"):
        x = F.regexp_replace(x, pattern, "")
    x = F.trim(F.regexp_replace(x, r"\s{2,}", " "), F.lit(" -–—:,."))
    return F.when(x != "", x).otherwise(t)


def topic_families(title: Column, subject: Column) -> Column:
    """The families of a topic; of the whole title where the topic fits none; `other` where neither does."""
    by_topic, by_title = _all(subject, FAMILIES), _all(F.coalesce(title, F.lit("")), FAMILIES)
    return F.when(F.size(by_topic) > 0, by_topic).when(F.size(by_title) > 0, by_title).otherwise(F.array(F.lit("other")))


def header(text: Column) -> dict[str, Column]:
    """reference, date, department and label of the last update, as the first page's text has them; empty where it has none."""
    pick = lambda p: F.trim(F.regexp_extract(text, p, 1))
    return {
        "reference": pick(r"(RBI/(?:[\w\-]+/)?\d{4}-\d{2}/\d+)"),
        "date": pick(r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4})\b"),
        "department": pick(r"\b((?:[A-Z][A-Za-z]{1,6}\.){1,4}[A-Za-z0-9().\- /]*?/\d{2}[.\-]\d{2}[.\-]\d{3}/\d{4}-\d{2})"),
        "updated": pick(r"(?i)\(\s*Updated\s+as\s+on\s+([^)]+)\)"),
    }


def written_day(x: Column) -> Column:
    """A written day as a date, months in full or cut short; null where there is no such day."""
    tidy = F.lower(x)
    part = lambda p, i: F.regexp_extract(tidy, p, i)
    day_first, month_first, digits = r"(\d{1,2})(?:st|nd|rd|th)?\s*([a-z]{3})[a-z]*\.?,?\s*(\d{4})", r"([a-z]{3})[a-z]*\.?\s*(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})", r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    month = lambda name: ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int").cast("string")
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")
    return chain(
        [
            (part(day_first, 1) != "", made(part(day_first, 3), month(part(day_first, 2)), part(day_first, 1))),
            (part(month_first, 2) != "", made(part(month_first, 3), month(part(month_first, 1)), part(month_first, 2))),
            (part(digits, 1) != "", made(part(digits, 3), part(digits, 2), part(digits, 1))),
        ],
        F.lit(None).cast("date"),
    )


def category_of_name(name: Column) -> Column:
    """A bank's category from its name."""
    return _first(name, NAMED_LIKE)
