"""Personal data replaced by keyed surrogates, in DataFrame expressions only."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, flat, materialize, pick

KEY_SETTING = "spark.clausewright.pii.key"
#: So many times an entity tries surrogates of its own form; from then on each further one is longer by a character.
ROUNDS = 5
#: Up to so many entities in conflict their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 10_000

# Titles, given names (the words that mark a name) and the surrogates to choose from.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Sr", "Sra", "Señor", "Señora", "Господин", "Госпожа")
FEMALE = (
    "Anna", "Maria", "Emma", "Laura", "Julia", "Sophie", "Marie", "Claire", "Elena", "Carmen", "Lucia", "Sarah", "Emily", "Alice", "Helen", "Susan",
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Jessica", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Katharina", "Sabine", "Isabelle", "Nathalie", "Pilar", "Teresa", "Rosa", "Monika",
)
MALE = (
    "John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Klaus", "Pierre", "Jean", "Luis", "Carlos", "Javier", "Paul", "Mark",
    "William", "Richard", "Joseph", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Steven", "Andrew", "George", "Edward", "Stefan", "Jürgen", "Wolfgang", "Philippe", "Antonio", "José", "Manuel", "Martin",
)
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья", "Ирина", "Светлана")
MALE_CYRILLIC = ("Иван", "Алексей", "Дмитрий", "Сергей", "Андрей", "Николай", "Павел", "Михаил")
SURNAMES = ("Keller", "Novak", "Lindgren", "Moreau", "Castillo", "Fischer", "Hughes", "Dubois", "Romero", "Barker", "Vogel", "Laurent", "Ibarra", "Whitman", "Sommer", "Garnier")
#: Surnames beyond the lists are built of these.
SYLLABLES = ("ba", "ren", "dal", "mor", "vin", "tes", "lan", "ker", "hol", "sen", "wic", "fel", "ro", "mar", "tin", "gar", "fi", "dor", "ste", "ber", "ley", "ton", "ver", "nic", "sal", "per", "lin", "hau", "gen", "cro", "bel", "ash")
SYLLABLES_CYRILLIC = ("бо", "ре", "да", "мо", "ви", "ла", "ко", "се", "ро", "ма", "ти", "га", "до", "ве", "ни", "са")
SURNAMES_CYRILLIC = ("Орлов", "Волков", "Соколов", "Лебедев", "Козлов", "Морозов", "Павлов", "Егоров")

_GIVEN = FEMALE + MALE + FEMALE_CYRILLIC + MALE_CYRILLIC
#: Known names as they stand in texts, in capitals as well.
_WRITTEN = tuple(sorted({*_GIVEN, *(n.upper() for n in _GIVEN)}, key=lambda n: (-len(n), n)))
_TITLES = tuple(sorted({*TITLES, *(t.upper() for t in TITLES)}, key=lambda n: (-len(n), n)))
_LABEL = r"(?=[PpTtSsAa])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?"
#: The kinds of entity, in the order in which they are looked for.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": _LABEL + r"[A-Za-z0-9_\-./+]{6,}",
    "aws": r"AKIA[0-9A-Z]{16}\b",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){0,4}:)[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "intl": r"\+[1-9][0-9]{0,2}(?:[ ./-]?\(?[0-9]{2,8}\)?){2,5}(?![0-9])",
    "given": r"(?=\p{Lu})(?:" + "|".join(_WRITTEN) + r")(?= \p{Lu}[\p{L}'’]+)",
    "surname": r"(?=\p{Lu}[\p{L}'’])(?<=\b(?:" + "|".join(_TITLES) + r")\.? |\b(?:" + "|".join(_WRITTEN) + r") )\p{Lu}[\p{L}'’][\p{L}'’-]{0,40}",
}
#: Where each kind may begin. An e-mail address begins where its run of characters does, or the last match
#: ended; a secret's label anywhere; the rest is told apart by its first character before it is tried.
_ANY_OF = lambda *kinds: "(?:" + "|".join(PATTERNS[k] for k in kinds) + ")"
ANY = "|".join((
    r"(?:\G|(?<![\p{L}\p{N}._%+-]))" + PATTERNS["email"],
    PATTERNS["secret"],
    r"(?=\p{Lu})(?:(?<![\p{L}\p{N}_])" + _ANY_OF("aws", "iban", "given") + "|" + PATTERNS["surname"] + ")",
    r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:])" + PATTERNS["ip6"],
    r"(?=[0-9+(])(?<![0-9])(?:(?<![.vV])" + PATTERNS["ip"] + "|" + _ANY_OF("ssn", "card", "phone", "intl") + ")",
))
#: Texts with neither hold no entity, and most texts end here. The class before the names lets the search
#: stop at capital letters alone.
_WORDS = _TITLES + _WRITTEN
_MARKS = "[0-9@=:]|AKIA"
_NAMES = "(?=[" + "".join(sorted({w[0] for w in _WORDS})) + "])(?:" + "|".join(_WORDS) + ")"


def _kind(m: Column) -> Column:
    """The kind of a match, by the pattern that the whole of it fits; context has been checked already."""
    whole = dict(PATTERNS, given="(?:" + "|".join(_WRITTEN) + ")", surname=r"\p{Lu}.*")
    tests = [(k, m.rlike(f"^(?:{p})$")) for k, p in whole.items()]
    return reduce(lambda rest, t: F.when(t[1], F.lit(t[0])).otherwise(rest), reversed(tests), F.lit("surname"))


_DIGITS = ("phone", "card", "ssn", "intl")


def _digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _label(kind: Column, m: Column) -> Column:
    """The part of a match that stays: a secret's label, a phone number's country code."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]?(?=[(0-9])", 0)
    return F.when(kind == "secret", F.regexp_extract(m, f"^{_LABEL}", 0)).when((kind == "phone") & (F.length(_digits_of(m)) > 10), F.when(F.length(_digits_of(code)) == F.length(_digits_of(m)) - 10, code).otherwise("")).otherwise("")


def _canon(kind: Column, core: Column) -> Column:
    """What makes two mentions the same entity: digits alone, or letters without case and spaces."""
    return F.when(kind.isin(*_DIGITS), _digits_of(core)).when(kind.isin("email", "ip6"), F.lower(core)).when(kind == "iban", F.regexp_replace(core, " ", "")).when(kind.isin("given", "surname"), F.initcap(core)).otherwise(core)


def _read(matches: Column) -> Column:
    """Matches as structs (kind, label, core, canon). Each step is a lambda of its own, so that what a later
    one uses twice is computed once."""
    steps = (
        lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")),
        lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _label(x["kind"], x["m"]).alias("label")),
        lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), F.substring(x["m"], F.length(x["label"]) + 1, F.length(x["m"])).alias("core")),
        lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), x["core"].alias("core"), _canon(x["kind"], x["core"]).alias("canon")),
    )
    return reduce(F.transform, steps, matches)


def _hex(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits for an entity."""
    said = lambda part: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(part), kind, canon, attempt.cast("string"), F.lit(key)), 256)
    return F.concat(said("a"), said("b"))


def _number(hexa: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hexa, at, F.lit(n)), 16, 10).cast("int")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _shape(canon: Column, hexa: Column) -> Column:
    """A letter for a letter of the same case and script, a digit for a digit; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        h = _number(hexa, (i % 64) * 2 + 1, 2)
        letter = lambda first, n: F.chr(F.lit(first) + h % n)
        return (
            F.when(c.rlike("^[0-9]$"), (h % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), letter(97, 26))
            .when(c.rlike("^[A-Z]$"), letter(65, 26))
            .when(c.rlike("^[а-я]$"), letter(0x430, 32))
            .when(c.rlike("^[А-Я]$"), letter(0x410, 32))
            .when(c.rlike(r"^\p{Lu}$"), letter(65, 26))
            .when(c.rlike(r"^\p{L}$"), letter(97, 26))
            .when(c.rlike(r"^\p{N}$"), (h % 10).cast("string"))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(canon), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum modulo 10 of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _mod97(iban: Column) -> Column:
    """Remainder by 97 of an IBAN written as its standard asks: the first four characters last, letters as numbers."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(total: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, (total * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(turned), F.lit(0), add)


def _surname(names: tuple[str, ...], syllables: tuple[str, ...], hexa: Column, attempt: Column) -> Column:
    """A surname of the list; further attempts build one of syllables, one more each time, so the choice never runs out."""
    of = lambda words, at: F.element_at(F.array(*map(F.lit, words)), _number(hexa, at, 4) % len(words) + 1)
    built = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: of(syllables, (i % 30) * 4 + 1)), "")
    return F.when(attempt == 0, of(names, 1)).otherwise(F.initcap(built))


def _given(key: str, canon: Column) -> Column:
    """The surrogate of a given name: its list, same gender and script, is permuted by the key, so that different names
    have different surrogates without a check."""
    found = F.lit(None)
    for names in (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC):
        dealt = sorted(names, key=lambda n: sha256(f"{key}\x1f{n}".encode()).digest())
        turned = dict(zip(dealt, dealt[1:] + dealt[:1], strict=True))  # nobody keeps a name
        pairs = F.create_map(*[F.lit(x) for pair in turned.items() for x in pair])
        found = F.coalesce(F.try_element_at(pairs, canon), found)
    return found


def _decimal(hexa: Column) -> Column:
    return F.rpad(F.regexp_replace(hexa, "[a-f]", ""), 64, "7")


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column, hexa: Column, digits: Column) -> Column:
    """The canonical surrogate of an entity, of the same kind, length and form. After ROUNDS attempts the form is held to
    have no room left: digits or letters are added, an IP address gets numbers beyond 255."""
    more = F.greatest(attempt - ROUNDS, F.lit(0))
    longer = lambda x: F.when(more == 0, x).otherwise(F.concat(x, F.substring(digits, F.lit(45), more)))
    letters = lambda x: F.when(more == 0, x).otherwise(F.concat(_shape(F.repeat(F.lit("a"), more), F.reverse(hexa)), x))
    n = F.length(canon)
    first = F.substring(digits, 1, 1).cast("int")
    run = lambda start, count: F.substring(digits, F.lit(start), count)
    card = F.concat(F.substring(canon, 1, 1), run(1, n - 2))
    check = ((10 - _luhn(F.concat(card, F.lit("0")))) % 10).cast("string")
    octet = lambda o, i: (
        F.when(more > 0, _number(hexa, i * 4 + 1, 4) % 744 + 256)
        .when(F.length(o) == 1, _number(hexa, i * 4 + 1, 4) % 10)
        .when(F.length(o) == 2, _number(hexa, i * 4 + 1, 4) % 90 + 10)
        .otherwise(_number(hexa, i * 4 + 1, 4) % 156 + 100)
        .cast("string")
    )
    host = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    body = F.concat(F.substring(canon, 1, 2), F.lit("00"), _shape(F.substring(canon, F.lit(5), n), hexa))
    return (
        F.when(kind == "email", letters(F.concat(_shape(F.substring(canon, F.lit(1), n - F.length(host)), hexa), host)))
        .when(kind == "given", _given(key, canon))
        .when(kind == "ip6", F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(F.substring(hexa, i + 1, F.lit(1)))), ""))
        .when((kind == "secret") & (F.length(F.regexp_replace(canon, "[^0-9A-Za-z]", "")) < 6), letters(F.substring(F.repeat(hexa, (n / 128 + 1).cast("int")), F.lit(1), n)))
        .when(kind == "secret", letters(F.when(canon.rlike("^[0-9a-f]+$") & (n <= 128), F.substring(hexa, F.lit(1), n)).otherwise(_shape(canon, hexa))))
        .when(kind == "aws", F.concat(F.lit("AKIA"), _shape(F.substring(canon, F.lit(5), n), hexa)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.lpad((98 - _mod97(body)).cast("string"), 2, "0"), F.substring(body, F.lit(5), n)))
        .when(kind == "ip", F.array_join(F.transform(F.split(canon, r"\."), octet), "."))
        .when(kind == "ssn", longer(F.concat((first % 8 + 1).cast("string"), run(2, n - 1))))
        .when(kind == "phone", longer(F.concat((first % 8 + 2).cast("string"), run(2, n - 1))))
        .when(kind == "intl", longer(F.concat(F.substring(canon, 1, 2), run(1, n - 2))))
        .when(kind == "card", longer(F.concat(card, F.when(_luhn(canon) == 0, check).otherwise(run(40, F.lit(1))))))
        .when(canon.rlike(r"^\p{IsCyrillic}"), F.concat(_surname(SURNAMES_CYRILLIC, SYLLABLES_CYRILLIC, hexa, attempt), F.when(canon.rlike("(?:ова|ева|ина)$"), "а").otherwise("")))
        .otherwise(_surname(SURNAMES, SYLLABLES, hexa, attempt))
    )


def _poured(kind: Column, label: Column, core: Column, surrogate: Column) -> Column:
    """The canonical surrogate in the form of the mention: its separators, its case. What is longer follows at the end."""
    rest = lambda n: F.substring(surrogate, n + 1, F.length(surrogate))
    nth = lambda i: F.length(_digits_of(F.substring(core, F.lit(1), i))) + 1
    spaced = F.array_join(F.transform(_chars(core), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(surrogate, nth(i), F.lit(1))).otherwise(c)), "")
    place = lambda i: F.length(F.regexp_replace(F.substring(core, F.lit(1), i), " ", "")) + 1
    gapped = F.array_join(F.transform(_chars(core), lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, place(i), F.lit(1)))), "")
    cased = F.array_join(F.transform(_chars(core), lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    return F.concat(
        label,
        F.when(kind.isin(*_DIGITS), F.concat(spaced, rest(F.length(_digits_of(core)))))
        .when(kind == "iban", gapped)
        .when(kind.isin("email", "ip6"), F.concat(cased, rest(F.length(core))))
        .when(kind.isin("given", "surname") & (core == F.upper(core)), F.upper(surrogate))
        .otherwise(surrogate),
    )


def _found(text: Column) -> Column:
    """The matches of a text, in order."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(_MARKS) | text.rlike(_NAMES), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), none)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), kind, canon of every mention."""
    rows = pick(docs, doc_id="doc_id", text="text")
    found = rows.select("doc_id", F.xxhash64("text").alias("mark"), F.explode(_read(_found(F.col("text")))).alias("x"))
    return found.select("doc_id", "mark", "x.kind", "x.canon")


def conflicts(dictionary: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the entities (distinct kind, canon) whose first surrogate is taken.

    A surrogate is taken if an earlier entity of its kind has it, or if it is itself an entity of the
    documents. Such entities try again until all surrogates differ; each round looks at all of them. A form may have fewer
    free surrogates than entities (all 676 addresses a@b.co may be real): after ROUNDS attempts each further one may choose
    from a tenfold or larger room, so that rounds end whatever the entities are. Given names are permuted and never meet.
    """
    dictionary = dictionary.where("kind <> 'given'")
    state = dictionary.select("kind", "canon", F.lit(0).alias("attempt"))
    last = None
    while True:
        keyed = state.withColumn("h", _hex(key, F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("d", _decimal(F.col("h")))
        offered = keyed.select("kind", "canon", "attempt", _surrogate(key, *(F.col(c) for c in ("kind", "canon", "attempt", "h", "d"))).alias("s"))
        both = offered.select("kind", "s", "canon", "attempt", F.lit(1).alias("turn")).union(dictionary.select("kind", F.col("canon").alias("s"), "canon", F.lit(0), F.lit(0)))
        # One row order for all that share a surrogate: real entities, then who has waited longest.
        order = Window.partitionBy("kind", "s").orderBy("turn", F.col("attempt").desc(), "canon")
        ranked = both.withColumn("rank", F.row_number().over(order)).where("turn = 1")
        state = materialize(ranked.select("kind", "canon", (F.col("attempt") + F.when(F.col("rank") > 1, 1).otherwise(0)).alias("attempt"), (F.col("rank") > 1).alias("moved")), "surrogates")
        if last is not None:
            discard(last)
        last = state
        if not state.where("moved").limit(1).count():
            return state.where("attempt > 0").select("kind", "canon", "attempt")


def replace_pii(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """The documents with each detected entity replaced; all columns stay, and n_entities is added last.

    key is a secret of the caller's: who has it can tell which surrogate an entity gets.

    E-mail and IP addresses, phone, card, social-security and bank account numbers, access keys, labelled
    secrets, and names after a title or a known given name are detected. A surrogate is keyed and of the
    same kind: digits for digits (Luhn and IBAN checks hold where they held), letters for letters of the
    same case, given names of the same gender and script, all in the mention's own format. Secrets of fewer
    than six letters and digits get hexadecimal digits, as their own form leaves too few surrogates; where a form's
    surrogates are used up otherwise, they get longer. Mentions of one
    entity, however formatted, get one surrogate everywhere; different entities of a kind never share one,
    as all surrogates of the table are checked against each other and against the real entities.

    Without conflicts nothing but the table of distinct entities is shuffled. A very long text costs one row's memory,
    which regular expressions read in one pass. A null text stays null, an
    empty one empty, both with 0 entities. Repeated rows are replaced alike. An empty table gives an empty
    result. A column n_entities that is there already is replaced.
    """
    plain, at = flat(docs)
    text = F.col(at["text"])
    mentions = entities(docs)
    taken = conflicts(materialize(mentions.select("kind", "canon").distinct(), "entities"), key)
    n_taken = taken.count()
    rows = plain.withColumn("__m", _found(text))
    attempt = lambda kind, canon: F.lit(0)
    if n_taken:
        per_doc = mentions.join(F.broadcast(taken) if n_taken <= BROADCAST_ROWS else taken, ["kind", "canon"])
        per_doc = per_doc.groupBy(F.col("mark").alias("__mark")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias("__taken"))
        rows = rows.join(per_doc, F.xxhash64(text) == F.col("__mark"), "left")
        attempt = lambda kind, canon: F.coalesce(F.try_element_at("__taken", F.concat_ws("\x1f", kind, canon)), F.lit(0))

    keep = lambda x, *names: [x[n].alias(n) for n in names]
    steps = (
        lambda x: F.struct(*keep(x, "kind", "label", "core", "canon"), attempt(x["kind"], x["canon"]).alias("attempt")),
        lambda x: F.struct(*keep(x, "kind", "label", "core", "canon", "attempt"), _hex(key, x["kind"], x["canon"], x["attempt"]).alias("h")),
        lambda x: F.struct(*keep(x, "kind", "label", "core", "canon", "attempt", "h"), _decimal(x["h"]).alias("d")),
        lambda x: F.struct(*keep(x, "kind", "label", "core"), _surrogate(key, *(x[n] for n in ("kind", "canon", "attempt", "h", "d"))).alias("s")),
        lambda x: _poured(*(x[n] for n in ("kind", "label", "core", "s"))),
    )
    new = reduce(F.transform, steps, _read(F.col("__m")))
    parts = F.zip_with(F.split(text, ANY, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    kept = [(name, F.col(f"_in{i}")) for i, name in enumerate(docs.columns) if name != "n_entities"]
    done = F.when(F.size("__m") > 0, F.array_join(parts, "")).otherwise(text)
    columns = [done if at[name] == at["text"] else column for name, column in kept]
    return rows.select(*columns, F.size("__m").cast("long")).toDF(*[name for name, _ in kept], "n_entities")


def configured_key(spark: SparkSession) -> str:
    """The key that the session names in spark.clausewright.pii.key; without one a new random key, so that surrogates
    cannot be told from the code and differ from run to run."""
    return spark.conf.get(KEY_SETTING, "") or token_hex(32)
