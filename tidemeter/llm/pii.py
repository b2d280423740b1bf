"""Surrogates for personal data: detected entities receive keyed replacements of their own kind and format.

Equal entities receive equal surrogates everywhere (coreference): mails by lower case, numbers by their
digits whatever their signs, names word by word, so "Mrs Ada Byron" and "Mrs Byron" stay related. A person is
found after a title, with up to four name words; where a document names one, the capitalised occurrences of those
words without a title are replaced in it too. Persons that a document names by no title stay. A surrogate
is a keyed hash shaped like its entity: digits fill the entity's own format, card numbers keep their issuer
digit and stay valid or invalid, names keep gender, script and capitals. Collision checks then compare all
surrogates with each other and with all entities found; who loses is hashed anew, until surrogates are
distinct and none is a real entity of the corpus. Occurrences compute their surrogate in place and join only
with the few entities that were hashed anew. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import settle

#: Attempts after which a surrogate is lengthened by hash digits, so that even a full range of values ends.
WIDEN = 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Г-н", "Κος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Г-жа", "Κα")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=lambda t: -len(t)))
#: A possessive ending is no part of a name.
_NAME = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L}))){1,30}"
#: Places between a capitalised word and what stands beside it.
_CAPITALISED = r"(?<![\p{L}\p{N}_'’-])(?=\p{Lu})|(?<=\p{L})(?![\p{L}'’-])|(?=['’]s(?!\p{L}))"
_MAIL = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}0-9"
_V6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![0-9A-Za-z:])"
#: Numbers without a country: an area code in brackets, one that begins with 0, or three, three and four digits.
_LOCAL = (r"(?<![0-9+.()-])(?:\([0-9]{2,5}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,2}"
          r"|0[0-9]{1,4}[ /-](?:[0-9]{5,8}|[0-9]{3,4}(?:[ -][0-9]{2,6}){1,3})|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9]|[.-][0-9])")
#: Kind -> pattern; a text is searched once, and of patterns that match at one place the first counts.
KINDS = {
    "email": rf"(?<![{_MAIL}._%+-])[{_MAIL}._%+-]++@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,8}}\.[A-Za-z]{{2,24}}(?![A-Za-z0-9])",
    "secret": r"(?i:password|passwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_-]{8,200}+",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|" + _LOCAL,
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|{_V6}",
    "person": rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,3}}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_SECRET = r"^(.*?[=:]\s{0,3}[\"']?)([A-Za-z0-9_-]+)$"
_PERSON = rf"^((?:{_TITLES})\.? )(.*)$"
#: Syllables that invented names are made of, by script, and endings by gender.
SYLLABLES = {
    "latin": ("ba", "do", "fe", "ga", "hi", "jo", "ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "ze"),
    "cyrillic": ("ба", "до", "фе", "га", "хи", "жо", "ка", "ло", "ми", "ну", "пе", "ра", "со", "ти", "ву", "зе"),
    "greek": ("βα", "δο", "φε", "γα", "χι", "ζο", "κα", "λο", "μι", "νυ", "πε", "ρα", "σο", "τι", "ξυ", "θε"),
}
ENDINGS = {"latin": {"m": "n", "f": "la", "n": "s"}, "cyrillic": {"m": "н", "f": "ла", "n": "й"}, "greek": {"m": "ς", "f": "λα", "n": "ν"}}


def _byte(h: Column, i: Column) -> Column:
    """Number i of the 32 bytes of a hash in hex; beyond them they come round again."""
    return F.conv(F.substring(h, 1 + F.pmod(i, F.lit(32)) * 2, F.lit(2)), 16, 10).cast("int")


def _digits(h: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.pmod(_byte(h, i) * 7 + i, F.lit(10)).cast("string")), "")).otherwise("")


def _shape(value: Column, h: Column) -> Column:
    """ASCII letters by letters of their case, other letters by small ones, digits by digits, other characters kept; hexadecimal stays so."""
    width = F.when(value.rlike("^[0-9a-f:]+$"), 6).otherwise(26)

    def char(c: Column, i: Column) -> Column:
        b = _byte(h, i) + F.floor(i / 32).cast("int") * 11
        letter = F.chr(F.lit(97) + F.pmod(b, width))
        return F.when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), char), "")


def _luhn(digits: Column) -> Column:
    """The sum that decides about the last of 16 digits, over the first 15."""
    def weigh(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return a + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), weigh)


def _invented(h: Column, script: str, gender: Column | None, attempt: Column) -> Column:
    names = F.array(*(F.lit(s) for s in SYLLABLES[script]))
    some = [F.element_at(names, F.pmod(_byte(h, F.lit(i)), F.lit(16)) + 1) for i in range(5)]
    end = F.lit(ENDINGS[script]["n"])
    if gender is not None:
        end = F.when(gender == "m", ENDINGS[script]["m"]).when(gender == "f", ENDINGS[script]["f"]).otherwise(ENDINGS[script]["n"])
    return F.concat(*some[:3 if gender is not None else 4], F.when(attempt > 2, some[4]).otherwise(""), end)


def surrogate(key: str, kind: Column, value: Column, gender: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    digits = F.length(value)
    card = F.concat(F.substring(value, 1, 1), _digits(h, F.lit(14)))
    sound = F.pmod(_luhn(value) + F.substring(value, 16, 1).cast("int"), F.lit(10)) == 0
    last = F.pmod(F.lit(10) - F.pmod(_luhn(card), F.lit(10)) + F.when(sound, 0).otherwise(1 + F.pmod(_byte(h, F.lit(20)), F.lit(9))), F.lit(10))
    country = F.when(value.rlike("^[17]"), 1).otherwise(2)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    name = F.lower(F.lit(""))
    for part in ("first", "last"):
        for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", ".")):
            made = _invented(h, script, gender if part == "first" else None, attempt)
            name = F.when((kind == part) & value.rlike(test) & (name == ""), made).otherwise(name)
    made = (
        F.when(kind == "email", F.concat(_shape(local, h), F.lit("@"), _shape(host, of_domain), F.lit("."), top))
        .when(kind == "secret", _shape(value, h))
        .when(kind == "key", F.concat(F.lit("AKIA"), _shape(F.substring(value, 5, 16), h)))
        .when(kind == "card", F.concat(card, last.cast("string")))
        .when(kind == "phone", F.concat(F.substring(value, F.lit(1), country), _digits(h, digits - country)))
        .when((kind == "ip") & value.contains(":"), _shape(value, h))
        .when(kind == "ip", F.concat_ws(".", *((F.pmod(_byte(h, F.lit(i)) + _byte(h, F.lit(i + 8)), F.lit(254)) + 1).cast("string") for i in range(4))))
        .otherwise(name))
    return F.when(attempt >= WIDEN, F.concat(made, F.when(kind.isin("card", "phone"), _digits(h, F.lit(8))).when(kind == "ip", F.lit("")).otherwise(F.regexp_replace(F.substring(h, 1, 8), "[0-9]", "a")))).otherwise(made)


def _render(kind: Column, raw: Column, made: Column) -> Column:
    """In the format of the occurrence: digits fill its own places, a name takes its capitals."""
    def fill(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(made, before, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.split(raw, ""), fill), "")
    rest = F.substring(made, F.length(F.regexp_replace(raw, "[^0-9]", "")) + 1, F.lit(99))
    return (F.when(kind.isin("card", "phone"), F.concat(filled, rest))
            .when(kind.isin("first", "last"), F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(made)).otherwise(F.initcap(made)))
            .otherwise(made))


def _occurrences(docs: DataFrame) -> DataFrame:
    """``d, key, at, part, kind, gender, lead, raw, value``: what is replaced in each match, and what is kept before it."""
    found = docs.where("text is not null").select("d", "key", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")).where(F.size("found") > 0)
    found = found.select("d", "key", F.posexplode("found").alias("at", "match"))
    m = F.col("match")
    kind = F.lit("person")
    for k in ("ip", "phone", "card", "key", "secret", "email"):
        kind = F.when(m.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(kind)
    found = found.withColumn("kind", kind)
    title = F.regexp_extract(m, _PERSON, 1)
    bare = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")
    names = F.split(F.regexp_extract(m, _PERSON, 2), " ")
    one = lambda kind, gender, lead, raw: F.struct(kind.alias("kind"), gender.alias("gender"), lead.alias("lead"), raw.alias("raw"))
    no = F.lit("")
    # The last of several words is a family name, those before it are given names.
    person = F.transform(names, lambda w, i: F.when(i == F.size(names) - 1, one(F.lit("last"), no, F.when(i == 0, title).otherwise(" "), w)).otherwise(
        one(F.lit("first"), gender, F.when(i == 0, title).otherwise(" "), w)))
    secret = F.array(one(F.lit("secret"), no, F.regexp_extract(m, _SECRET, 1), F.regexp_extract(m, _SECRET, 2)))
    parts = F.when(F.col("kind") == "person", person).when(F.col("kind") == "secret", secret).otherwise(F.array(one(F.col("kind"), no, no, m)))
    found = found.select("d", "key", "at", F.posexplode(parts).alias("part", "p")).select("d", "key", "at", "part", "p.*")
    value = F.when(F.col("kind").isin("phone", "card"), F.regexp_replace("raw", "[^0-9]", "")).when(F.col("kind").isin("email", "ip", "first", "last"), F.lower("raw")).otherwise(F.col("raw"))
    return found.withColumn("value", value)


def hashed_anew(occurrences: DataFrame, key: str) -> DataFrame:
    """``kind, value, made`` of the entities whose first surrogate does not stand."""
    # A name that occurs with both genders is neutral; one without gender takes the other occurrences'.
    told = F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender")))
    entities = occurrences.groupBy("kind", "value", "gender").count().groupBy("kind", "value").agg(told.alias("told"), F.count("*").alias("ways"))
    entities = entities.withColumn("gender", F.when(F.size("told") == 1, F.element_at("told", 1)).when(F.col("kind") == "first", "n").otherwise(""))
    real = settle(entities.select("kind", "value", "gender", "ways"), "entities")
    held = real.withColumn("attempt", F.lit(0))
    names = real.select(F.col("kind"), F.col("value").alias("made"), F.lit(1).alias("taken"))
    while True:
        held = held.withColumn("made", surrogate(key, F.col("kind"), F.col("value"), F.col("gender"), F.col("attempt")))
        held = settle(held, "surrogates")
        # The one hashed least often keeps a surrogate that several claim.
        claim = F.struct("attempt", F.xxhash64("value"), "value")
        owners = held.groupBy("kind", "made").agg(F.min(claim).alias("owner"))
        judged = held.join(owners, ["kind", "made"]).join(names, ["kind", "made"], "left")
        lost = F.col("taken").isNotNull() | (F.col("owner") != claim)
        judged = settle(judged.select("kind", "value", "gender", "ways", "made", "attempt", lost.alias("lost")), "judged")
        if judged.where("lost").isEmpty():
            return judged.where("attempt > 0 or ways > 1").select("kind", "value", "made")
        held = judged.withColumn("attempt", F.col("attempt") + F.col("lost").cast("int")).drop("lost", "made")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with surrogates in ``text``, and ``n_entities`` (matches; names
    without a title are replaced and not counted) and ``kinds`` (a sorted list).

    ``key`` is the secret that ties surrogates to entities. Null texts stay null. Rows repeated exactly get
    the same text; ids may be null or repeated. Columns of ``docs`` named like an added one give way to it.
    """
    docs = docs.drop("n_entities", "kinds")
    text = F.col("text").cast("string")
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = _occurrences(row.select("d", "key", "text"))
    found = settle(found.repartition("d", "key").dropDuplicates(["d", "key", "at", "part"]), "occurrences")
    anew = hashed_anew(found, key).withColumnRenamed("made", "other")
    first = surrogate(key, F.col("kind"), F.col("value"), F.col("gender"), F.lit(0))
    put = found.join(anew, ["kind", "value"], "left").withColumn("made", F.coalesce("other", first))
    put = put.select("d", "key", "at", "part", "kind", "value", "made", F.concat("lead", _render(F.col("kind"), F.col("raw"), F.col("made"))).alias("new"))
    whole = put.groupBy("d", "key").agg(F.array_sort(F.collect_list(F.struct("at", "part", "new"))).alias("puts"), F.array_sort(F.collect_set("kind")).alias("kinds"),
                                         *(F.map_from_entries(F.collect_set(F.when(F.col("kind") == k, F.struct("value", "made")))).alias(k) for k in ("first", "last")))
    last = F.element_at("puts", -1)["at"]
    news = F.transform(F.sequence(F.lit(0), last), lambda a: F.array_join(F.transform(F.filter("puts", lambda p: p["at"] == a), lambda p: p["new"]), ""))
    whole = whole.select("d", "key", news.alias("news"), "kinds", "first", "last")
    both = row.drop("text").join(whole, ["d", "key"], "left")
    gaps = F.split(F.col("row.text").cast("string"), PATTERN, -1)
    named = F.size("last") > 0

    def untitled(w: Column) -> Column:
        low = F.lower(w)
        made = F.coalesce(F.try_element_at("last", low), F.try_element_at("first", low))
        return F.when(w.rlike(r"^\p{Lu}") & made.isNotNull(), _render(F.lit("last"), w, made)).otherwise(w)

    pieces = F.transform(gaps, lambda g, i: F.concat(F.when(named, F.array_join(F.transform(F.split(g, _CAPITALISED, -1), untitled), "")).otherwise(g), F.coalesce(F.get("news", i), F.lit(""))))
    changed = F.when(F.col("news").isNull(), F.col("row.text")).otherwise(F.array_join(pieces, ""))
    return both.select(
        *((changed.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in docs.columns),
        F.coalesce(F.size("news"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def report(docs: DataFrame, key: str = "query key") -> DataFrame:
    """Per document: ``has_private``, ``n_entities``, ``kinds`` comma-joined, and the new text."""
    made = replace(docs.select("doc_id", "text"), key)
    count = F.when(F.col("n_entities") > 0, F.col("n_entities")).otherwise(0)
    return made.select("doc_id", (count > 0).alias("has_private"), count.cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"), "text")
