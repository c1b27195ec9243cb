"""Personal data replaced by surrogates, with DataFrame functions only.

An entity's surrogate is drawn from a keyed hash of its canonical spelling, so it is the same wherever the entity
occurs. It keeps the entity's format (marks, case, script, digits as digits) and what makes it plausible: check digits of
cards and bank accounts, the country code of a phone number, octets of an address, the gender of a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_key, unused

# Forms of address and given names by gender, letters by script.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Г-н"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "Г-жа"]
TITLES = ["Dr", "Prof"]
GIVEN = {
    ("latin", "male"): "James John Robert Michael William David Richard Joseph Thomas Charles Hans Peter Klaus Jean Pierre Louis Carlos Juan Miguel Antonio".split(),
    ("latin", "female"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Ursula Monika Sabine Marie Sophie Claire Carmen Lucia Isabel Pilar".split(),
    ("cyrillic", "male"): "Иван Пётр Николай Сергей Алексей Дмитрий Михаил Андрей Павел Юрий".split(),
    ("cyrillic", "female"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Вера".split(),
}
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CONSONANTS = {"latin": "bdfghklmnprstvz", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνπρστφχψ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιου"}

_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + TITLES)
_GIVEN = "|".join(sorted({n for own in GIVEN.values() for n in own}))
_INITIALS = "".join(sorted({n[0] for n in f"{_TITLE}|{_GIVEN}".split("|")}))
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Ways to write each kind; the first that fits at a place wins.
EMAIL = r"(?<![\p{L}\d._%+-])[\p{L}\d_%+-]+(?:\.[\p{L}\d_%+-]+)*@[\p{L}\d-]+(?:\.[\p{L}\d-]+)*\.\p{L}{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<!\d)\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
SOCIAL = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])"
CARD = r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?:\d{1,3})?(?!\d)|(?<!\d)\d{13,19}(?!\d)"
SECRET = r"(?<![\p{L}\d])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\p{L}\d])"
NAME = rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME})(?!\p{{L}})"
#: Tried at each place; what can't begin with the letter there is passed over at once.
UNMAILED = "|".join(
    [
        rf"(?=[\d(+])(?:{IPV4}|{PHONE}|{SOCIAL}|{SECRET}|{CARD})",
        rf"(?=[A-Z]){IBAN}",
        rf"(?=[a-fA-F]){SECRET}",
        rf"(?=[{_INITIALS}]){NAME}",
    ]
)
PATTERN = f"{EMAIL}|{UNMAILED}"


def entities(text: Column) -> Column:
    """All entities of a text in their order. Addresses are looked for where there is an @ only."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.when(text.contains("@"), every(PATTERN)).otherwise(every(UNMAILED))


def between(text: Column) -> Column:
    """What stands before, between and behind the entities."""
    return F.when(text.contains("@"), F.split(text, PATTERN, -1)).otherwise(F.split(text, UNMAILED, -1))


def described(found: Column) -> Column:
    """Entities with their kind and canonical spelling."""
    kinds = F.transform(found, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), canonical(x["entity"], x["kind"]).alias("text")))


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(rf"^(?:{IPV4})$"), "ip")
        .when(entity.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(entity.rlike(rf"^(?:{SOCIAL})$"), "social")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}[ A-Z\d]+$"), "iban")
        .when(entity.rlike(r"^[0-9a-fA-F]{32,}$") & entity.rlike("[a-fA-F]"), "secret")
        .when(entity.rlike(r"^\d[\d -]+$"), "card")
        .otherwise("name")
    )


def canonical(entity: Column, kind: Column) -> Column:
    """One spelling for all ways to write the same entity."""
    return F.when(kind.isin("email", "ip"), F.lower(entity)).otherwise(F.lower(F.regexp_replace(entity, r"[^\p{L}\d+]", "")))


def _stream(key: str, kind: Column, text: Column, attempt: Column) -> Column:
    """Pairs of hex digits, one pair at least for each letter of `text`."""
    block = lambda i: F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), i.cast("string"), text), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(text) / 32).cast("int")), block), "")


def _draw(stream: Column, i: Column) -> Column:
    """The number from 0 to 65535 at place i, from two pairs that overlap its neighbours'."""
    return F.conv(F.substr(stream, i * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _one_of(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of all digits but the last, which is the check digit."""
    body = F.reverse(F.substr(digits, F.lit(1), F.length(digits) - 1))

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.split(body, ""), weighed), F.lit(0), lambda a, x: a + x)


def _checked(digits: Column, original: Column) -> Column:
    """With Luhn's check digit if the original has it."""
    check = lambda d: (10 - _luhn_sum(d) % 10) % 10
    good = check(original) == F.substr(original, F.length(original), F.lit(1)).cast("int")
    return F.when(good, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), check(digits).cast("string"))).otherwise(digits)


def _iban_checked(text: Column) -> Column:
    """With the two check digits of account numbers, by remainders of 97."""
    moved = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(2)), F.lit("00"))

    def value(c: Column) -> Column:
        return F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(F.upper(c)) - 55)

    rest = F.aggregate(
        F.split(moved, ""), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97
    )
    return F.concat(F.substr(text, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(text, F.lit(5), F.length(text)))


def _letters(stream: Column, text: Column, hexadecimal: bool = False) -> Column:
    """Each letter of lower-case `text` by one of its script, each digit by a digit; marks stay."""

    def other(c: Column, i: Column) -> Column:
        n = _draw(stream, i)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), _one_of(CYRILLIC, n))
            .when(c.rlike(r"\p{IsGreek}"), _one_of(GREEK, n))
            .when(c.rlike(r"\p{L}"), _one_of("abcdef" if hexadecimal else LATIN, n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _invented(stream: Column, text: Column, attempt: Column, ending: Column) -> Column:
    """A name in the script of `text`: syllables, one more with each attempt, and an ending."""

    def syllables(script: str) -> Column:
        own = lambda i: F.concat(
            _one_of(CONSONANTS[script], F.conv(F.substr(stream, i * 8 + 1, F.lit(4)), 16, 10).cast("int")),
            _one_of(VOWELS[script], F.conv(F.substr(stream, i * 8 + 5, F.lit(4)), 16, 10).cast("int")),
        )
        return F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt + 3, F.lit(7))), own), "")

    return F.concat(
        F.when(text.rlike(r"\p{IsCyrillic}"), syllables("cyrillic")).when(text.rlike(r"\p{IsGreek}"), syllables("greek")).otherwise(syllables("latin")),
        ending,
    )


def drawn(key: str, kind: Column, text: Column, attempt: Column) -> Column:
    """The surrogate, in canonical spelling, of an entity or part of a name in canonical spelling."""
    stream = _stream(key, kind, text, attempt)
    at = F.locate("@", text)
    local = F.substr(text, F.lit(1), at - 1)
    domain = F.substr(text, at + 1, F.length(text))
    top = F.regexp_extract(domain, r"\.(\p{L}+)$", 0)
    body = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    mail = F.concat(_letters(stream, local), F.lit("@"), _letters(_stream(key, F.lit("domain"), domain, F.lit(0)), body), top)
    octets = F.array_join(F.transform(F.split(text, r"\."), lambda _, i: (_draw(stream, i * 2) % 254 + 1).cast("string")), ".")
    digits = _letters(stream, text)
    cyrillic = text.rlike(r"\p{IsCyrillic}")
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", octets)
        .when(kind == "phone", F.when(text.startswith("+"), F.concat(F.substr(text, F.lit(1), F.lit(2)), F.substr(digits, F.lit(3), F.length(digits)))).otherwise(digits))
        .when(kind == "card", _checked(digits, text))
        .when(kind == "iban", _iban_checked(F.concat(F.substr(text, F.lit(1), F.lit(2)), F.substr(digits, F.lit(3), F.length(digits)))))
        .when(kind == "secret", _letters(stream, text, hexadecimal=True))
        .when(kind == "female", _invented(stream, text, attempt, F.when(cyrillic, "а").otherwise("a")))
        .when(kind == "male", _invented(stream, text, attempt, F.when(cyrillic, "н").otherwise("o")))
        .when(kind == "family", _invented(stream, text, attempt, F.when(cyrillic, "ев").otherwise("son")))
        .otherwise(digits)
    )


def _rotated(name: Column, key: str) -> Column:
    """Another given name of the same gender and script: a keyed rotation of the list, so no two become the same."""
    import hashlib

    out = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        shift = int(hashlib.sha256(f"{key}|{script}|{gender}".encode()).hexdigest(), 16) % (len(names) - 1) + 1
        table = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, names[(i + shift) % len(names)])])
        out = F.coalesce(out, table[name])
    return out


def _name_parts(entity: Column) -> Column:
    """The words of a name in order: (word, kind); titles have the kind `title`, listed given names `given`."""
    words = F.split(entity, " ")
    title = r"^(?:" + _TITLE + r")\.?$"
    gender = (
        F.when(F.element_at(words, 1).rlike(r"^(?:" + "|".join(FEMALE_TITLES) + r")\.?$"), "female")
        .when(F.element_at(words, 1).rlike(r"^(?:" + "|".join(MALE_TITLES) + r")\.?$"), "male")
        .otherwise("family")
    )

    def kind(word: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        found = (
            F.when((i == 0) & word.rlike(title), "title").when(~last & word.rlike(f"^(?:{_GIVEN})$"), "given").when(last, "family").otherwise(gender)
        )
        return F.struct(word.alias("word"), found.alias("kind"))

    return F.transform(words, kind)


def atoms(x: Column) -> Column:
    """What of a described entity gets a surrogate of its own: the whole, or the invented parts of a name."""
    whole = F.array(F.struct(x["kind"].alias("kind"), x["text"].alias("text")))
    parts = F.transform(
        F.filter(_name_parts(x["entity"]), lambda p: ~p["kind"].isin("title", "given")),
        lambda p: F.struct(p["kind"].alias("kind"), F.lower(p["word"]).alias("text")),
    )
    return F.when(x["kind"] == "name", parts).otherwise(whole)


def _formatted(entity: Column, surrogate: Column, marks_too: Column) -> Column:
    """`surrogate` written the way `entity` is: its marks and upper case at the same places."""

    def put(state: Column, c: Column) -> Column:
        taken = F.substr(surrogate, state["at"], F.lit(1))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(taken)).otherwise(taken)
        own = marks_too | c.rlike(r"[\p{L}\d+]")
        return F.struct(
            F.concat(state["out"], F.when(own, cased).otherwise(c)).alias("out"), (state["at"] + F.when(own, 1).otherwise(0)).alias("at")
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(entity, ""), start, put, lambda s: s["out"])


def replacement(x: Column, key: str, attempts: Column | None = None) -> Column:
    """The surrogate of a described entity as it is written. attempts: a map from `kind:canonical` to the attempt to use."""
    none = F.lit(0)
    attempt = lambda kind, text: none if attempts is None else F.coalesce(attempts[F.concat_ws(":", kind, text)], none)

    def part(p: Column) -> Column:
        text = F.lower(p["word"])
        return (
            F.when(p["kind"] == "title", p["word"])
            .when(p["kind"] == "given", _rotated(p["word"], key))
            .otherwise(F.initcap(drawn(key, p["kind"], text, attempt(p["kind"], text))))
        )

    sur = drawn(key, x["kind"], x["text"], attempt(x["kind"], x["text"]))
    return (
        F.when(x["kind"] == "name", F.array_join(F.transform(_name_parts(x["entity"]), part), " "))
        .when(x["kind"] == "ip", sur)
        .otherwise(_formatted(x["entity"], sur, x["kind"] == "email"))
    )


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """kind, text, attempt of the atoms(kind, text) that can't keep their first surrogate.

    A surrogate is refused if another atom that was there before it, by spelling, has it, or if it is the spelling of an
    atom in the data. Refused ones draw again until none is left; each round's table holds only what was refused.
    """
    found = saved(entities.select("kind", "text").distinct().withColumn("attempt", F.lit(0)), "pii_atoms")
    settled = found.withColumn("sur", drawn(key, F.col("kind"), F.col("text"), F.col("attempt")))
    settled = saved(settled, "pii_drawn")
    real = found.select("kind", F.col("text").alias("sur"))
    while True:
        owner = settled.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "text")).alias("owner"), F.count("*").alias("n"))
        twice = settled.join(owner.where("n > 1"), ["kind", "sur"]).where(F.struct("attempt", "text") != F.col("owner"))
        refused = twice.select("kind", "text", "attempt").union(settled.join(real, ["kind", "sur"], "left_semi").select("kind", "text", "attempt"))
        refused = saved(refused.distinct().select("kind", "text", (F.col("attempt") + 1).alias("attempt")), "pii_refused")
        if refused.isEmpty():
            return settled.where("attempt > 0").select("kind", "text", "attempt")
        again = refused.withColumn("sur", drawn(key, F.col("kind"), F.col("text"), F.col("attempt")))
        settled = saved(settled.join(refused.select("kind", "text"), ["kind", "text"], "left_anti").unionByName(again), "pii_drawn")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities in `text` replaced, and `_kinds` more: the kinds of entities found, in their order.

    The whole text is searched. The same entity gets the same surrogate in all documents and ways of writing it, two
    entities never the same one, and no surrogate is an entity of the data. Who has the key can repeat the replacement;
    nobody can undo it without the data.

    A null text stays null; empty texts and texts without entities stay as they are. Each row is rewritten by its own
    text alone, so repeated rows are rewritten alike, whatever their doc_id, null included. Other columns stay as they
    are, but for a column named `_kinds`, which is replaced. An empty table gives no rows.
    """
    docs = docs.drop("_kinds")
    columns = docs.columns
    name = unused(docs, "pii_found")
    found = F.col(name)
    marked = docs.withColumn(name, described(entities(F.col("text"))))
    own = marked.select(F.explode(name).alias("x")).select(F.explode(atoms(F.col("x"))).alias("atom")).select("atom.kind", "atom.text")
    again = collisions(own, key)

    def rewritten(attempts: Column | None) -> Column:
        put = F.transform(found, lambda x: replacement(x, key, attempts))
        whole = F.array_join(F.zip_with(between(F.col("text")), put, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
        return F.when(F.size(found) > 0, whole).otherwise(F.col("text")).alias("text")

    def out(rows: DataFrame, attempts: Column | None) -> DataFrame:
        kinds = F.coalesce(F.transform(found, lambda x: x["kind"]), F.array().cast("array<string>"))
        return rows.select(*[rewritten(attempts) if c == "text" else F.col(c) for c in columns], kinds.alias("_kinds"))

    if again.isEmpty():
        return out(marked, None)
    # only documents that hold an entity with another attempt need its number
    spelt = F.transform(found, lambda x: F.transform(atoms(x), lambda a: F.concat_ws(":", a["kind"], a["text"])))
    key_name, text_name, map_name = (unused(docs, n) for n in ("pii_key", "pii_text", "pii_attempts"))
    place = marked.select(text_key(F.col("text")).alias(key_name), F.col("text").alias(text_name), F.explode(F.array_distinct(F.flatten(spelt))).alias("atom"))
    again = again.select(F.concat_ws(":", "kind", "text").alias("atom"), "attempt")
    needed = place.join(again, "atom").dropDuplicates([key_name, text_name, "atom"])
    needed = needed.groupBy(key_name, text_name).agg(F.map_from_entries(F.collect_list(F.struct("atom", "attempt"))).alias(map_name))
    needed = saved(needed, "pii_needed")
    joined = marked.join(needed, (text_key(F.col("text")) == F.col(key_name)) & (F.col("text") == F.col(text_name)), "left")
    return out(joined, F.coalesce(map_name, F.create_map().cast("map<string,int>")))
