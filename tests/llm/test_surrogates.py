import re
from collections import defaultdict

import pytest
from conftest_llm import odd_rows, prose
from pyspark.sql import functions as F

from flowwarden.llm import pii
from flowwarden.plans.ship import ship

KEY = "k1"
TEXT = (
    "Mail ann.lee@mail.example.com or ANN.LEE@mail.example.com, call +1 (743) 555-3824 or +1-743-555-3824, card 4539 1488 0343 6467 "
    "or 4539148803436467, host 10.20.30.40, id 123-45-6789, IBAN GB82 WEST 1234 5698 7654 32, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\". "
    "Mrs. Mary Smith met Mr. Smith and Mary Jones; Frau Müller, господин Иванов, Dr. Karen Smith-Jones!"
)


def entities(text):
    """The same kinds, found by other means: Python's expressions on the parts of this file's texts."""
    return re.findall(r"[\w.]+@[\w.]+\w|\d{1,3}(?:\.\d{1,3}){3}|\+1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}|\d{4}(?: ?\d{4}){3}|\d{3}-\d\d-\d{4}|[0-9a-f]{40}", text)


CLEAN = ["Version 1.2.3.4.5 of 2024-01-02", "a 12 digits 123456789012 long", "it is 3.14 or 1,000,000", "he@home", "May Day", "Drive on", "Herring Müller"]
SHARED = ["see bob.x@mail.example.org now", "bob.x@mail.example.org", "zoe.y@mail.example.org and 4539148803436467"]
MANY = [f"10.0.{i // 250}.{i % 250 + 1} and 555-010-{i:04d} and Mr. {prose(i, 1).title()}{'abcdefghij'[i % 10]}" for i in range(600)]
LONG = prose(1, 40_000) + " 10.1.2.3 " + prose(2, 10) + " 4539148803436467"


def replaced(spark, texts, key=KEY):
    """Rows by text; one run for all, as plans for many kinds of entities take a while to compile."""
    ship(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return {texts[r.doc_id]: r for r in pii.with_surrogates(docs, key).collect()}


@pytest.fixture(scope="module")
def found(spark):
    return replaced(spark, [TEXT, LONG, *CLEAN, *SHARED, *MANY])


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_kinds_and_formats(found):
    r = found[TEXT]
    assert r["_kinds"] == ["email", "email", "phone", "phone", "card", "card", "ip", "social", "iban", "secret"] + ["name"] * 6
    assert not set(entities(TEXT)) & set(entities(r.text))
    got, want = (re.sub(r"\w", "x", t) for t in (r.text.split(" IBAN")[0].split("host")[0], TEXT.split(" IBAN")[0].split("host")[0]))
    assert got == want  # marks and lengths stay
    mails, phones, cards = re.findall(r"[\w.]+@[\w.]+\w", r.text), re.findall(r"\+1[ (-]+\d{3}[) -]+\d{3}-\d{4}", r.text), re.findall(r"\d{4}(?: ?\d{4}){3}", r.text)
    assert mails[0].lower() == mails[1].lower() and mails[1].split("@")[0].isupper() and mails[0].endswith(".com")
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1])
    assert all(0 < int(o) < 255 for o in re.search(r"host ([\d.]+),", r.text)[1].split("."))
    iban = re.search(r"IBAN ([A-Z\d ]+),", r.text)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban.startswith("GB")


def test_names_keep_gender_script_and_family(found):
    text = found[TEXT].text
    m = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and (\w+) (\w+); Frau (\w+), господин (\w+), Dr\. (\w+) (\S+)!", text)
    mary, smith, smith2, mary2, jones, _, ivanov, karen, _ = m.groups()
    women = pii.GIVEN["latin", "female"]
    assert mary == mary2 and mary in women and mary != "Mary" and karen in women and karen != "Karen"
    assert smith == smith2 != jones and smith.istitle()
    assert re.fullmatch("[А-Яа-я]+", ivanov)


def test_same_entity_same_surrogate_everywhere_other_keys_others(spark, found):
    two = replaced(spark, SHARED, "k2")
    mail = lambda r: re.search(r"\S+@\S+", r.text)[0]
    one = [found[t] for t in SHARED]
    assert mail(one[0]) == mail(one[1]) != mail(one[2]) and mail(one[0]) != mail(two[SHARED[0]])
    assert mail(one[0]).split("@")[1] == mail(one[2]).split("@")[1]  # one domain, one surrogate


def test_distinct_entities_stay_distinct(found):
    image = defaultdict(set)
    for t in MANY:
        for a, b in zip(t.split(" and "), found[t].text.split(" and ")):
            image[a].add(b)
    assert all(len(x) == 1 for x in image.values())
    assert len({next(iter(x)) for x in image.values()}) == len(image)
    assert not set(image) & {next(iter(x)) for x in image.values()}


def test_clean_texts_stay_and_long_ones_are_read_to_the_end(found):
    assert all(found[t].text == t and found[t]["_kinds"] == [] for t in CLEAN)
    assert found[LONG]["_kinds"] == ["ip", "card"]


def test_collisions_are_drawn_again(spark, monkeypatch):
    real = pii.drawn

    def crowded(key, kind, text, attempt):
        few = F.concat(F.lit("10.0.0."), (F.pmod(F.xxhash64(text, attempt), F.lit(40)) + 1).cast("string"))
        return F.when(kind == "ip", few).otherwise(real(key, kind, text, attempt))

    monkeypatch.setattr(pii, "drawn", crowded)
    hosts = [f"10.0.0.{i}" for i in range(1, 9)] + [f"9.9.9.{i}" for i in range(1, 13)]
    texts = [f"x {h} y {h} z" for h in hosts]
    got = replaced(spark, texts)
    out = [got[t].text for t in texts]
    assert len(set(out)) == len(hosts)
    for h, t in zip(hosts, out):
        a, b = re.fullmatch(r"x (\S+) y (\S+) z", t).groups()
        assert a == b and a not in hosts


def test_odd_rows_and_clashing_columns(spark, frame):
    rows = odd_rows()
    got = pii.with_surrogates(frame(rows), KEY).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((d, t)) for d, t in rows)
    docs = spark.createDataFrame([(1, "at 10.1.2.3", "a", "b")], "doc_id int, text string, pii_key string, _kinds string")
    r = pii.with_surrogates(docs, KEY).first()
    assert r["_kinds"] == ["ip"] and r.pii_key == "a"
    assert pii.with_surrogates(docs.limit(0), KEY).count() == 0
