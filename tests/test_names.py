"""Names in texts against one regular expression per name."""

import random
import re

from pyspark.sql import functions as F

from riskfabric.operators import names, relational
from riskfabric.functions.text import phrase

CASED = ("Turkey", "Congo")


def plain(text, alias):
    letters = re.sub("[^A-Za-z]", "", alias)
    if len(letters) <= 3:
        return re.search(r"(?<![A-Za-z])" + r"\.?".join(letters) + r"\.?(?![A-Za-z])", text) is not None
    if alias in CASED:
        return re.search(r"(?<![A-Za-z])" + re.escape(alias) + r"(?![A-Za-z])", text) is not None
    return re.search(r"(?<![a-z])" + re.escape(alias.lower()) + r"(?![a-z])", text.lower()) is not None


def found(spark, texts, aliases):
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    gazetteer = names.spellings(spark.createDataFrame([(a, a) for a in aliases], "name string, alias string"), CASED)
    return {(r["id"], r["name"]) for r in names.mentions(table, gazetteer, "id", "text").collect()}


def test_spellings_and_bounds(spark):
    aliases = ["US", "U.S.A.", "United States", "Congo", "Turkey", "Åland Islands", "Côte d'Ivoire", "New York (state)", "York", "Iran", "'s-Hertogenbosch", "UK", "x", " Oman"]
    texts = ["US", "the u.s. and the U.S. port", "U.S.A", "U.SA.", "USAF", "UNITED STATES", "United  States", "united states' ports", "congo Congo", "turkey", "Turkey-based",
             "Åland islands", "Xåland Islands", "Côte d'Ivoire!", "new york (state)x", "new york (state) x", "New Yorker", "York", "Iranian", "Iran2", "9Iran", "'s-Hertogenbosch", "a's-hertogenbosch",
             " 's-hertogenbosch", "", "  ", "x", "x.", "éx", "in Oman", "Oman", "  oman", "line\nUnited States\nline", "a " * 30_000 + "iran"]
    assert found(spark, texts, aliases) == {(i, a) for i, t in enumerate(texts) for a in aliases if plain(t, a)}


def test_ten_thousand_names(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé.- ") for _ in range(rng.randint(1, 5)))
    aliases = sorted({" ".join(word() for _ in range(rng.randint(1, 3))).strip() for _ in range(12_000)})
    aliases = [a for a in aliases if re.search("[A-Za-z]", a)][:10_000]
    texts = [" ".join(rng.choice(aliases) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 12))) for _ in range(60)]
    assert found(spark, texts, aliases) == {(i, a) for i, t in enumerate(texts) for a in aliases if plain(t, a)}


def test_missing_texts_and_names(spark):
    gazetteer = names.spellings(spark.createDataFrame([("a", None), ("b", "日本"), ("c", "...")], "name string, alias string"))
    assert gazetteer.count() == 0
    texts = spark.createDataFrame([(1, None), (2, "日本 a b"), (2, "c")], "id int, text string")
    assert names.mentions(texts, gazetteer, "id", "text").count() == 0
    some = names.spellings(spark.createDataFrame([("c", "c")], "name string, alias string"))
    assert [tuple(r) for r in names.mentions(texts, some, "id", "text").collect()] == [(2, "c")]
    assert names.mentions(texts.limit(0), some, "id", "text").count() == 0


def test_longest_name_as_before(spark):
    countries = ["United States", "United Kingdom", "Iran", "Netherlands", "Niger", "Nigeria", "Turkey"]
    rows = [(1, "", "port of New York, U.S."), (2, "Nigeria", "Niger delta"), (3, "turkey", ""), (4, None, None), (5, "Iranian", "British coast"), (6, "Dutch", "UK"), (6, "Dutch", "UK")]
    signals = spark.createDataFrame(rows, "id int, country string, location string")
    was = relational.locate_signals(signals, countries)
    now = names.locate(signals, phrase(F.col("country"), F.col("location")), names.spellings(names.country_names(spark, countries)), "matched_country")
    assert sorted(map(str, was.collect())) == sorted(map(str, now.select(was.columns).collect()))


def test_windows_open_only_at_first_words_of_names(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The grey harbour of New Port, U.S. side"), (2, "new ports"), (3, None), (4, "harbour news; new port")], "id long, text string")
    found = names.spellings(spark.createDataFrame([("port", "new port"), ("grey", "grey harbour")], "name string, alias string")).cache()
    opened, plain = [], names._windows
    monkeypatch.setattr(names, "_windows", lambda *a: opened.append(a[4]) or plain(*a))
    want = {(1, "grey"), (1, "port"), (4, "port")}
    assert {tuple(r) for r in names.mentions(texts, found, "id", "text").collect()} == want
    assert [sorted(x) for x in opened] == [["grey", "new"]]  # one pass, no window at other words
    monkeypatch.setattr(names, "FIRST_WORDS", 1)
    assert {tuple(r) for r in names.mentions(texts, found, "id", "text").collect()} == want and opened[1:] == [None, None]
    assert names.mentions(texts, found.where("false"), "id", "text").count() == 0
