import hashlib
import math
import random

from pyspark.sql import functions as F

from riskfabric.llm import chat, mixing, queries
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, formatted string, whole int"


def test_escape_is_reversible_and_hides_control(spark):
    rnd = random.Random(1)
    pieces = [*chat.CONTROL, "\\", "\\\\", "<", "[", "<|", "|>", "a", "\n", "é", "<\\", "[\\", "INST]", "\\<s>"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def test_every_assistant_turn_is_an_example(spark):
    talk = spark.createDataFrame([(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "a</s>", "x", 1), (1, 2, "user", None, "x", 1), (1, 3, "assistant", "b", "x", 1), (1, 4, "user", "end", "x", 1),
                                  (2, 0, "user", "alone", "x", 1), (None, None, None, None, "x", 1), (3, 5, "assistant", "", "x", 1), (3, 5, "assistant", "", "x", 1)], TALK)
    rows = chat.prefix_examples(talk)
    got = {(r.conv_id, r.position): r for r in rows.withColumn("loss", chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert set(got) == {(1, 1), (1, 3), (1, 4), (2, 0), (None, 0), (3, 0), (3, 1)}
    assert [got[1, p].loss for p in (1, 3, 4)] == ["a</s>", "b", ""]
    assert [tuple(t) for t in got[1, 3].turns] == [("user", "hi"), ("assistant", "a</s>"), ("user", ""), ("assistant", "b")]
    assert got[1, 4].whole and not got[1, 4].trainable and not got[1, 3].whole
    assert [tuple(t) for t in got[None, 0].turns] == [("", "")]
    assert chat.prefix_examples(talk, tail=False).where("conv_id = 2").count() == 0
    assert chat.prefix_examples(talk.limit(0)).count() == 0


def test_op1_equals_sql_and_op5_equals_sql(spark):
    database = oracle.connect(FOLDER)
    for name in ("op1_chat_formatting", "op5_source_mixture"):
        ok, note = oracle.compare(spark, database, FOLDER, name, *queries.QUERIES[name])
        assert ok, note


def _count(seed, key, mean):
    parts, total = max(1, math.ceil(mean / 256)), 0
    for i in range(1, parts + 1):
        name = "=" + str(key) if key is not None else "~"
        u = (int(hashlib.md5(f"{seed}|{name}|={i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        m, k = mean / parts, 0
        term = below = math.exp(-m)
        while below < u:
            k += 1
            term *= m / k
            below += term
        total += k
    return total


def test_mixture_counts_shares_and_edges(spark):
    rows = [(i, f"t{i}", "big") for i in range(300)] + [(1000 + i, None, "small") for i in range(5)] + [(None, "x", None), (7, "t7", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    weights = {"big": 1.0, "small": 3.0, "absent": 9.0}
    got = mixing.mix(docs, weights, total=2000).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last")).collect()
    means = {"big": 500 / 301, "small": 1500 / 5}
    want = {(d, s): _count(17, d, means[s]) for d, _, s in rows if s}
    assert {(r.doc_id, r.source): r.n for r in got} == {k: n * (2 if k == (7, "big") else 1) for k, n in want.items() if n}
    assert all(r.last == want[r.doc_id, r.source] - 1 for r in got)
    shares = {r.source: r.n for r in mixing.mix(docs, weights, total=2000).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(shares["small"] - 1500) < 150 and abs(shares["big"] - 500) < 90
    assert mixing.mix(docs.limit(0), weights).count() == 0
    assert mixing.mix(docs).where("source IS NULL").count() == _count(17, None, source_mean(docs))


def source_mean(docs):
    return mixing.source_means(docs, None).where("_source IS NULL").first()["mean"]


def test_mixture_of_many_sources_is_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    few = sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect())) == few
