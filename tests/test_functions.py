from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from notelake.functions import embed as E
from notelake.functions import text as T
from notelake.functions import vector as V


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_quantise_rounds_half_up_and_clamps(spark):
    assert one(spark, V.q8_values("v"), v=[127.0, -2.5, 2.5, 0.0]) == [127, -2, 3, 0]
    assert one(spark, V.q8_scale("v"), v=[0.0, 0.0]) == 1.0
    assert one(spark, V.q8_values("v"), v=[float("nan"), 1.0, float("inf")]) == [0, 1, 0]


def test_cosine_guards(spark):
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[1.0]) == 0.0
    assert one(spark, V.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, V.cosine("a", "b"), a=[1.0, 1.0], b=[2.0, 2.0]) == pytest.approx(1.0)
    with pytest.raises(Exception, match="differ in size"):
        one(spark, V.q8_cosine("a", "b"), a=[1, 2], b=[1])


def test_normalise_and_sanitise(spark):
    assert one(spark, V.l2_normalize("v"), v=[0.0, 0.0]) == [0.0, 0.0]
    assert math.isclose(sum(x * x for x in one(spark, V.l2_normalize("v"), v=[3.0, 4.0])), 1.0)
    assert one(spark, V.sanitize("v"), v=[float("nan"), 2.0]) == [0.0, 2.0]
    with pytest.raises(Exception, match="too many invalid"):
        one(spark, V.sanitize("v"), v=[float("nan"), float("inf"), 2.0])


def test_texts(spark):
    assert one(spark, T.normalize_newlines("t"), t="a\r\nb\rc\n") == "a\nb\nc\n"
    assert one(spark, T.slug("t"), t="  Hello, World -- 2! ") == "hello-world-2"
    assert one(spark, T.strip_query_operators("t"), t="tag:x hello notebook:y world") == "hello  world"
    assert one(spark, T.matches_keywords("t", 'café "big dog" run*'), t="A Big Dog was running to the café") is True
    assert one(spark, T.matches_keywords("t", "caf"), t="café") is True  # word edges are ASCII
    assert one(spark, T.matches_keywords("t", "a.c"), t="abc") is False
    assert one(spark, T.strip_generated("t", [("<s>", "</s>")]), t="a<s>x\ny</s>b<s>z</s>") == "ab"
    assert one(spark, T.token_estimate("t"), t="") == 0
    assert one(spark, T.token_estimate("t"), t="abcd" * 4) == 4
    assert one(spark, T.line_number(F.col("t"), F.lit("c")), t="a\nb\nc") == 3
    assert one(spark, T.line_number(F.col("t"), F.lit("z")), t="a") == 0
    assert one(spark, T.search_term("t", 9), t=" aa  bbb cccc d") == "aa bbb"
    assert one(spark, T.clean_inline("t"), t="a &lt;b&gt; <i>c</i>\n d") == "a <b> c d"
    assert one(spark, T.model_name("t"), t="text-model-2024-01-02") == "text-model"
    assert one(spark, T.format_bytes("n"), n=1536) == "≈1.5 KB"
    assert one(spark, T.prompt(F.lit("a"), F.lit(" "), F.lit("b"))) == "a\n\nb"
    assert len(one(spark, T.truncate_tokens("t", 10), t="word " * 100)) < 60


def test_decoration(spark):
    made = T.decoration(F.lit("T"), F.array(F.lit("A")), F.lit("H"), F.array(F.lit("x"), F.lit("y")))
    assert one(spark, made) == "T/A/H:\ntags: x, y\n"
    assert one(spark, T.decoration(F.lit("T"), F.array(), F.lit("H"), F.array(), embed_title=False, embed_path=False, embed_heading=False)) == ""


def test_adapters_retries_and_rates():
    adapters = {"e5": E.Conditioning("query: ", "passage: "), "bge-m3": E.Conditioning()}
    assert E.resolve_adapter("hub/bge-m3", adapters) == adapters["bge-m3"]
    assert E.resolve_adapter("e5-large", adapters).apply("x", "query") == "query: x"
    assert E.resolve_adapter("other", adapters).apply("x", "query") == "Query: x"
    assert E.model_version("1", title=False, tags=False) == "1nt"
    tried, slept = [], []

    def call():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("busy")
        return ["ok"]

    assert E.with_retries(call, sleep=slept.append) == ["ok"] and slept == [0.2, 0.4]
    now = [0.0]
    bucket = E.TokenBucket(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        bucket.take()
    assert now[0] == pytest.approx(2.0)


class Broken:
    def embed(self, texts, kind):
        raise ValueError("no model")


def test_embed_keeps_failed_rows(spark):
    df = spark.createDataFrame([("a b",), ("",)], "decorated string")
    good = E.embed(df, E.HashingEmbedder(8)).collect()
    assert [len(r["embedding"]) for r in good] == [8, 8] and all(r["error"] is None for r in good)
    bad = E.embed(df, Broken()).collect()
    assert [r["embedding"] for r in bad] == [None, None] and bad[0]["error"] == "no model"
