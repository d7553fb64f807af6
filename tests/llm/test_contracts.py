from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notelake.llm import quality_forest
from notelake.llm.queries import ORACLE, QUERIES
from notelake.storage import materialize, table
from tests.compare import SF, connect, same
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLE[name], connect())


def test_join_query_equals_brute_force(spark):
    data = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = {i: (len(brute.shingles(t)), c if brute.shingles(t) else i, k) for (i, t), (c, k) in zip(data, brute.components(data), strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in QUERIES["op5_ngram_jaccard_join"](spark, SF).collect()}
    assert got == want


def test_quality_query(spark):
    got = {r.doc_id: r for r in QUERIES["op4_quality_forest"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        n, chars, symbols, dup, repeat = brute.rule_statistics(r.text)
        q = got[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (n, chars, symbols, dup, repeat)
        failed = n < 50 or 100 * repeat > 50 * n
        assert q.base_failed == failed and not (failed and q.kept)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = table(spark, sf, "documents").select("doc_id", "lang").join(QUERIES["op7_language_id"](spark, sf).where("held_out"), "doc_id")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    tox = table(spark, sf, "labels").join(QUERIES["op9_toxicity"](spark, sf).where("held_out"), "doc_id")
    seen = {(r.toxic, r.predicted): r["count"] for r in tox.groupBy("toxic", "predicted").count().collect()}
    assert seen.get((0, 1), 0) <= 2 and seen[1, 1] > 2 * seen.get((1, 0), 0)


def test_forest_on_labels_that_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    stats = materialize(quality_forest.rule_statistics(table(spark, sf, "documents")), "t").where("doc_id is not null")
    labels = table(spark, sf, "labels")
    forest = quality_forest.fit(stats, labels.where("doc_id % 2 = 0"))
    unseen = quality_forest.verdicts(stats, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    seen = {(r.quality, r.kept): r["count"] for r in unseen.groupBy("quality", "kept").count().collect()}
    assert seen[0, False] > 0.9 * (seen[0, False] + seen.get((0, True), 0))
    assert seen[1, True] > 0.97 * (seen[1, True] + seen.get((1, False), 0))


def test_pipeline_equals_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    kept = materialize(stages["quality rules"](spark, docs, SF), "t")
    ids = {r.doc_id for r in kept.collect()}
    stats = {r.doc_id: brute.rule_statistics(r.text) for r in docs.collect()}
    assert all(s[0] >= 50 and 100 * s[4] <= 50 * s[0] for i, s in stats.items() if i in ids)
    good = [r.doc_id for r in labels.collect() if r.quality == 1 and stats[r.doc_id][0] >= 50 and 100 * stats[r.doc_id][4] <= 50 * stats[r.doc_id][0]]
    assert sum(i in ids for i in good) >= 0.97 * len(good)

    once = materialize(stages["n-gram Jaccard join"](spark, kept, SF), "t")
    data = [(r.doc_id, r.text) for r in kept.collect()]
    want = {c if brute.shingles(t) else i for (i, t), (c, _) in zip(data, brute.components(data), strict=True)}
    assert {r.doc_id for r in once.collect()} == want and once.columns == docs.columns

    clean = materialize(stages["benchmark decontamination"](spark, once, SF), "t")
    items = [brute.shingles(r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r.doc_id for r in once.collect() if any(s and 100 * len(s & brute.shingles(r.text)) >= 75 * len(s) for s in items)}
    assert {r.doc_id for r in clean.collect()} == want - bad

    masked = materialize(stages["secret scans"](spark, clean, SF), "t")
    assert masked.count() == clean.count() and masked.where(r"text rlike 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}'").count() == 0
    mixed = stages["mixing sources"](spark, masked, SF)
    assert mixed.count() == masked.count() and mixed.where("taken > 2 * size").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want - bad


def test_pipeline_on_odd_tables(spark, odd, empty, vocabulary, tmp_path):
    import random

    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    item, copied = text(20), text(90)
    more = [(100, copied, "en", "a", 1, 0.0, 1, "r"), (None, copied, "en", "a", 1, 0.0, 1, "r"), (None, text(60), None, None, None, None, None, None), (101, text(40) + " " + item + " " + text(40), "en", "b", 1, 0.0, 1, "r"), (102, text(60) + " db_pass = 'x7Gh2kLq9PzR'", "en", None, 1, 0.0, 1, "r")]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    labels = spark.createDataFrame([(100, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    for name, tables in {"some": (docs, labels, bench), "none": (empty, labels.limit(0), bench.limit(0)), "plain": (docs, labels.limit(0), bench.limit(0))}.items():
        for table_name, df in zip(("documents", "labels", "benchmark"), tables, strict=True):
            df.write.parquet(f"file://{tmp_path}/{name}/{table_name}.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        ids = [r.doc_id for r in got]
        if name == "none":
            assert ids == []
            continue
        assert ids.count(100) == 1 and ids.count(None) == 1 and (101 in ids) == (name == "plain") and ids.count(102) == 1
        assert not {5, 6, 7, 8, 9, 10} & set(ids) and ids.count(11) == 1 and ids.count(0) == 1 and 1 not in ids
        assert all(0 <= r.taken <= 2 * r.size for r in got)
