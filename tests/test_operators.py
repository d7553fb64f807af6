from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake import api
from notelake.functions.embed import HashingEmbedder
from notelake.operators import catalog, chunk, index, lexical, papers, rag, search
from notelake.sources import html, kv, literature, notes, shards


def test_chunks_carry_headings_and_skip_code():
    body = "intro text.\n# One\nfirst. second!\n### Deep\ndeep text.\n```py\ncode = 1\n```\n# Two\nlast."
    got = list(chunk.chunks("N", body, ["t"], chunk.Options(max_tokens=100)))
    assert [(g[3], g[4]) for g in got] == [(0, "N"), (1, "One"), (3, "Deep"), (1, "Two")]
    assert got[2][5] == ["N", "One", "Deep"] and got[3][5] == ["N", "Two"]
    assert got[0][7].startswith("N/N:\ntags: t\n")
    assert "code" not in "".join(g[6] for g in got)
    with_code = list(chunk.chunks("N", body, [], chunk.Options(max_tokens=100, include_code=True)))
    assert any(g[4] == "py code block" for g in with_code)
    assert list(chunk.chunks("N", "  \r\n ", [], chunk.Options())) == []


def test_fences_end_at_line_ends():
    body = "# A\n```one line```\ntext.\n```py\ns = '```' + 1\n```\nlast."
    got = list(chunk.chunks("N", body, [], chunk.Options(include_code=True)))
    texts = ["```one line```\n", "text.\n\n", "```py\ns = '```' + 1\n```\n", "last.\n"]
    assert [g[6] for g in got] == texts and [g[4] for g in got] == ["one line code block"] * 2 + ["py code block"] * 2
    assert [g[0] for g in got] == [2, 3, 4, 7]
    assert not any("```" in g[6] for g in chunk.chunks("N", body, [], chunk.Options()))


def test_lines_after_a_cut_segment_may_still_fit():
    parts = [(0, "x" * 100 + ". "), (102, "a. ")]
    assert len(chunk.pack(parts, 20)) == 1 and chunk.pack(parts, 20)[0][1].endswith(" [truncated]a. ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .", min_size=1, max_size=60), max_size=12), st.integers(8, 20))
def test_packing_keeps_the_budget(parts, most):
    packed = chunk.pack([(i, p) for i, p in enumerate(parts)], most)
    assert all(sum(chunk.estimate(s) for s in [t]) <= most + 4 for _, t in packed)
    rows = chunk.split_by_tokens(parts, most)
    assert sum(len(x) for r in rows for x in r) == sum(map(len, parts)) or any(" " in p for p in parts)
    assert all(chunk.estimate(p) <= most for r in rows for p in r)


def test_jvm_and_python_packing_agree(spark):
    segments = ["a b c. ", "# head. ", "d e f g h i j k. ", "l. ", "m n o p q r s t u v w x y z " * 4]
    got = spark.range(1).select(chunk.pack_sentences(F.array(*map(F.lit, segments)), 12).alias("p")).first()["p"]
    assert got == [t for _, t in chunk.pack([(0, s) for s in segments if not s.startswith("#")], 12)]


def test_search_ties_limits_and_groups(spark):
    rows = [(1, 1, 200, [1.0, 0.0]), (1, 2, 200, [1.0, 0.0]), (2, 1, 50, [1.0, 0.0]), (3, 1, 200, [0.0, 1.0]), (4, 1, 200, [0.0, 0.0])]
    b = spark.createDataFrame(rows, "note_id long, line long, length int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "query_id long, q array<double>")
    scored = search.score(b, q)
    found = search.hits(scored.where("query_id = 0"), min_similarity=0.5, min_length=100)
    assert [(r.note_id, r.line) for r in search.top_k(found, 5).collect()] == [(1, 1), (1, 2)]
    best = {(r.note_id, r.line): round(r.similarity, 3) for r in search.maxsim(scored, floor=True).collect()}
    assert best == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (3, 1): 0.707, (4, 1): 0.0}
    got = search.matmul_top_k(b, q, 2).orderBy("query_id", F.desc("similarity"), "note_id", "line").collect()
    assert [(r.query_id, r.note_id, r.line) for r in got] == [(0, 1, 1), (0, 1, 2), (1, 1, 1), (1, 1, 2)]
    assert search.group_by_note(scored, method="nonsense").count() == 4
    assert search.candidate_limit(10) == 1536 and search.candidate_limit(200, mobile=True) == 800
    empty = search.precision_recall(search.ranked(scored.limit(0)), search.ranked(scored.limit(0))).first()
    assert empty.precision == empty.recall == 1.0


def test_rrf_is_at_least_each_part(spark):
    s = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "note_id long, line long, position int")
    k = spark.createDataFrame([(2, 1, 0), (3, 1, 1)], "note_id long, line long, position int")
    got = {r.note_id: r.score for r in lexical.rrf(s, k).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.5 + 0.3, 3: 0.15})
    pool = s.withColumn("similarity", F.lit(0.5))
    assert [r.place for r in lexical.rerank(pool, [], max_hits=1).orderBy("note_id").collect()] == [0, 1]


def test_chat_parsing():
    text = "hello\nUser: a\n---\nAssistant: b\n===\nUser: not me\n===\nUser:\nc"
    assert rag.parse_chat(text, system=["s"]) == [("system", "s"), ("assistant", "hello"), ("user", "a"), ("assistant", "b\n===\nUser: not me\n==="), ("user", "c")]


def test_exclusions_and_diff(spark):
    n = spark.createDataFrame([(1, "a", True, 0), (2, "f", False, 0), (3, "a", False, 0), (4, "a", None, 5), (5, "", False, 0)], "note_id long, folder_id string, is_conflict boolean, deleted_time long")
    got = index.exclusion_reason(n, spark.createDataFrame([(3,), (1,)], "note_id long"), spark.createDataFrame([("f",), ("",)], "folder_id string"), check_deleted=True)
    assert {r.note_id: r.reason for r in got.collect()} == {1: "conflict", 2: "folder", 3: "tag", 4: "deleted", 5: None}
    assert {r.note_id for r in index.candidates(got, 2).collect()} == {2, 5}
    s = spark.createDataFrame([(1, "h", "h", "s", "1", True, False), (2, "h", None, None, None, False, True), (3, "x", "x", "s", "1", True, False)], "note_id long, hash string, meta_hash string, settings string, model_version string, shard_ok boolean, legacy boolean")
    c = spark.createDataFrame([(1, "h", "s", "2", None), (2, "h", "s", "2", None), (3, "y", "s", "2", None)], "note_id long, hash string, settings string, model_version string, reason string")
    assert {r.note_id: r.status for r in index.diff_status(s, c).collect()} == {1: "unchanged", 2: "backfill", 3: "rebuild"}
    assert {r.note_id: r.status for r in index.diff_status(s, c, force=True).collect()} == {1: "rebuild", 2: "backfill", 3: "rebuild"}


def test_sweep_choice():
    now = datetime(2024, 1, 2)
    assert index.choose_sweep(now, None, None, timedelta(0)) == "none"
    assert index.choose_sweep(now, None, None, timedelta(minutes=10)) == "full"


def test_shards_hide_unfinished_writes(spark, tmp_path):
    b = spark.createDataFrame([("n", i, "t", 0, 0, 5, ["t"], [0.1 * i, -1.0]) for i in range(4)], "note_id string, line int, title string, level int, body_idx int, length int, path array<string>, embedding array<double>")
    at = str(tmp_path)
    for epoch in (1, 2):
        made = shards.build(b, "m", epoch)
        made.write.mode("append").partitionBy("model_id").parquet(f"{at}/emb")
        if epoch == 1:
            made.select("note_id", "model_id", "epoch").write.mode("append").partitionBy("model_id").parquet(f"{at}/meta")
    rows = shards.read(spark, f"{at}/emb", f"{at}/meta", model_id="m").orderBy("row").collect()
    assert [r.q8 for r in rows] == [[0, -127], [13, -127], [25, -127], [38, -127]] and rows[0].title == "t"
    assert rows[0].meta.headingPath is None
    assert shards.read(spark, f"{at}/emb", f"{at}/meta", model_id="m", max_rows=2).count() == 2
    broken = spark.createDataFrame([("n", "m", 0, 1, None, "", None)], made.select("note_id", "model_id", "shard_no", "epoch", "vectors_b64", "scales_b64", "meta").schema)
    assert shards.decode(broken).count() == 0


def test_kv_and_migration(spark):
    s = spark.createDataFrame([(1, "meta", '{"models":{"m":{"dim":3}}}'), (2, "meta", "oops"), (3, "x", "{}")], "note_id long, key string, value string")
    assert [r.note_id for r in kv.note_meta(s).collect()] == [1]
    assert kv.get(s, "absent", "map<string,string>").count() == 0
    assert "max_block_size" in catalog.migrate_legacy(spark.createDataFrame([("m",)], "model_name string")).columns
    assert s.select(kv.tolerant_map(F.lit("nope")).alias("m")).first().m == {}


def test_html():
    page = "<html><head><style>p{}</style></head><body><nav>menu</nav><h1>Top</h1><p>a <a href='u'>l</a> &amp; b</p><table><tr><td>1</td><td>2</td></tr></table><script>x</script></body></html>"
    assert html.to_text(page) == "# Top\n\na l (u) & b\n\n```\n1\t2\n```"
    assert html.to_text(None) == ""
    rich = "<ol><li>one</li><li>two <em>it</em></li></ol><pre><code>a  = 1\n\n  b</code></pre><p><strong>x</strong> <b>y</b> <em>open"
    assert html.to_text(rich) == "1. one\n2. two _it_\n\n```\na  = 1\n\n  b\n```\n\n**x** y open"
    assert html.to_text("<table><tr><td>1") == "```\n1\n```" and html.to_text("</table></pre></em>x") == "x"
    assert html.to_text("<table><tr><td>1<table><tr><td>2</td></tr></table></td></tr></table>z").count("```") == 2


def test_literature():
    xml = "<article><body><sec><title>T</title><p>a <xref>1</xref>b</p><fig><p>no</p></fig></sec></body></article>"
    assert literature.parse_fulltext(xml) == "T\n\na b" and literature.parse_fulltext("<") == ""
    assert literature.parse_pubmed("bad") == []


def test_citations_and_index_answers(spark):
    answers = spark.createDataFrame([('{"search-results":{"entry":[{"dc:title":"t","prism:coverDate":"2020-01-02","citedby-count":"7"}]}}',)], "json string")
    r = literature.from_index(answers).first()
    assert (r.title, r.year, r.citation_count, r.text_source) == ("t", 2020, 7, "unknown")
    pages = spark.createDataFrame([('{"query":{"pages":{"1":{"pageid":1,"title":"T","extract":"x"}}}}',)], "json string")
    assert literature.from_encyclopedia(pages).first().text == "x"


def test_prompt_library(spark, tmp_path):
    (tmp_path / "p.csv").write_text('label,value\na,"x\ny"\nb,"say ""hi"""\n')
    assert literature.prompt_library(spark, str(tmp_path / "p.csv")) == {"a": "x\ny", "b": 'say "hi"'}


def test_papers_pin_best(spark):
    p = spark.createDataFrame([(1, 0.1, 100, False), (2, 0.9, 0, False), (3, 0.0, 0, True), (4, 0.8, 50, False)], "paper_id long, relevance_score double, citation_count int, full_text_available boolean")
    assert [r.paper_id for r in papers.prioritize(p).orderBy("place").limit(3).collect()] == [2, 1, 3]
    assert papers.prioritize(p, pin_best=False).orderBy("place").first().paper_id == 4


def test_notes(spark):
    n = spark.createDataFrame([(1, "b"), (2, "c")], "note_id long, body string")
    r = spark.createDataFrame([(1, "r2", "two"), (1, "r1", "one"), (2, "r3", " ")], "note_id long, resource_id string, ocr_text string")
    assert {x.note_id: x.body for x in notes.append_recognised(n, r).collect()} == {1: "b\n\none\n\ntwo", 2: "c"}


def test_api(spark):
    e = HashingEmbedder(16)
    texts = ["red apple pie", "green apple tart", "car engine"]
    b = spark.createDataFrame([(i, 1, 200, v) for i, v in enumerate(e.embed(texts))], "note_id long, line long, length int, embedding array<double>")
    idx = api.NoteIndex(b, b.select("note_id"), "hash", e)
    assert idx.status()["indexStats"] == {"noteCount": 3, "blockCount": 3}
    assert idx.search("red apple pie", min_similarity=0.1).first().note_id == 0
    assert 0 not in {r.note_id for r in idx.search(note_id=0, min_similarity=0.0).collect()}
    assert idx.search("red apple pie", note_id=99, min_similarity=0.1).first().note_id == 0
    for bad in ({}, {"query": "x", "limit": 0}):
        with pytest.raises(api.SearchError) as err:
            idx.search(**bad)
        assert err.value.code == "invalid_input"
    with pytest.raises(api.SearchError) as err:
        api.NoteIndex(b, b, "m", e, ready=False).search("x")
    assert err.value.code == "not_ready"


def test_api_search_cuts_no_blocks(spark):
    blocks = spark.range(12_000).select((F.col("id") % 3).alias("note_id"), F.col("id").alias("line"), F.lit(200).alias("length"), F.array(F.lit(1.0), (F.col("id") % 3 * 100_000 + F.col("id")) / 1e7).alias("embedding"))
    notes = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "c", "y y")], "note_id long, title string, body string")
    for n in (notes.select("note_id"), notes):
        got = api.NoteIndex(blocks, n, "m", HashingEmbedder(2)).search(note_id=0, limit=5).collect()
        assert [(r.note_id, len(r.blocks)) for r in got] == [(1, 4000), (2, 4000)]


def test_leads_are_those_of_rerank(spark):
    pool = spark.range(400).select((F.col("id") % 7).alias("note_id"), F.col("id").alias("line"), (F.col("id") * 37 % 101 / 101).alias("similarity"))
    hits = spark.createDataFrame([(5, 1), (9, 2), (2, 3), (0, 4)], "note_id long, rank int")
    ranked = search.ranked(pool).withColumn("position", F.col("rank") - 1).drop("rank")
    for k in (1, 10, 60):
        old = lexical.rerank(ranked, [hits], max_hits=k).where(F.col("place") < k).select("note_id", "line", "place")
        new = lexical.leads(pool, hits, max_hits=k)
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_retrieval_plan(spark):
    from notelake.operators.retrieve import Retrieval, chat_context, retrieve

    rows = [(n, line, 200, "T", f"h{line}", f"text {n}.{line}", [1.0, 0.1 * n * line]) for n in (1, 2, 3) for line in (1, 2, 3)]
    b = spark.createDataFrame(rows, "note_id long, line long, length int, title string, heading string, text string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<double>")
    hits = [spark.createDataFrame([(3, 1)], "note_id long, rank int")]
    got = retrieve(b, q, hits=hits, options=Retrieval(max_hits=2, after=1)).orderBy("rank", "note_id", "line").collect()
    assert {(r.note_id, r.line) for r in got} == {(1, 1), (1, 2), (1, 3)} and (got[0].note_id, got[0].line) == (1, 1)
    heavy = retrieve(b, q, hits=hits, options=Retrieval(max_hits=2, keyword_weight=0.9)).collect()
    assert {(r.note_id, r.line) for r in heavy} == {(1, 1), (3, 1)}
    scoped = retrieve(b, q, options=Retrieval(scope=(2,)))
    assert {r.note_id for r in scoped.collect()} == {2}
    made = chat_context(scoped).first()
    assert made.context.startswith("# note 1: T ::: h1\ntext 2.1") and len(made.citations) == 3


def test_any_number_of_query_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    b = spark.createDataFrame([(i // 4, i, 200, x[i].tolist()) for i in range(60)] + [(99, 99, 200, [1.0]), (99, 100, 200, None), (99, 101, 200, [0.0] * 8)], "note_id long, line long, length int, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(10)], "query_id long, q array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit[:10].T).max(axis=1)
    for most in (4096, 3):  # in one pass, in four
        monkeypatch.setattr(search, "QUERY_BLOCK", most)
        got = {r.line: r.similarity for r in search.best_scores(b, q).collect()}
        assert [got[i] for i in range(60)] == pytest.approx(want.tolist()) and got[99] == got[100] == got[101] == 0
        top = search.matmul_top_k(b, q, 3)
        assert top.count() == 30 and top.where("similarity > 0.999999").count() == 10
        bytes_ = search.matmul_top_k(search.quantised(b), q, 3)
        assert bytes_.count() == 30 and bytes_.where("similarity > 0.999").count() == 10
    assert search.best_scores(b, q.limit(0)).where("similarity is not null").count() == 0


def test_a_retried_shard_write_shows_once(spark, tmp_path):
    b = spark.createDataFrame([("n", i, 0, 10, 0, "t", ["t"], [1.0, float(i)]) for i in range(3)], "note_id string, line int, body_idx int, length int, level int, title string, path array<string>, embedding array<double>")
    made = shards.build(b, "m", 1)
    for _ in range(2):
        shards.put(made, made.select("note_id", "model_id", "epoch"), f"file://{tmp_path}/emb", f"file://{tmp_path}/meta")
    assert shards.read(spark, f"file://{tmp_path}/emb", f"file://{tmp_path}/meta", model_id="m").count() == 3


def test_split_rows_and_replace_last(spark):
    from notelake.functions import text as T

    df = spark.createDataFrame([(1, ["a b c d " * 40, "x"]), (2, None), (3, [])], "id int, parts array<string>")
    got = {r.id: r.rows for r in chunk.split_rows(df, "parts", 16).collect()}
    assert len(got[1]) > 2 and got[2] == got[3] == [[]]
    t = spark.createDataFrame([("a.b.a",), ("none",), (None,), ("aa",)], "t string")
    assert [r[0] for r in t.select(T.replace_last("t", "a", "Z")).collect()] == ["a.b.Z", "none", None, "aZ"]
    e = spark.createDataFrame([("a &#39;b&#x3C; &#38;lt; &#9; &eacute;",)], "t string")
    assert e.select(T.clean_inline("t")).first()[0] == "a 'b< &lt; &#9; &eacute;"
