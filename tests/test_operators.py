"""Edge cases of the operators on small inline tables."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.chunking import articles, chunks
from tessera.operators import bm25, evaluation, fusion, grep, ingest, names, trees, vectors
from tessera.plans import search
from tessera.sources import envelopes, markdown, tables
from tessera.streaming import incremental


def one(df):
    return df.collect()[0]


def column(spark, c, value=None, schema="t string"):
    return one(spark.createDataFrame([(value,)], schema).select(c.alias("x")))["x"]


@pytest.mark.parametrize("text,want", [("AB c", ["ab", "ab"]), ("abc", ["abc", "ab", "bc"]), ("가", ["가"]), ("", ["_empty_"]), (None, ["_empty_"]), ("! a", ["_empty_"])])
def test_tokens(spark, text, want):
    assert column(spark, T.tokenize(F.col("t")), text) == want


def test_bm25_matches_the_formula_and_floors_negative_weights(spark):
    texts = {1: "aa bb aa", 2: "aa cc", 3: "aa dd", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = {k: [x for w in (t or "").split() for x in (w,)] * 2 if t else ["_empty_"] for k, t in texts.items()}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    want = {}
    for k, t in tokens.items():
        s = sum(idf[q] * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in ["aa", "aa", "bb", "bb"] if q in idf)
        if any(q in t for q in ("aa", "bb")):
            want[k] = s
    asked = spark.createDataFrame([(7, "aa bb zz")], "query_id long, query string")
    found = {r.doc_id: r.score for r in bm25.scores(asked, bm25.build(docs)).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    assert raw["aa"] < 0


def test_bm25_fills_up_with_documents_that_share_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(k, "aa" if k == 5 else f"zz{k} yy" if k < 9 else None) for k in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "aa"), (2, "qq"), (3, None)], "query_id int, query string")
    index = bm25.build(docs, path=str(tmp_path / "index"))
    found = bm25.search(asked, docs, 4, index=index).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in found if r.query_id == 1] == [5, 0, 1, 2] and [r.doc_id for r in found if r.query_id == 2] == [0, 1, 2, 3]
    assert [r.doc_id for r in found if r.query_id == 3] == [9, 10, 11, 0]  # nothing is like nothing
    some = bm25.search(asked, docs, 4, allowed=F.col("doc_id") % 4 == F.col("query_id"), index=bm25.load(spark, str(tmp_path / "index")))
    assert sorted((r.query_id, r.doc_id) for r in some.collect()) == [(1, 1), (1, 5), (1, 9), (2, 2), (2, 6), (2, 10), (3, 3), (3, 7), (3, 11)]


def test_an_index_is_kept_for_the_same_files_only(spark, tmp_path):
    rows = lambda t: spark.createDataFrame([(1, t), (2, "bb")], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    rows("aa")
    read = lambda: spark.read.parquet(str(tmp_path / "docs"))
    terms = lambda: {r.term for r in bm25.kept(read(), str(tmp_path / "kept")).terms.collect()}
    assert terms() == {"aa", "bb"} == terms() and len(list((tmp_path / "kept").iterdir())) == 1
    rows("cc")
    assert terms() == {"cc", "bb"} and len(list((tmp_path / "kept").iterdir())) == 2


def test_lists_are_cut_where_the_rows_are(spark):
    """The limit of a ranked list stands below the exchange."""
    rows = spark.createDataFrame([(1, 2, 0.5)], "query_id int, doc_id long, score double")
    plan = bm25.ranked(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_preferred_rows_give_way(spark):
    rows = spark.createDataFrame([(k, [float(k)], k % 2 == 0) for k in range(6)], "vec_id long, embedding array<float>, even boolean")
    asked = spark.createDataFrame([(1, [0.0], True), (2, [0.0], None), (3, [0.0], False)], "query_id int, qvec array<float>, want boolean")
    found = vectors.nearest(asked, rows.where("even or vec_id = 1"), 2, prefer=(F.col("even") == F.col("want")) | (F.col("want").isNull() & F.lit(None).cast("boolean"))).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(1, 0), (1, 2), (2, 0), (2, 1), (3, 1)]


def test_bm25_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bm25.search(spark.createDataFrame([(1, "aa")], "query_id long, query string"), docs, 3).count() == 0


def test_nearest_breaks_ties_by_key_and_skips_other_lengths(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, qvec array<float>")
    assert [(r.vec_id, r.rank) for r in vectors.nearest(asked, rows, 2).orderBy("rank").collect()] == [(1, 0), (3, 1)]


def test_nearest_takes_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    rows = spark.createDataFrame([(k, [float(k)]) for k in range(30)], "vec_id long, embedding array<float>")
    asked = rows.selectExpr("vec_id AS query_id", "embedding AS qvec")
    assert sorted((r.query_id, r.vec_id, r.rank) for r in vectors.nearest(asked, rows, 1).collect()) == [(k, k, 0) for k in range(30)]


def test_filter_gives_way_where_it_leaves_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, None)], "g int, t string")
    assert sorted((r.g, r.t) for r in vectors.unless_empty(rows, F.col("t") == "a", "g").collect() if r.t) == [(1, "a"), (2, "b")]
    assert vectors.unless_empty(rows, F.col("t") == "a", "g").where("g = 3").count() == 1


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id long, score double, rank int")


def test_reciprocal_ranks_and_ties(spark):
    a, b = hits(spark, [(1, 10, 0.0, 0), (1, 11, 0.0, 1)]), hits(spark, [(1, 11, 0.0, 0), (1, 12, 0.0, 1), (1, 13, 0.0, 0)])
    found = fusion.reciprocal_ranks(a, b, 3).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [11, 10, 13] and abs(found[0].score - (1 / 62 + 1 / 61)) < 1e-15


@pytest.mark.parametrize("order,want", [([2, 1], [21, 20, 22]), ([3, 3, 9, 0], [22, 20, 21]), (None, [20, 21, 22]), ([], [20, 21, 22])])
def test_permutations(spark, order, want):
    rows = hits(spark, [(1, 20, 0.5, 0), (1, 21, 0.4, 1), (1, 22, 0.3, 2), (1, 23, 0.2, 3)])
    orders = spark.createDataFrame([(1, order)], "query_id int, `order` array<int>")
    found = fusion.permuted(rows, orders, 3, 3).orderBy("rank").collect()
    assert [r.doc_id for r in found] == want and {r.doc_id: r.score for r in found}[20] == 0.5


def test_names_match_whole_or_with_a_blank(spark):
    rows = spark.createDataFrame([("민법", True), ("민법 시행령", True), ("난민법", False), ("민법전", False)], "n string, want boolean")
    assert rows.where(fusion.name_matches(F.col("n"), F.lit("x"), F.lit("민법")) != F.col("want")).count() == 0


def test_verdicts_without_hits(spark):
    rows = {r.query_id: (r.confidence, r.verdict) for r in fusion.verdicts(spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), hits(spark, [(1, 5, 2 / 61, 0), (2, 5, 1 / 61, 0)])).collect()}
    assert rows == {1: (0.994, "applies"), 2: (0.497, "ambiguous"), 3: (0.0, "does_not_apply")}


def test_override_takes_the_first_known_name(spark):
    mapping = F.create_map(F.lit("minbub"), F.lit("민법"))
    pick = lambda laws: column(spark, names.override(F.lit("형법"), F.array(*[F.lit(x) for x in laws]).cast("array<string>"), mapping))
    assert pick(["x", "minbub"]) == "민법" and pick(["x"]) == "형법" and pick(["민법"]) == "민법"


@pytest.mark.parametrize("query,mode,words", [("의료 OR 규제", "OR", ["의료", "규제"]), ("의료 | 규제", "OR", ["의료", "규제"]), ("의료 규제", "AND", ["의료", "규제"]), ("a;b", "AND", []), ("   ", "AND", [])])
def test_grep_queries(spark, query, mode, words):
    p = column(spark, grep.parse(F.col("t")), query)
    assert (p.mode, p.keywords) == (mode, words)


def test_grep_context_parts_groups(spark):
    text = "\n".join(["x", "HIT", "a", "b", "c", "d", "e", "hit"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    rows = grep.context(docs, F.array(F.lit("hit"))).collect()
    assert len(rows) == 1 and rows[0].excerpt == "1-x\n2:HIT\n3-a\n4-b\n--\n6-d\n7-e\n8:hit"


def test_second_ingest_adds_nothing(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "doc_id string, v int")
    none = new.limit(0)
    first = ingest.new_rows(new, none, "doc_id", F.col("v"))
    assert sorted((r.doc_id, r.v) for r in first.collect()) == [("a", 1), ("b", 3)]
    assert ingest.new_rows(new, first, "doc_id", F.col("v")).count() == 0
    assert tuple(one(ingest.ingest_counts(new, none, "doc_id"))) == (2, 1) and tuple(one(ingest.ingest_counts(new, first, "doc_id"))) == (0, 3)


def test_delta_touches_changed_groups_only(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "g string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "g string, v int")
    assert {r.g: r.change for r in ingest.changed_groups(old, new, "g", "v").collect()} == {"b": "changed", "c": "removed", "d": "added"}
    assert sorted((r.g, r.v) for r in ingest.refreshed(old, new, "g", "v").collect()) == [("a", 1), ("b", 2), ("d", 4)]
    path = str(tmp_path / "t")
    ingest.write_groups(old, path, "g")
    ingest.write_groups(new.where("g = 'b'"), path, "g")
    assert sorted((r.g, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([("g", 1, 6), ("g", 2, 5), ("g", 3, 1), ("h", 1, 10)], "g string, o int, n int")
    assert sorted((r.g, r.o) for r in trees.within_budget(rows, F.col("n"), 10, "g", "o").collect()) == [("g", 1), ("h", 1)]


def test_tree_outline_and_chart(spark):
    docs = spark.createDataFrame([("d", "# A\n## B\ntext\n# C"), ("e", None), ("f", "no heading")], "doc_id string, text string")
    nodes = trees.tree(docs)
    assert [r.node_id for r in trees.subtree(nodes, "d.law1").orderBy("preorder").collect()] == ["d.law1", "d.law1.chapter1"]
    assert one(trees.outline(nodes, 2)).outline == "[root] d :: d\n  [law] d.law1 :: A\n    [chapter] d.law1.chapter1 :: B\n  [law] d.law2 :: C"
    assert one(trees.text_tree(nodes, title=F.lit("All"))).tree == "All\n  [law] A\n    [chapter] B\n  [law] C"
    assert one(trees.mermaid(nodes)).chart.split("\n") == ["flowchart TD", '    d["d"]', '    d_law1["A"]', "    d --> d_law1", '    d_law1_chapter1["B"]', "    d_law1 --> d_law1_chapter1", '    d_law2["C"]', "    d --> d_law2"]
    assert [(r.node_id, r.parent_id) for r in trees.under_root(nodes, "all", "All").orderBy("preorder").collect()] == [("all", None), ("all.d", "all"), ("all.d.law1", "all.d"), ("all.d.law1.chapter1", "all.d.law1"), ("all.d.law2", "all.d")]
    assert tuple(one(trees.statistics(nodes))) == ("d", 3, 0, 2)


def test_circles_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(ValueError):
        trees.descendants(links, spark.createDataFrame([("a",)], "root string"), most=4)


def test_article_variants(spark):
    text = "---\nk: v\n---\n# 제1조\n\n# 제2조(가)\n본문"
    assert [a.number for a in column(spark, articles(F.col("t"), keep_empty=True), text)] == ["제1조", "제2조"]
    assert [(a.number, a.title, a.content) for a in column(spark, articles(F.col("t")), text)] == [("제2조", "(가)", "본문")]
    assert column(spark, articles(F.col("t"), whole_limit=None), "plain") == []
    assert column(spark, articles(F.col("t")), "plain")[0].number == "전문"
    none = spark.createDataFrame([("f", "k", "p", None)], "folder string, kind string, path string, text string")
    assert chunks(none, "now").count() == 0


def test_markdown_folders(spark, tmp_path):
    for folder, kind, text in (("가 나", "법률", "# 제1조\nx"), ("가 나", "시행령", "y"), ("b", "규칙", "z")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{kind}.md").write_text(text)
    files = markdown.read_folders(spark, str(tmp_path))
    assert sorted((r.folder, r.kind, r.text) for r in files.collect()) == [("b", "규칙", "z"), ("가 나", "법률", "# 제1조\nx"), ("가 나", "시행령", "y")]
    assert one(markdown.preferred(files, "가 나")).kind == "법률" and one(markdown.preferred(files, "b")).kind == "규칙" and markdown.preferred(files, "?").count() == 0


def test_frontmatter_and_details(spark):
    assert column(spark, T.frontmatter(F.col("t")), "---\na: 'x'\nb: y: z\na: 2\n---\nrest") == {"a": "2", "b": "y: z"}
    assert column(spark, T.frontmatter(F.col("t")), "none") == {}
    fields = {"n": "이름"}
    detail = lambda x: column(spark, envelopes.xml_detail(F.col("t"), fields), x)
    assert detail("<Prec><이름> 가 </이름></Prec>").n == "가" and detail("<Law>no such</Law>") is None and detail(None) is None
    assert column(spark, envelopes.xml_total(F.col("t")), "<r><totalCnt>12</totalCnt></r>") == 12 and column(spark, envelopes.xml_total(F.col("t")), "<r/>") == 0


def test_search_results_by_a_table_of_fields(spark):
    replies = spark.createDataFrame([('{"r":{"x":{"id":"1","t":"T","a":"","b":"B","d":"20260101","l":"/p"}}}',), ('{"r":{"x":[]}}',)], "payload string")
    target = envelopes.Target(("r", "x"), "id", "t", ("a", "b"), "d", "l")
    row = one(envelopes.search_results(replies, target, "https://site"))
    assert (row.id, row.title, row.subtitle, row.url) == ("1", "T", "B", "https://site/p")


@pytest.mark.parametrize("a,b,want", [("x", "x", True), ("x", "y", False), ("a" * 200, "a" * 200, True), ("a" * 200, "a" * 150, False), ("a" * 200, "a" * 100 + "b" * 100, False), ("a " * 200, "a" * 200, True), (None, None, False), ("", "", False), (" ", "\n", True)])
def test_fixed_points(spark, a, b, want):
    assert one(spark.createDataFrame([(a, b)], "a string, b string").select(T.is_fixed_point(F.col("a"), F.col("b")).alias("x"))).x is want


def test_rates_and_averages(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 6.0)], "name string, slot string, v double")
    found = {(r.level, r.name, r.slot): r.v for r in evaluation.averages(rows, ["name", "slot"], ["v"]).collect()}
    assert found[("all", None, None)] == 3.0 and found[("name", "a", None)] == 1.5 and found[("slot", None, "x")] == 3.5
    assert one(evaluation.best(spark.createDataFrame([(5, 1, 2), (3, 1, 2), (4, 1, 1)], "p int, h1 int, h3 int"), "p", "h1", "h3")).p == 3


def test_marks_are_strict_and_messages_are_clean(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("new", 1)], "k string, t int")
    kept = incremental.above_mark(rows, spark.createDataFrame([("k", 2)], "k string, mark int"), "k", "t")
    assert sorted((r.k, r.t) for r in kept.collect()) == [("k", 3), ("new", 1)]
    schema = "content string, timestamp string, author struct<bot:boolean>, attachments array<struct<url:string>>, embeds array<struct<title:string,description:string>>"
    messages = spark.createDataFrame([(" hi ", "2026-05-06T12:00:00+09:00", (True,), [("u",)], [("t", "d")]), ("", "2026-05-06T12:00:00Z", (False,), None, None), ("x", "bad", (False,), [], [])], schema)
    row = one(incremental.message_rows(messages, F.lit("a")))
    assert (row.role, row.content, row.created_at.hour) == ("assistant", "hi\n\nAttachments:\nu\n\nEmbed title: t\nEmbed description: d", 3) and incremental.message_rows(messages, F.lit("a")).count() == 1


def test_fallback_citations_and_mock_replies(spark):
    import hashlib
    import json

    hits = spark.createDataFrame([(1, 1, "b", None, "b:3:x 1\n--\nb-4- y"), (1, 0, "a", "k", None)], "query_id int, rank int, name string, kind string, excerpt string")
    found = {r.query_id: r for r in fusion.fallback(spark.createDataFrame([(1,), (2,)], "query_id int"), hits).collect()}
    assert (found[1].confidence, found[1].verdict) == (0.68, "ambiguous") and [(c.article, c.excerpt) for c in found[1].citations] == [("k", ""), ("법령", "x 1 · -- · y")]
    assert (found[2].confidence, found[2].verdict, found[2].citations) == (0.0, "does_not_apply", [])
    messages = [{"role": "user", "content": 'say "가"\n'}, {"role": "assistant", "content": ""}]
    want = hashlib.sha256(json.dumps(messages, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:12]
    rows = spark.createDataFrame([([(m["role"], m["content"]) for m in messages],)], "m array<struct<role:string,content:string>>")
    assert one(rows.select(T.mock_reply(F.col("m")).alias("x"))).x == f"[dry_run] deterministic mock response hash={want}"


def test_court_replies_and_numbers(spark):
    items = lambda t: column(spark, envelopes.court_items(F.col("t")), t)
    assert [x.seq for x in items('{"header":{"resultCode":"00"},"body":{"items":{"item":{"seq":7,"nick":null}}}}')] == ["7"] and items('{"body":{"items":""}}') == []
    with pytest.raises(Exception, match="no such key"):
        items('{"header":{"resultCode":"30","resultMsg":"no such key"}}')
    rows = spark.createDataFrame([("2", "2020헌마1"), ("1", "2020헌마12"), ("", "2020헌마1"), ("3", "x")], "id string, number string")
    assert [r.id for r in envelopes.by_number(rows, "2020헌마1").collect()] == ["1", "2"]


def test_a_view_is_swapped_for_a_healthy_table_only(spark, tmp_path):
    for name, count in (("v1", 3), ("v2", 0)):
        spark.range(count).write.parquet(str(tmp_path / name))
    tables.publish(spark, "current_table", str(tmp_path / "v1"))
    with pytest.raises(ValueError):
        tables.publish(spark, "current_table", str(tmp_path / "v2"))
    assert spark.table("current_table").count() == 3


def test_aliases_in_names(spark):
    rows = spark.createDataFrame([("의료기기 취급법", True), ("약사 취급법", False), (None, False)], "n string, want boolean")
    found = fusion.name_matches(F.coalesce("n", F.lit("")), F.lit("x"), F.lit("민법"), F.array(F.lit("의료기기"), F.lit("약사")))
    assert rows.where(found != F.col("want")).count() == 0


def test_regression_counts_missed_queries_of_every_mode(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "query_id int, word string")
    docs = spark.createDataFrame([(10, "has a"), (11, "has b"), (12, None)], "doc_id int, text string")
    hits = "query_id int, doc_id int, rank int"
    one = spark.createDataFrame([(1, 12, 0), (1, 10, 1), (2, 11, 0), (3, 10, 0)], hits)
    two = spark.createDataFrame([(1, 10, 3), (9, 10, 0)], hits)  # beyond the last cut, and a query that nobody asked
    found = search.regression({"one": one, "two": two, "none": one.limit(0)}, queries, docs, F.col("text").contains(F.col("word")))
    assert sorted((r.mode, r.n, r.hits_at_1, r.hits_at_3) for r in found.collect()) == [("none", 3, 0, 0), ("one", 3, 1, 2), ("two", 3, 0, 0)]
