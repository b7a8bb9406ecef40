"""Documents from replies, paged sources, trajectories and the default embedder."""

import json
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import documents as D
from tessera.functions.embedding import embedded, hashed_frequencies
from tessera.plans import trajectories
from tessera.sources import envelopes, markdown, paged, services


def value(spark, c):
    return spark.range(1).select(c.alias("x")).collect()[0].x


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("s,h,f,want", [("a", "b", "c", "a"), ("", "b", "c" * 3000, "b\n\n" + "c" * 2000), (None, "b", "", "b"), (None, None, " f ", "f"), (None, None, None, "")])
def test_body_priority(spark, s, h, f, want):
    assert value(spark, D.body(lit(s), lit(h), lit(f))) == want


def test_decision_text(spark):
    text = value(spark, D.decision(lit("대법원"), lit("2025다1"), lit("20250102"), lit("이름"), {"판시사항": lit("가"), "판결요지": lit("")}))
    assert text == "[대법원 2025다1 (2025.01.02)] 이름\n\n판시사항:\n가"
    assert value(spark, D.kind_of(lit("A0002"))) == "법률" and value(spark, D.kind_of(lit("A0003"))) == "시행령" and value(spark, D.kind_of(lit(None))) == "법률"
    told = lambda date: value(spark, D.interpretation(lit("a"), lit("b"), lit(date), lit("2025.1.2"), lit("t"), {"회답": lit("")}, lit("r" * 4000)))
    assert told("2025.01") == "[a b (2025.1.2)] t\n\n이유:\n" + "r" * 3000 and told("20250103").startswith("[a b (2025.01.03)] t\n")
    assert value(spark, D.constitutional(lit("1"), lit("n"), lit("x"))) == "[헌법재판소 1] n\nx" and value(spark, D.constitutional(lit("1"), lit("n"), lit(" "))) is None


def test_article_body(spark):
    p = F.array(F.struct(F.lit(" one ").alias("text"), F.array(F.lit(" x "), F.lit("")).alias("items")), F.struct(F.lit("").alias("text"), F.lit(None).cast("array<string>").alias("items")))
    assert value(spark, D.article_body(p, lit("c"))) == "one\n  x"
    assert value(spark, D.article_body(F.lit(None).cast("array<struct<text:string,items:array<string>>>"), lit(" c "))) == "c"


def test_articles_near_keywords(spark):
    text = "intro\n##### 제1조 가\naa\n##### 제2조의3 나\nbb\n##### 제3조 다\naa cc"
    near = lambda ks, **s: value(spark, D.articles_near(lit(text), F.array(*[lit(k) for k in ks]), **s))
    assert near(["cc"], window=20) == ["제3조"] and near(["bb", "aa"], window=16) == ["제1조", "제2조의3", "제3조"]
    assert near(["bb", "aa"], window=16, by_keyword=True) == ["제2조의3", "제1조", "제3조"] and near(["aa"], most=1) == ["제1조"]
    assert value(spark, D.articles_near(lit("none"), F.array(lit("x")))) == []
    assert value(spark, D.joined_bodies(F.array().cast("array<string>"))) == "(no article matched)"


def test_pairs_and_suffixes(spark):
    assert tuple(value(spark, D.split_pair(lit(" 1 : a:b ")))) == ("1", "a:b") and value(spark, D.split_pair(lit("1:"))) is None and value(spark, D.split_pair(lit("x"))) is None
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "a"), ("user", "b"), ("assistant", "c"))])
    once = D.with_suffix(m, "/s")
    assert [x.content for x in value(spark, once)] == ["a", "b /s", "c"] == [x.content for x in value(spark, D.with_suffix(once, "/s"))]



def test_paged_source(spark, tmp_path):

    (tmp_path / "page_port.py").write_text("def fetch(page, size):\n    return [{'id': page * 10 + k} for k in range(size if page < 8 else 1)]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "page_port.py"))
    where = "page_port:fetch"
    rows = paged.read_pages(spark, where, 20, 3, partitions=1)
    assert rows.count() == 22 and json.loads(rows.orderBy("page", "position").first().payload) == {"id": 10}
    assert [json.loads(r.payload)["id"] for r in paged.read_pages(spark, where, 4, 3, most=5).collect()] == [10, 11, 12, 20, 21]
    began = time.time()
    assert paged.read_pages(spark, where, 3, 3, per_second=4).count() == 9 and time.time() - began > 0.4


def test_totals_end_pages_and_keys_follow_each_other(spark, tmp_path):
    (tmp_path / "key_port.py").write_text(
        "def total(page, size):\n    return 6, [{'id': page * 10 + k} for k in range(size)]\n"
        "def before(key, last, size):\n    ids = [i for i in range(7, 0, -1) if last is None or i < last]\n    return [{'id': i, 'of': key} for i in ids[:size]]\n"
        "def send(rows):\n    return len({r['id'] for r in rows})\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "key_port.py"))
    assert paged.read_pages(spark, "key_port:total", 20, 3, partitions=1).count() == 6
    rows = paged.read_messages(spark, "key_port:before", ["a", "b"], size=3).collect()
    assert [(r.page, json.loads(r.payload)["id"]) for r in rows if r.key == "b"] == [(1, 7), (1, 6), (1, 5), (2, 4), (2, 3), (2, 2), (3, 1)] and len(rows) == 14
    posted = paged.post(spark.createDataFrame([(k % 4, "x") for k in range(10)], "id int, t string").coalesce(1), "key_port:send", 4).collect()
    assert [r.inserted for r in posted] == [4, 4, 2]


def test_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"id": "x", "content": "1"},\n{"id": "y"}\n]')
    rows = paged.read_array(spark, str(tmp_path / "a.json"), "struct<id:string,content:string>", 1).collect()
    assert [(r.id, r.content) for r in rows] == [("x", "1")]


def test_array_file_that_may_be_missing(spark, tmp_path):
    path = str(tmp_path / "none.json")
    assert paged.read_array(spark, path, "struct<id:string>", missing_ok=True).collect() == []
    with pytest.raises(AnalysisException):
        paged.read_array(spark, path, "struct<id:string>")


def test_folders(spark, tmp_path):
    for name in ("가", "b +%", "empty"):
        (tmp_path / name).mkdir()
    (tmp_path / "가" / "법률.md").write_text("x")
    (tmp_path / "가" / "시행령.md").write_text("x")
    (tmp_path / "b +%" / "법률.md").write_text("x")
    (tmp_path / "file.md").write_text("x")
    assert sorted(r.folder for r in markdown.folders(spark, str(tmp_path)).collect()) == ["b +%", "가"]
    with pytest.raises(AnalysisException):
        markdown.folders(spark, str(tmp_path / "none")).collect()


def test_pages_and_details_of_decisions(spark):
    supreme, cases = services.SERVICES["supreme"], services.SERVICES["precedents"]
    listed = "<r><totalCnt>3</totalCnt><prec><판례일련번호> 7 </판례일련번호><사건명>a</사건명></prec><prec><사건명>b</사건명></prec></r>"
    found = value(spark, services.page(lit(listed), supreme))
    assert found.total == 3 and [(x.prec_id, x.case_name, x.court_name) for x in found["items"]] == [("7", "a", "")]
    assert [x.prec_id for x in value(spark, services.page(lit(listed), cases))["items"]] == ["7", ""]
    for broken in ("<r><prec>", None, ""):
        found = value(spark, services.page(lit(broken), supreme))
        assert found.total == 0 and found["items"] == []
    detail = "<P><참조조문><![CDATA[a<BR>b<i>c</i>]]></참조조문></P>"
    assert value(spark, services.detail(lit(detail), cases)).이유 == "a\nbc"
    found = value(spark, services.detail(lit(detail), supreme, lit("9")))
    assert found.prec_id == "9" and found.참조조문 == "a<BR>b<i>c</i>"
    assert value(spark, services.detail(lit("<Law>none</Law>"), supreme, lit("9"))) is None



def test_a_reply_is_parsed_once_for_all_its_fields(spark):
    """However many fields of a page and of a detail are asked for; and one parse tells what a parse for each told."""
    item = "<{0}><사건번호>n</사건번호><판례일련번호> 7 </판례일련번호><안건번호>k</안건번호></{0}>"
    kinds = {"prec": item.format("prec"), "Detc": item.format("Detc"), "expc": item.format("expc")}
    payloads = [None, "", "not XML", "<r><prec>", "<r/>", "<Law>none</Law>", "<?xml version='1.0'?><Law>none</Law>", "<r>text</r>", "<r><totalCnt>x</totalCnt></r>", "<r><totalCnt></totalCnt></r>", "<r><totalCnt>7</totalCnt><totalCnt>8</totalCnt></r>"]
    for tag, one in kinds.items():
        payloads += [f"<r><totalCnt> 12 </totalCnt>{one}{one}</r>", f"<r>{one}<totalCnt>3</totalCnt></r>", f"<r><totalCnt>2</totalCnt><{tag}/>{one}</r>", f"<r><totalCnt>2</totalCnt><{tag}>text</{tag}></r>", f"<r><totalCnt>2</totalCnt>{one}<{tag}>", f"<r><totalCnt><x>1</x></totalCnt>{one}</r>", f"<r><totalCnt>4</totalCnt><{tag}><사건번호><b>1</b></사건번호></{tag}></r>"]
    rows = spark.createDataFrame([(p,) for p in payloads], "t string").repartition(2)
    for service in services.SERVICES.values():
        page, detail = services.page(F.col("t"), service), services.detail(F.col("t"), service)
        read = rows.select(page.alias("page"), detail.alias("detail"))
        told = read.select("page.total", F.size("page.items").alias("n"), F.get("page.items", F.lit(0))["case_number"].alias("a"), F.get("page.items", F.lit(0))["decision_date"].alias("b"), *[F.col("detail")[n].alias(f"d{k}") for k, n in enumerate(service.detail)])
        assert told._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 2
        items = envelopes.xml_items(F.col("t"), service.tag, service.listed)
        if service.needed:
            items = F.filter(items, lambda x: x[service.needed] != "")  # noqa: B023
        apart = rows.select("t", envelopes.xml_total(F.col("t")).alias("total"), items.alias("items"))
        assert sorted(map(repr, rows.select("t", page.alias("p")).select("t", "p.total", "p.items").collect())) == sorted(map(repr, apart.collect()))


def test_trajectories(spark):
    rows = [("t", "a", None, "root_prompt", 0, 1.0, '{"x":1}', 10, 0), ("t", "b", "a", "sub_llm_request", 1, 2.0, "{}", 60, 5), ("t", "c", "b", "sub_llm_response", 4, 3.0, None, 60, 5)]
    events = spark.createDataFrame(rows, trajectories.SCHEMA)
    assert sorted((r.root, r.node, r.depth) for r in trajectories.lineage(events).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    back = trajectories.parsed(trajectories.lines(events))
    assert sorted((r.event_id, r.depth, r.tokens_in, json.loads(r.payload or "null")) for r in back.collect()) == [("a", 0, 10, {"x": 1}), ("b", 1, 60, {}), ("c", 4, 60, None)]
    caps = {**trajectories.CAPS, "tokens_in": 100}
    assert [r.exceeded for r in trajectories.over_budget(events, caps).orderBy("ts_ms").collect()] == [None, None, "depth"]
    assert [r.exceeded for r in trajectories.over_budget(events, {**caps, "depth": 9, "tokens_in": 69}).orderBy("ts_ms").collect()] == [None, "tokens_in", "tokens_in"]
    assert {r.kind: (r.n, r.tokens_in) for r in trajectories.totals(events).collect()}["root_prompt"] == (1, 10)


@pytest.mark.parametrize("final,error,want", [("[{\"law_id\": \"1\", \"excerpt\": \"" + "e" * 400 + "\"}]", None, ("applies", 0.7, 1)), ("[]", None, ("does_not_apply", 0.3, 0)), ('"text"', None, ("does_not_apply", 0.3, 0)), (None, None, ("ambiguous", 0.5, 0)), ("[]", "bad", (None, 0.0, 0))])
def test_final_answers(spark, final, error, want):
    a = value(spark, trajectories.answer(lit(final), lit(error)))
    assert (a.verdict, a.confidence, len(a.citations)) == want and all(len(c.excerpt) == 300 for c in a.citations)


def test_default_embedder(spark):
    rows = embedded(spark.createDataFrame([("aa bb",), ("bb aa",), (None,)], "text string"), hashed_frequencies(16)).collect()
    assert rows[0].embedding == rows[1].embedding and abs(sum(x * x for x in rows[2].embedding) - 1) < 1e-6
