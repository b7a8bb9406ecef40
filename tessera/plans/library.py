"""More of the library's queries: scalar functions, chunks, trees, replies of services and reports, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import blanks, chunking, documents, named, text as T
from tessera.operators import bm25, evaluation, fusion, grep, ingest, names, trees
from tessera.plans import queries as base, search, trajectories
from tessera.plans.registry import query, table
from tessera.sources import envelopes, services
from tessera.sources.tables import new_path, written
from tessera.streaming import incremental, state


def _choice(number: Column, *values) -> Column:
    """values[number mod their number]."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ---- scalar functions


@query(r"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, o_orderdate AS d, o_orderkey % 150 AS x, o_orderkey % 120 AS y FROM orders)
SELECT k AS id, CASE WHEN k % 4 = 2 THEN '2025-13' ELSE strftime(d, '%Y-%m-%d') END AS normal,
    CASE k % 4 WHEN 0 THEN strftime(d, '%Y.%m.%d') WHEN 1 THEN strftime(d, '%Y.%m.%d') WHEN 2 THEN '' ELSE ' ' || strftime(d, '%Y-%m-%d') || ' ' END AS shown,
    CASE k % 3 WHEN 0 THEN '§' || s WHEN 1 THEN '부칙' ELSE '§0' || s END AS reference, CASE k % 3 WHEN 0 THEN '제제' || s || '조 (연차)조' WHEN 1 THEN '제부칙조' ELSE '제' || s || '조' END AS label,
    '__' || s || '_a_b_' || repeat('x', 40 - least(40, 7 + length(s))) AS safe_id, CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(k % 7 AS INTEGER) END AS first_rank,
    CASE k % 3 WHEN 0 THEN 'print(' || s || ')' WHEN 1 THEN 'raw ' || s ELSE 'bare ' || s END AS code, k % 3 = 0 AS passed,
    CASE k % 6 WHEN 2 THEN '법률' WHEN 3 THEN '시행령' WHEN 4 THEN '시행규칙' WHEN 5 THEN '고시' ELSE '법률' END AS kind,
    CASE WHEN x = 0 OR y = 0 THEN FALSE WHEN least(x, y) < 100 THEN x = y WHEN least(x, y) / greatest(x, y) < 0.85 THEN FALSE ELSE least(x, y) / greatest(x, y) > 0.8 END AS fixed,
    CASE WHEN k % 2 = 0 THEN '-' ELSE '+' END || CAST(k % 9 AS VARCHAR) || '.50' AS delta, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 11 END AS score, CAST(greatest(1, k % 40 // 4) AS INTEGER) AS tokens
FROM o""")  # fmt: skip
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    k, s, d = F.col("o_orderkey"), _text("o_orderkey"), F.col("o_orderdate")
    day = lambda f: F.date_format(d, f)
    date = _choice(k, day("yyyy.MM.dd"), day("yyyyMMdd"), "2025-13", F.concat(F.lit(" "), day("yyyy-MM-dd"), F.lit(" ")))
    article = _choice(k, F.concat(F.lit("제"), s, F.lit("조 (연차)")), "부칙", F.concat(F.lit(" 0"), s))
    ranks = F.when(k % 5 == 4, "none []").otherwise(F.concat(F.lit("say ["), (k % 7).cast("string"), F.lit(", 1,2] ok")))
    reply = _choice(k, F.concat(F.lit("x ```python\nprint("), s, F.lit(")\n``` y")), F.concat(F.lit("```\nraw "), s, F.lit("\n```")), F.concat(F.lit("  bare "), s, F.lit(" ")))
    verdict = _choice(k, "VERDICT: FAIL then verdict: pass", "none", "VERDICT: PASS VERDICT: FAIL")
    found = F.when(k % 4 == 0, "no object").otherwise(F.concat(F.lit('so {"score": '), (k % 11).cast("string"), F.lit('} and {"score": 99}')))
    filler = lambda n: F.repeat(F.lit("ab"), n.cast("int"))
    same = T.is_fixed_point(F.substr(filler(k % 150), F.lit(1), (k % 150).cast("int")), F.concat(F.substr(filler(k % 120), F.lit(1), (k % 120).cast("int")), F.lit(" \n")))
    same = F.when(k % 120 == 0, F.lit(False)).otherwise(same)
    return table(spark, folder, "orders").select(
        k.alias("id"), T.normal_date(date).alias("normal"), T.shown_date(date).alias("shown"), T.article_reference(article).alias("reference"), T.article_label(article).alias("label"),
        T.safe_identifier(F.concat(F.lit("법-"), s, F.lit(" a.b "), F.repeat(F.lit("x"), F.lit(60)))).alias("safe_id"), F.get(T.rank_list(ranks), F.lit(0)).alias("first_rank"), T.fenced_code(reply).alias("code"),
        T.passes(verdict).alias("passed"), documents.kind_of(F.concat(F.lit("A000"), (k % 6).cast("string"))).alias("kind"), same.alias("fixed"),
        T.signed(F.when(k % 2 == 0, -1).otherwise(1) * (k % 9 + 0.5).cast("double")).alias("delta"), T.first_object(found, "score long")["score"].alias("score"),
        T.token_estimate(F.repeat(F.lit("t"), (k % 40).cast("int") + F.when(k % 40 == 0, 1).otherwise(0))).alias("tokens"),
    )


NAMES, NOUNS, ENDS, TAILS = ["민법", "근로기준법", "수소법", "난민법", "의료기기법"], ["연차휴가", "환자동의", "수소경제법", "책임", "개인정보 처리", "국가계약의 요건", "no Hangul"], ["", " 시행령", " 규정"], ["", " 요건", " 효력", " 보존기간"]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH a(o, n) AS (VALUES {', '.join(f"({k}, '{n}')" for k, n in enumerate(names.ALIASES))}),
q AS (SELECT o_orderkey AS k, {_listed(NAMES)}[k % 5 + 1] || ' ' || {_listed(NOUNS)}[k % 7 + 1] || {_listed(ENDS)}[k % 3 + 1] || {_listed(TAILS)}[k % 4 + 1] AS query FROM orders),
named AS (SELECT q.*, (SELECT min_by(n, o) FROM a WHERE contains(q.query, n)) AS detected, regexp_extract_all(query, '[가-힣]{{2,}}') AS ts FROM q),
parts AS (SELECT *, list_filter(ts, lambda t: detected IS NOT NULL AND NOT (starts_with(t, detected) OR starts_with(detected, t)) AND NOT list_contains({_listed(T.STRUCTURAL)}, t)) AS topical,
    list_filter(ts, lambda t: length(regexp_replace(t, '{T.NAME_SUFFIX}', '')) >= 3) AS long FROM named)
SELECT k AS query_id, detected, coalesce(list_filter(topical, lambda t: length(t) = list_max(list_transform(topical, lambda u: length(u))))[1],
    regexp_replace(list_filter(long, lambda t: length(t) = list_max(list_transform(long, lambda u: length(u))))[1], '{T.NAME_SUFFIX}', ''),
    list_filter(ts, lambda t: length(t) = list_max(list_transform(ts, lambda u: length(u))))[1]) AS keyword FROM parts""")
def keyword_extract(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, folder, "orders").select(k.alias("query_id"), F.concat(_choice(k, *NAMES), F.lit(" "), _choice(k, *NOUNS), _choice(k, *ENDS), _choice(k, *TAILS)).alias("query"))
    return names.detect(asked, names.alias_table(spark)).select("query_id", T.filter_keyword(F.col("query"), F.col("detected")).alias("keyword"), "detected")


@query("""SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN '의료법' WHEN 1 THEN '형법' WHEN 2 THEN '민법' ELSE NULL END AS name, o_orderkey % 3 = 0 AS constitutional FROM orders""")
def name_override(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    laws = _choice(k, F.array(F.lit("?"), F.lit("uirobub"), F.lit("minbub")), F.array(F.lit("형법")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))
    detected = F.when(k % 4 == 2, "민법")
    asks = F.when(k % 3 == 0, "이것은 위헌 인가").otherwise("none")
    return table(spark, folder, "orders").select(k.alias("query_id"), names.override(detected, laws, names.folder_map()).alias("name"), names.holds_any(asks, ["헌법", "위헌"]).alias("constitutional"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'applies' WHEN 1 THEN 'does_not_apply' WHEN 2 THEN NULL ELSE 'ambiguous' END AS verdict,
    CAST(CASE turn % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.3 WHEN 2 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS confidence, CASE turn % 4 WHEN 0 THEN 2 ELSE 0 END AS cited, CASE WHEN turn % 4 = 0 THEN md5(left(text, 300)) END AS excerpt_md5, CASE WHEN turn % 4 = 0 THEN 'unknown' END AS law_id FROM conversations""")
def answers_of_models(spark: SparkSession, folder: str) -> DataFrame:
    item = F.to_json(F.array(F.struct(F.col("text").alias("excerpt")), F.struct(F.lit("x").alias("excerpt"))))
    final = F.when(F.col("turn") % 4 == 0, item).when(F.col("turn") % 4 == 1, '"text"')
    error = F.when(F.col("turn") % 4 == 2, "bad")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", trajectories.answer(final, error).alias("a"))
    first = F.get("a.citations", F.lit(0))
    return rows.select("conv_id", "turn", "a.verdict", F.col("a.confidence").cast("double").alias("confidence"), F.size("a.citations").alias("cited"), F.md5(first["excerpt"]).alias("excerpt_md5"), first["law_id"].alias("law_id"))


# ---- chunks and documents


@query(r"""WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS k, 'x' || regexp_replace(left(coalesce(text, ''), 300), '\s+$', '') AS body, replace(left(source, 20), ' ', '_') AS slug FROM documents),
parts AS (SELECT *, unnest(['제1조', '제2조의3', '제2조의3']) AS article, unnest(['(목적)', '', '(둘)']) AS article_title, unnest(['', '', '_2']) AS again, unnest([body, 'next', 'again']) AS content FROM d)
SELECT k || '_' || slug || '_' || lang || '_' || article || again AS doc_id, article, article_title, md5(left('[' || CASE WHEN doc_id % 2 = 0 THEN 'name of ' || k ELSE source END || ' ' || article || CASE WHEN article_title = '' THEN '' ELSE ' ' || article_title END || '] ' || content, 8000)) AS document_md5, '20260426' AS enforcement_date FROM parts""")
def markdown_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a file with front matter and three articles, one of them empty, one repeated."""
    key = _text("doc_id")
    named = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n제목: 'name of "), key, F.lit("'"))).otherwise("")
    text = F.concat(F.lit("---\n법령ID: "), key, named, F.lit("\n시행일자: 2026-04-26\n---\nlost\n# 제1조(목적)\nx"), F.substring(F.coalesce("text", F.lit("")), 1, 300), F.lit("\n### 제2조의3\nnext\n### 제4조\n##### 제2조의3 (둘)\nagain\n"))
    files = table(spark, folder, "documents").select(F.col("source").alias("folder"), F.col("lang").alias("kind"), key.alias("path"), text.alias("text"))
    found = chunking.chunks(files, "2026-05-07T00:00:00+00:00")
    return found.select("doc_id", "article", "article_title", F.md5("document").alias("document_md5"), "enforcement_date")


@query(r"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, source, lang, left(coalesce(text, ''), 60) AS a, left(coalesce(text, ''), 3500) AS r FROM documents),
strip AS (SELECT *, regexp_replace(a, '^\s+|\s+$', '', 'g') AS sa, regexp_replace(r, '^\s+|\s+$', '', 'g') AS sr FROM d)
SELECT doc_id, md5(left('[' || source || ' ' || k || ' (' || CASE doc_id % 3 WHEN 0 THEN '2025.01.02' WHEN 1 THEN '2025.1' ELSE '' END || ')] ' || lang || chr(10) || chr(10) || '판시사항:' || chr(10) || 'p' || a, 8000)) AS decision_md5,
    md5(left('[' || source || ' ' || k || ' (' || CASE doc_id % 3 WHEN 0 THEN '2025.01.02' ELSE '2024.12.31' END || ')] ' || lang || chr(10) || chr(10) || '회답:' || chr(10) || 'h' || a || CASE WHEN r = '' THEN '' ELSE chr(10) || chr(10) || '이유:' || chr(10) || left(r, 3000) END, 8000)) AS interpretation_md5,
    md5(CASE WHEN doc_id % 2 = 0 AND sa != '' THEN sa WHEN doc_id % 5 < 4 THEN 'holding' || CASE WHEN sr = '' THEN '' ELSE chr(10) || chr(10) || left(sr, 2000) END ELSE sr END) AS body_md5,
    CASE WHEN doc_id % 7 > 0 AND sa != '' THEN md5('[헌법재판소 ' || k || '] ' || lang || chr(10) || a) END AS constitutional_md5
FROM strip""")  # fmt: skip
def document_builders(spark: SparkSession, folder: str) -> DataFrame:
    key, k = F.col("doc_id"), _text("doc_id")
    text, start = F.coalesce("text", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 60)
    date = _choice(key, "20250102", "2025.1", F.lit(None).cast("string"))
    decision = documents.decision(F.col("source"), k, date, F.col("lang"), {"판시사항": F.concat(F.lit("p"), start), "판결요지": F.lit("")})
    told = documents.interpretation(F.col("source"), k, date, F.lit("2024.12.31"), F.col("lang"), {"질의요지": F.lit(None).cast("string"), "회답": F.concat(F.lit("h"), start)}, F.substring(text, 1, 3500))
    body = documents.body(F.when(key % 2 == 0, start), F.when(key % 5 < 4, F.lit(" holding ")), F.substring(text, 1, 3500))
    case = documents.constitutional(F.when(key % 7 > 0, k), F.col("lang"), start)
    return table(spark, folder, "documents").select("doc_id", F.md5(decision).alias("decision_md5"), F.md5(told).alias("interpretation_md5"), F.md5(body).alias("body_md5"), F.md5(case).alias("constitutional_md5"))


# ---- trees

NODES = r"""l AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT *, i % 4 AS kind, i // 4 + 1 AS law, regexp_replace('h ' || s, '\s+$', '') AS title, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM l),
node AS (SELECT *, k || '.law' || law || CASE WHEN kind > 0 THEN '.chapter1' ELSE '' END || CASE WHEN kind > 1 THEN '.section1' ELSE '' END AS node_id,
    CASE kind WHEN 0 THEN k ELSE k || '.law' || law || CASE WHEN kind > 1 THEN '.chapter1' ELSE '' END END AS parent_id, ['law', 'chapter', 'section'][kind + 1] AS level_name FROM m WHERE kind < 3)"""


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's lines as headings of three depths and a body, in turn."""
    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.concat(F.element_at(F.array(*map(F.lit, ("# h ", "## h ", "### h ", "b "))), i % 4 + 1), s))
    return trees.tree(table(spark, folder, "documents").select(_text("doc_id").alias("doc_id"), F.concat_ws("\n", marked).alias("text")))


@query(rf"""WITH {NODES} SELECT node_id, parent_id, CAST(kind + 1 AS INTEGER) AS level, md5(title) AS title_md5, md5(CASE WHEN kind = 2 AND following IS NOT NULL THEN regexp_replace('b ' || following, '\s+$', '') ELSE '' END) AS body_md5,
CAST((law - 1) * 3 + kind + 1 AS INTEGER) AS preorder FROM node""")
def heading_tree(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).select("node_id", "parent_id", "level", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), "preorder")


@query(rf"""WITH {NODES} SELECT node_id, md5(title) AS title_md5, md5(CASE WHEN kind = 2 AND following IS NOT NULL THEN {blanks.sql_strip("'b ' || following")} ELSE '' END) AS body_md5, CAST((law - 1) * 3 + kind + 1 AS INTEGER) AS preorder FROM node""")
def heading_tree_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The same trees from texts whose lines end in every way, with wide blanks after the marks of headings and at the ends of lines."""
    marks = F.array(*map(F.lit, ("#\u3000h ", "##\xa0h ", "###\u2003 h ", "\u3000b ")))
    ends = F.array(*[F.lit(e) for e in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028", "\u2029")])
    line = lambda s, i: F.concat(F.element_at(marks, i % 4 + 1), s, F.lit("\u3000\xa0"), F.element_at(ends, i % F.size(ends) + 1))
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "")
    found = trees.tree(table(spark, folder, "documents").select(_text("doc_id").alias("doc_id"), text.alias("text")))
    return found.select("node_id", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), "preorder")


@query(rf"""WITH p AS (SELECT page_id, chr(12288) || '<b>' || coalesce(html, '') || chr(160) || '</b><BR' || chr(12288) || '/>' || chr(133) AS h FROM pages)
SELECT page_id, md5({blanks.sql_strip("regexp_replace(regexp_replace(h, '(?i)<br[' || chr(12288) || chr(160) || chr(5760) || '[:space:]]*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')")}) AS cleaned_md5 FROM p""")
def html_clean_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Markup with wide blanks at the ends and inside a tag, which are white space like any other."""
    html = F.concat(F.lit("\u3000<b>"), F.coalesce("html", F.lit("")), F.lit("\xa0</b><BR\u3000/>\x85"))
    return table(spark, folder, "pages").select("page_id", F.md5(T.strip_html(html)).alias("cleaned_md5"))


@query(rf"""WITH c AS (SELECT *, {blanks.sql_strip("CASE WHEN turn % 3 = 0 THEN chr(12288) || chr(8232) ELSE chr(12288) || coalesce(text, '') || chr(160) END")} AS body FROM conversations),
m AS (SELECT conv_id, turn, concat_ws(chr(10) || chr(10), nullif(body, ''), CASE WHEN turn % 3 = 1 THEN 'Attachments:' || chr(10) || 'u' || turn END, CASE WHEN turn % 4 = 1 THEN 'Embed title: t' END) AS content FROM c)
SELECT CAST(conv_id AS VARCHAR) AS agent_id, count(*) AS n, md5(string_agg(content, '|' ORDER BY content)) AS contents_md5 FROM m WHERE content != '' GROUP BY conv_id""")
def message_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of wide blanks: those that say nothing else are none."""
    turn, wide = F.col("turn"), lambda c: F.concat(F.lit("\u3000"), c, F.lit("\xa0"))
    rows = table(spark, folder, "conversations").select(
        "conv_id", F.when(turn % 3 == 0, "\u3000\u2028").otherwise(wide(F.coalesce("text", F.lit("")))).alias("content"), F.lit("2026-05-06T12:00:00+00:00").alias("timestamp"), F.struct(F.lit(False).alias("bot")).alias("author"),
        F.array(F.struct(F.when(turn % 3 == 1, wide(F.concat(F.lit("u"), turn.cast("string")))).otherwise("\u2003").alias("url"))).alias("attachments"),
        F.array(F.struct(F.when(turn % 4 == 1, "\u3000t\x85").otherwise("\x1f").alias("title"), F.lit("\u205f").alias("description"))).alias("embeds"),
    )
    found = incremental.message_rows(rows, F.col("conv_id").cast("string"))
    return found.groupBy("agent_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("content")), "|")).alias("contents_md5"))


@query(rf"""WITH {NODES},
o AS (SELECT k, left('[root] ' || k || ' :: ' || k || chr(10) || string_agg(repeat('  ', kind + 1) || '[' || level_name || '] ' || node_id || ' :: ' || title, chr(10) ORDER BY i), 18000) AS t FROM node WHERE kind < 2 GROUP BY k),
a AS (SELECT k, k || chr(10) || string_agg(repeat('  ', kind + 1) || '[' || level_name || '] ' || title, chr(10) ORDER BY i) AS t FROM node GROUP BY k),
c AS (SELECT k, 'flowchart TD' || chr(10) || '    ' || k || '["' || k || '"]' || chr(10) || string_agg('    ' || replace(node_id, '.', '_') || '["' || replace(left(title, 60), '"', '''') || '"]' || chr(10) || '    ' || replace(parent_id, '.', '_') || ' --> ' || replace(node_id, '.', '_'), chr(10) ORDER BY i) AS t FROM node WHERE kind < 2 GROUP BY k)
SELECT k AS doc_id, md5(o.t) AS outline_md5, md5(a.t) AS tree_md5, md5(c.t) AS chart_md5 FROM o JOIN a USING (k) JOIN c USING (k)""")
def tree_renderings(spark: SparkSession, folder: str) -> DataFrame:
    nodes = written(_nodes(spark, folder), "nodes")
    found = trees.outline(nodes, 2).join(trees.text_tree(nodes), "doc_id").join(trees.mermaid(nodes, 1), "doc_id")
    return found.select("doc_id", F.md5("outline").alias("outline_md5"), F.md5("tree").alias("tree_md5"), F.md5("chart").alias("chart_md5"))


@query(rf"""WITH {NODES}, kept AS (SELECT * FROM node WHERE CAST(k AS BIGINT) < 100000)
SELECT 'all.' || node_id AS node_id, 'all.' || parent_id AS parent_id, CAST(kind + 2 AS INTEGER) AS level, CAST(kind + 3 AS INTEGER) AS depth FROM kept
UNION ALL SELECT DISTINCT 'all.' || k, 'all', 1, 2 FROM kept UNION ALL SELECT 'all', NULL, 0, 1""")
def tree_under_one_root(spark: SparkSession, folder: str) -> DataFrame:
    return trees.under_root(_nodes(spark, folder), "all", "All").select("node_id", "parent_id", "level", F.size("path").alias("depth"))


# ---- replies of services


@query("""SELECT l_orderkey AS reply, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS position, 'p' || l_partkey AS name, CAST(l_linenumber AS VARCHAR) AS number FROM lineitem""")
def service_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a reply that lists its items: XML for even orders, JSON for odd ones, where one item stands without a list."""
    order = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))))
    replies = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("reply")).agg(order.alias("items"))
    element = lambda x: F.concat(F.lit("<law><법령명> p"), x["p"].cast("string"), F.lit(" </법령명><MST>"), x["n"].cast("string"), F.lit("</MST></law>"))
    listed = F.transform("items", lambda x: F.struct(F.concat(F.lit("p"), x["p"].cast("string")).alias("n"), x["n"].cast("string").alias("m")))
    one = F.to_json(F.struct(F.struct(listed[0].alias("law")).alias("s")))
    payload = F.when(F.col("reply") % 2 == 0, F.concat(F.lit("<r><totalCnt>9</totalCnt>"), F.concat_ws("", F.transform("items", element)), F.lit("</r>"))).when(F.size("items") == 1, one).otherwise(F.to_json(F.struct(F.struct(listed.alias("law")).alias("s"))))
    replies = replies.select("reply", payload.alias("payload"))
    a = replies.where("reply % 2 = 0").select("reply", F.posexplode(envelopes.xml_items(F.col("payload"), "law", {"name": "법령명", "number": "MST"})).alias("p", "x"))
    b = replies.where("reply % 2 != 0").select("reply", F.posexplode(envelopes.json_items(F.col("payload"), ["s", "law"], "struct<n:string,m:string>")).alias("p", "x"))
    return a.select("reply", (F.col("p") + 1).alias("position"), "x.name", "x.number").unionByName(b.select("reply", (F.col("p") + 1).alias("position"), F.col("x.n").alias("name"), F.col("x.m").alias("number")))


@query("""SELECT ['law', 'prec', 'expc', 'detc', 'decc', 'admrul', 'ordin'][s_suppkey % 7 + 1] AS target, CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey || ' · b' ELSE 'b' END AS subtitle, '20260101' AS date,
CASE WHEN s_suppkey % 3 = 0 THEN 'https://site/' || s_suppkey ELSE 'http://x' END AS url FROM supplier""")
def search_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier as a reply of one of the seven services, read by that service's table of fields."""
    suppliers, out = table(spark, folder, "supplier"), None
    for number, (name, t) in enumerate(envelopes.TARGETS.items()):
        k = F.col("s_suppkey")
        fields = [_text("s_suppkey").alias(t.number), F.col("s_name").alias(t.title), F.when(k % 2 == 0, _text("s_nationkey")).otherwise("").alias(t.subtitle[0]), F.lit("b").alias(t.subtitle[1]), F.lit("20260101").alias(t.date),
                  F.when(k % 3 == 0, F.concat(F.lit("/"), _text("s_suppkey"))).otherwise("http://x").alias(t.link)]
        item = F.struct(*fields)
        for step in reversed(t.path):
            item = F.struct(item.alias(step))
        replies = suppliers.where(k % 7 == number).select(F.to_json(item).alias("payload"))
        found = envelopes.search_results(replies, t, "https://site").select(F.lit(name).alias("target"), "id", "title", "subtitle", "date", "url")
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 4 AS which, o_orderkey % 5 = 4 AS bad, o_orderkey % 7 = 0 AS refused FROM orders)
SELECT k AS reply, ['precedents', 'supreme', 'constitutional', 'interpretations'][which + 1] AS service, CASE WHEN bad THEN 0 ELSE CAST(k % 1000 AS INTEGER) END AS total,
    CASE WHEN bad THEN 0 WHEN which = 1 THEN 1 ELSE 2 END AS items, CASE WHEN NOT bad THEN s END AS id, CASE WHEN NOT bad THEN 'n' || s END AS number,
    CASE WHEN which IN (1, 2) AND refused THEN NULL WHEN refused THEN '' WHEN which = 3 THEN '20250102' ELSE '2025.01-02' END AS decided,
    CASE WHEN which IN (1, 2) AND refused THEN NULL WHEN refused THEN '' WHEN which IN (1, 2) THEN 'a<br/><b>' || s || '</b>' ELSE 'a' || chr(10) || s END AS section
FROM o""")
def service_details(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a page and a detail of one of the four services of decisions, some broken or refused, read by that service's fields."""
    k, s = F.col("o_orderkey"), _text("o_orderkey")
    element = lambda name, *text: F.concat(F.lit(f"<{name}> "), *[t if isinstance(t, Column) else F.lit(t) for t in text], F.lit(f" </{name}>"))
    last = {"precedents": "이유", "supreme": "판례내용", "constitutional": "결정요지", "interpretations": "회답"}
    out = None
    for which, (name, service) in enumerate(services.SERVICES.items()):
        key = next(iter(n for n in service.listed if n.endswith("_id")))
        first = F.concat(F.lit(f"<{service.tag}>"), element(service.listed[key], s), element(service.listed["case_number"], "n", s), F.lit(f"</{service.tag}>"))
        listed = F.concat(F.lit("<r><totalCnt>"), (k % 1000).cast("string"), F.lit("</totalCnt>"), first, F.lit(f"<{service.tag}><x>1</x></{service.tag}></r>"))
        told = F.concat(F.lit("<Service>"), element(service.detail["decision_date"], "2025.01-02"), element(service.detail[last[name]], "<![CDATA[a<br/><b>", s, "</b>]]>"), F.lit("</Service>"))
        replies = table(spark, folder, "orders").where(k % 4 == which).select(k.alias("reply"), F.when(k % 5 == 4, "not XML").otherwise(listed).alias("listed"), F.when(k % 7 == 0, "<Law>none</Law>").otherwise(told).alias("told"))
        read = replies.select("reply", services.page(F.col("listed"), service).alias("page"), services.detail(F.col("told"), service).alias("detail"))
        one = F.get("page.items", F.lit(0))
        rows = read.select("reply", F.lit(name).alias("service"), "page.total", F.size("page.items").alias("items"), one[key].alias("id"), one["case_number"].alias("number"), F.col("detail")["decision_date"].alias("decided"), F.col("detail")[last[name]].alias("section"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 0 WHEN contains(o_orderpriority, '5-LOW') AND o_orderstatus = 'F' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders)
SELECT o_custkey AS query_id, o_orderkey AS position, o_orderpriority AS name, o_orderstatus AS type FROM r WHERE n = 1""")
def prefer_exact_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("query_id"), F.lit("5-LOW").alias("query"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("type"))
    return envelopes.best_matches(rows, kind="F").select("query_id", "position", "name", "type")


# ---- the whole search path, sweeps, texts of laws, the keyword fallback

SEARCHED = f"""{base.BM25}, {base.DISTANCES}, {base.PREFERRED},
{base._ranks("scored", 20, "whole")}, named AS (SELECT s.* FROM scored s JOIN documents d USING (doc_id) WHERE d.source = 'src' || (query_id % 20) AND query_id % 3 > 0 OR query_id % 3 = 0), {base._ranks("named", 20, "own")},
held_own AS (SELECT query_id, count(*) AS n FROM own GROUP BY ALL),
both_ AS (SELECT *, 0 AS part FROM own UNION ALL SELECT w.*, 1 FROM whole w ANTI JOIN own USING (query_id, doc_id) WHERE coalesce((SELECT n FROM held_own h WHERE h.query_id = w.query_id), 0) < 5),
lexical AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) - 1 AS rank FROM both_),
parts AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank + 1) AS s, rank AS place FROM kept_near WHERE query_id IN (SELECT item_id FROM benchmark) UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank + 1), 1000 + rank FROM lexical),
sums AS (SELECT query_id, doc_id, sum(s) AS score, min(place) AS place FROM parts GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place, doc_id) - 1 AS rank FROM sums QUALIFY rank < 20)"""
MATCHED = "query_id % 3 > 0 AND (d.source = 'src' || (query_id % 20) OR contains(d.source, 'src1'))"


def _searched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Queries, documents, the fused hits of the filtered lists, and what earns the boost. Every third query names no source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    asked = base._asked(spark, folder).withColumn("wanted", F.when(F.col("query_id") % 3 > 0, F.col("wanted")))
    near = base._near_with_word(spark, folder).join(asked.select("query_id"), "query_id", "left_semi")
    hits = search.fused_hits(asked, docs, near, base._index(spark, folder), equal=("source", "wanted"))
    matches = F.col("wanted").isNotNull() & fusion.name_matches(F.col("source"), F.col("source"), F.col("wanted"), F.array(F.lit("src1"), F.lit("rc2")))
    return asked, docs, hits, matches


@query(f"""WITH {SEARCHED},
raised AS (SELECT f.*, f.score + CASE WHEN {MATCHED} THEN 0.3 ELSE 0 END AS raised FROM fused f JOIN documents d USING (doc_id))
SELECT query_id, doc_id, round(raised, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raised, 12) DESC, rank, doc_id) - 1 AS INTEGER) AS new_rank FROM raised QUALIFY new_rank < 5""")
def search_path(spark: SparkSession, folder: str) -> DataFrame:
    """Word filter before the vectors, name filter with fallback for BM25, fusion, and the boost by name or alias."""
    asked, docs, hits, matches = _searched(spark, folder)
    found = search.boosted_hits(hits, asked, docs, matches).where("rank < 5")
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").alias("new_rank"))


@query(f"""WITH {SEARCHED}, bs AS (SELECT unnest([0.2, 0.3, 0.4, 0.5]) AS boost),
raised AS (SELECT CAST(boost AS DOUBLE) AS boost, f.*, f.score + CASE WHEN {MATCHED} THEN CAST(boost AS DOUBLE) ELSE 0 END AS raised, d.lang = 'en' AS hit FROM fused f JOIN documents d USING (doc_id), bs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY boost, query_id ORDER BY round(raised, 12) DESC, rank, doc_id) AS n FROM raised),
told AS (SELECT boost, query_id, bool_or(hit AND n <= 1) AS h1, bool_or(hit AND n <= 3) AS h3 FROM ranked GROUP BY ALL)
SELECT boost, count(*) FILTER (h1) AS h1, count(*) FILTER (h3) AS h3, row_number() OVER (ORDER BY count(*) FILTER (h1) DESC, count(*) FILTER (h3) DESC, boost) = 1 AS best FROM told GROUP BY boost""")
def boost_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Hits at 1 and 3 for each boost in one plan, with the best one: most hits at 1, then at 3, then the smallest boost."""
    asked, docs, hits, matches = _searched(spark, folder)
    found = search.boost_sweep(hits, asked, docs, matches, [0.2, 0.3, 0.4, 0.5]).join(table(spark, folder, "documents").select("doc_id", (F.col("lang") == "en").alias("hit")), "doc_id")
    each = found.groupBy("boost", "query_id").agg(F.max(F.col("hit") & (F.col("rank") < 1)).alias("h1"), F.max(F.col("hit") & (F.col("rank") < 3)).alias("h3"))
    rows = written(each.groupBy("boost").agg(F.count_if("h1").alias("h1"), F.count_if("h3").alias("h3")), "sweep")
    return rows.join(evaluation.best(rows, "boost", "h1", "h3").select("boost", F.lit(True).alias("best")), "boost", "left").na.fill(False, ["best"])


@query("""WITH c AS (SELECT o_custkey % 10 + 1 AS top_k, count(*) FILTER (o_orderstatus = 'F') AS h1 FROM orders GROUP BY 1) SELECT coalesce(min(top_k) FILTER (h1 >= 9), 10) AS top_k, (SELECT bool_and(h1 > 3) FROM c) AS ok, (SELECT sum(h1) // count(*) FROM c)::BIGINT AS mean_h1 FROM c""")
def smallest_enough(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").groupBy((F.col("o_custkey") % 10 + 1).alias("top_k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("h1"))
    mean = rows.agg(evaluation.floor_average(F.sum("h1"), F.count("*")).alias("mean_h1"))
    return evaluation.smallest_enough(rows, "top_k", "h1", 9, 10).crossJoin(evaluation.all_ok(rows.select((F.col("h1") > 3).alias("ok")))).crossJoin(mean)  # one row each


@query(f"""WITH {base.BM25}, {base._ranks("scored", 8, "best")},
named AS (SELECT b.query_id, b.doc_id, b.rank, CASE WHEN doc_id % 10 > 0 THEN source ELSE '' END AS name, CASE WHEN doc_id % 4 > 0 THEN source END AS folder, text FROM best b JOIN documents d USING (doc_id)),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN name = '' THEN 'd' || doc_id ELSE 'n' || name END ORDER BY rank) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS n FROM firsts),
laws AS (SELECT source AS own, 'law of ' || source AS law, '제' || doc_id || '조' AS article, text AS content FROM documents WHERE source != 'src3' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12)
SELECT query_id, coalesce(law, CASE WHEN name = '' THEN 'unnamed_' || n ELSE name END) AS name, coalesce(article, '전문') AS article, md5(left(coalesce(content, f.text, ''), 1000)) AS content_md5
FROM numbered f LEFT JOIN laws ON own = CASE WHEN name != '' THEN coalesce(folder, name) END""")
def law_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hits = bm25.search(base._asked(spark, folder), docs.select("doc_id", "text"), 8, index=base._index(spark, folder))
    named = docs.select("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("source")).otherwise("").alias("name"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("folder"), "text")
    first = ingest.newest(docs.where("source != 'src3'").select("source", (-F.col("doc_id")).alias("back"), "doc_id"), 12, "back", "source")
    order = F.array_sort(F.collect_list("doc_id"))
    placed = first.groupBy("source").agg(order.alias("ids")).select("source", F.posexplode("ids").alias("position", "doc_id"))  # twelve at most
    articles = placed.join(docs.select("doc_id", "text"), "doc_id").select(F.col("source").alias("folder"), F.concat(F.lit("law of "), "source").alias("law"), "position", F.concat(F.lit("제"), _text("doc_id"), F.lit("조")).alias("article"), F.col("text").alias("content"))
    return search.law_texts(hits, named, articles).select("query_id", "name", "article", F.md5("content").alias("content_md5"))


@query(r"""WITH q(query_id, ks) AS (VALUES (1, ['stupid', 'casino']), (2, ['keit', 'und']), (3, ['no such words']), (4, ['the'])),
found AS (SELECT query_id, ks, doc_id, source, text, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS rank FROM q, documents d WHERE list_bool_or(list_transform(ks, lambda k: contains(lower(coalesce(d.text, '')), k))) QUALIFY rank < 10),
lines AS (SELECT query_id, ks, doc_id, rank, source, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM found),
hits AS (SELECT *, list_bool_or(list_transform(ks, lambda k: contains(lower(s), k))) AS hit FROM lines),
near AS (SELECT *, max(hit) OVER (PARTITION BY query_id, doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS shown FROM hits),
kept AS (SELECT *, lag(n) OVER (PARTITION BY query_id, doc_id ORDER BY n) AS before FROM near WHERE shown),
texts AS (SELECT query_id, doc_id, rank, source, string_agg(CASE WHEN before IS NOT NULL AND n > before + 1 THEN '--' || chr(10) ELSE '' END || source || CASE WHEN hit THEN ':' ELSE '-' END || n || CASE WHEN hit THEN ':' ELSE '-' END || s, chr(10) ORDER BY n) AS t FROM kept GROUP BY ALL),
bare AS (SELECT query_id, rank, source, list_filter(list_transform(string_split(left(array_to_string(string_split(t, chr(10))[1:25], chr(10)), 1500), chr(10)), lambda l: regexp_replace(regexp_replace(l, '^[^:]+[-:](\d+)[-:](.*)$', '\2'), '^\s+|\s+$', '', 'g')), lambda l: l != '') AS ls FROM texts),
cited AS (SELECT query_id, count(*) AS n, md5(string_agg(source || '|법령|' || left(array_to_string(ls, ' · '), 400), chr(10) ORDER BY rank)) AS m FROM bare GROUP BY query_id)
SELECT query_id, CAST(coalesce(n, 0) AS INTEGER) AS cited, CAST(CASE WHEN n > 0 THEN round(least(0.95, 0.6 + 0.04 * n), 3) ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN n >= 3 THEN 'applies' WHEN n > 0 THEN 'ambiguous' ELSE 'does_not_apply' END AS verdict, m AS citations_md5 FROM q LEFT JOIN cited USING (query_id)""")  # fmt: skip
def grep_citations(spark: SparkSession, folder: str) -> DataFrame:
    """What answers where the search itself fails: matching documents, their excerpts as citations, and a confidence by their number."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    asked = spark.createDataFrame([(1, "stupid | casino"), (2, "keit OR und"), (3, "no such words"), (4, "the")], "query_id int, query string")
    asked = asked.select("query_id", grep.parse(F.col("query")).alias("p")).select("query_id", F.when(F.col("query_id") == 3, F.array(F.lit("no such words"))).otherwise(F.col("p.keywords")).alias("keywords"), "p.mode")
    hits = written(grep.search(docs, asked, 10), "grep")
    joined = hits.join(asked, "query_id").join(docs, "doc_id").withColumn("place", F.struct("query_id", "rank", "source"))
    lines = grep.context(joined, F.col("keywords"), key="place", name=F.col("source"))
    found = fusion.fallback(asked, lines.select("place.query_id", "place.rank", F.col("place.source").alias("name"), F.lit(None).cast("string").alias("kind"), "excerpt"))
    shown = F.transform("citations", lambda c: F.concat_ws("|", c["law_name"], c["article"], c["excerpt"]))
    return found.select("query_id", F.size("citations").alias("cited"), "confidence", "verdict", F.when(F.size("citations") > 0, F.md5(F.concat_ws("\n", shown))).alias("citations_md5"))


# ---- reports and ingestion


@query(f"""WITH {base.BM25}, {base._ranks("scored", 5, "best")}
SELECT query_id, doc_id, (d.source = 'src' || (query_id % 20) OR starts_with(d.source, 'src' || (query_id % 20) || ' ')) AND contains(coalesce(d.text, ''), left(b.text, 20)) AND contains(coalesce(d.text, ''), ' ') AS hit FROM best JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id""")
def strict_hits(spark: SparkSession, folder: str) -> DataFrame:
    asked, docs = base._asked(spark, folder), table(spark, folder, "documents").select("doc_id", "text", "source")
    found = bm25.search(asked, docs.select("doc_id", "text"), 5, index=base._index(spark, folder)).join(docs, "doc_id").join(asked, "query_id")
    hit = evaluation.strict_hit(F.col("source"), F.col("text"), F.col("wanted"), F.array(F.substring("query", 1, 20), F.lit(" ")))
    return found.select("query_id", "doc_id", hit.alias("hit"))


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2""")
def newest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.newest(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 2, "o_orderdate", "o_custkey").select("o_custkey", "o_orderkey")


@query("""SELECT DISTINCT source AS folder FROM documents WHERE doc_id % 3 > 0 AND source IN (SELECT source FROM documents WHERE lang = 'en')""")
def changed_paths(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = _choice(F.col("doc_id"), F.concat(F.lit("docs/"), "source", F.lit("/x.md")), F.concat(F.lit(" kr/"), "source", F.lit("/x.md")), F.concat(F.lit("kr//"), "source", F.lit("/y/z.md")))
    return ingest.changed_folders(docs.select(path.alias("path")).unionByName(docs.select(F.lit("kr/a/b.txt").alias("path"))), docs.where("lang = 'en'").select(F.col("source").alias("folder")).distinct())


@query("""SELECT d.doc_id, l.quality AS one_answer, CAST(p.page_id AS INTEGER) AS two_answer, l.toxic AS score FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id""")
def systems_compared(spark: SparkSession, folder: str) -> DataFrame:
    labels, pages = table(spark, folder, "labels"), table(spark, folder, "pages")
    found = evaluation.compared(table(spark, folder, "documents").select("doc_id"), labels.select("doc_id", F.col("quality").alias("answer")), pages.select(F.col("page_id").alias("doc_id"), F.col("page_id").cast("int").alias("answer")), labels.select("doc_id", F.col("toxic").alias("score")), "doc_id")
    return found.select("doc_id", "one_answer", "two_answer", "score")


@query("""WITH e AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS n, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, 'e' || turn AS event_id, CAST(n AS INTEGER) AS tokens_in, CASE WHEN upto > 300 THEN 'tokens_in' END AS exceeded FROM e""")
def trajectory_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as logs of JSON lines, read back, with the cap that is crossed up to each event."""
    n = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int")
    named = lambda c: F.concat(F.lit("e"), c.cast("string"))
    events = table(spark, folder, "conversations").select(
        _text("conv_id").alias("trajectory_id"), named(F.col("turn")).alias("event_id"), F.when(F.col("turn") > 0, named(F.col("turn") - 1)).alias("parent_event_id"), F.lit("root_prompt").alias("kind"), F.lit(0).alias("depth"),
        F.col("turn").cast("double").alias("ts_ms"), F.to_json(F.struct("text")).alias("payload"), n.alias("tokens_in"), F.lit(0).alias("tokens_out"),
    )
    back = trajectories.parsed(trajectories.lines(events))
    return trajectories.over_budget(back, {**trajectories.CAPS, "tokens_in": 300}).select("trajectory_id", "event_id", "tokens_in", "exceeded")


# ---- the rest of the services, answers and functions by name


@query("""WITH w AS (SELECT doc_id, ['헌법', '헌 법', '한정위헌', '위 헌', '기본권', '기본', '권한쟁의', '쟁의', '탄핵', '헌', '정당해산', '해산', ''][doc_id % 13 + 1] AS word, left(coalesce(text, ''), 40) AS t FROM documents)
SELECT doc_id, len(list_filter(['헌법', '헌재', '위헌', '합헌', '헌법불합치', '한정합헌', '한정위헌', '헌법소원', '기본권', '탄핵', '정당해산', '권한쟁의'], lambda k: contains(t || word || t, k))) > 0 AS constitutional FROM w""")
def constitution_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries that hold one of the twelve words somewhere, or nearly do."""
    words = _choice(F.col("doc_id"), "헌법", "헌 법", "한정위헌", "위 헌", "기본권", "기본", "권한쟁의", "쟁의", "탄핵", "헌", "정당해산", "해산", "")
    start = F.substring(F.coalesce("text", F.lit("")), 1, 40)
    return table(spark, folder, "documents").select("doc_id", names.is_constitutional(F.concat(start, words, start)).alias("constitutional"))


@query(r"""WITH l AS (SELECT doc_id, source, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: 'x' || left(s, 50)) AS ls FROM documents),
a AS (SELECT *, 'x' || regexp_replace(ls[2][2:], '\s+$', '') AS two, 'x' || regexp_replace(ls[3][2:], '\s+$', '') AS three FROM l)
SELECT doc_id, md5(concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), CASE WHEN len(ls) >= 2 THEN '[' || source || ' 제2조]' || chr(10) || '##### 제2조 (h)' || chr(10) || two END,
    CASE WHEN len(ls) >= 3 THEN '[' || source || ' 제3조의2]' || chr(10) || '##### 제3조의2 (h)' || chr(10) || three END)) AS bodies_md5, len(ls) AS n FROM a""")
def article_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies of hit articles out of whole laws: one whose longer namesake stands first, one that is there only by its prefix, one of an unknown source."""
    ls = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.concat(F.lit("x"), F.substring(s, 1, 50)))
    heads = F.transform(ls, lambda s, i: F.concat(F.when(i == 1, "##### 제2조의9 (longer)\nlost\n").otherwise(""), F.lit("##### 제"), (i + 1).cast("string"), F.when(i == 2, "조의2").otherwise("조"), F.lit(" (h)\n"), s, F.when(i % 2 == 1, "\n## next chapter\nlost").otherwise("")))
    docs = table(spark, folder, "documents").select("doc_id", "source", F.size(ls).cast("long").alias("n"), F.array_join(heads, "\n").alias("law"))
    hit = lambda label, article: F.struct(label.alias("label"), F.lit(article).alias("article"))
    hits = F.array(hit(F.col("source"), "제2조"), hit(F.lit("none"), "제1조"), hit(F.col("source"), "제3조의2"), hit(F.col("source"), "제3조"))
    return docs.select("doc_id", F.md5(documents.article_bodies(hits, F.create_map("source", "law"))).alias("bodies_md5"), "n")


@query("""WITH d AS (SELECT doc_id, left(coalesce(text, ''), 200) || ' 제' || (doc_id % 30) || '조의2 and 제' || (doc_id % 7) || '조 ' || source AS t, source FROM documents),
k AS (SELECT doc_id, t, [['제' || (doc_id % 7) || '조 (목적)', '제' || (doc_id % 7) || '조'], ['제' || (doc_id % 30) || '조', '제' || (doc_id % 30) || '조'], ['제999조', '제999조'], [source, source], ['부칙', '부칙']] AS wanted FROM d)
SELECT doc_id, array_to_string(list_transform(list_filter(wanted, lambda p: contains(t, p[2])), lambda p: p[1]), '|') AS hits FROM k""")
def article_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Gold articles by the number in them, or by their whole name where they have none, in answers made of documents."""
    a, b = (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 30).cast("string")
    text = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit(" 제"), b, F.lit("조의2 and 제"), a, F.lit("조 "), F.col("source"))
    wanted = F.array(F.concat(F.lit("제"), a, F.lit("조 (목적)")), F.concat(F.lit("제"), b, F.lit("조")), F.lit("제999조"), F.col("source"), F.lit("부칙"))
    return table(spark, folder, "documents").select("doc_id", F.concat_ws("|", T.hit_articles(text, wanted)).alias("hits"))


@query("""SELECT doc_id, md5(CASE WHEN quality = 1 AND coalesce(text, '') != '' THEN text WHEN coalesce(source, '') != '' AND doc_id % 5 > 0 THEN source ELSE '' END) AS text_md5 FROM documents LEFT JOIN labels USING (doc_id)""")
def detail_or_item(spark: SparkSession, folder: str) -> DataFrame:
    """The detail's text where the detail came and has one, else the listed item's, else nothing."""
    details = table(spark, folder, "labels").select("doc_id", "quality").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("text")).otherwise("").alias("detail"))
    items = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("item"))
    return items.join(details, "doc_id", "left").select("doc_id", F.md5(envelopes.merged(F.col("detail"), F.col("item"))).alias("text_md5"))


@query("""SELECT conv_id, count(*) AS cycles, CAST(sum(length(text)) AS BIGINT) AS tokens_in, CAST(sum(turn) FILTER (turn > 0) AS BIGINT) AS tokens_out, CAST(round_even(sum(CAST(length(text) AS DECIMAL(18, 6)) / 1000000 * 3), 4) AS DOUBLE) AS usd FROM conversations GROUP BY conv_id""")
def tokens_per_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and cost of each answer, over its cycles of model calls."""
    rows = table(spark, folder, "conversations").select("conv_id", F.length("text").alias("tokens_in"), F.when(F.col("turn") > 0, F.col("turn")).alias("tokens_out"), (F.length("text").cast("decimal(18,6)") / 1_000_000 * 3).alias("usd"))
    found = trajectories.answer_totals(rows, "conv_id")
    return found.withColumn("tokens_out", F.nullif("tokens_out", F.lit(0)))


@query("""WITH c AS (SELECT c_nationkey AS reply, c_custkey AS k, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT reply, CAST(k AS VARCHAR) AS law_id, CASE WHEN k % 3 = 0 THEN '' ELSE c_name END AS law_name, c_mktsegment AS law_type, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE k % 100 END AS INTEGER) AS score,
    CASE WHEN k % 2 = 0 THEN 'l' || k || ':' || CASE WHEN k % 4 = 0 THEN '' ELSE 's' END ELSE '' END AS articles FROM c WHERE n <= 5 AND reply % 5 < 3""")
def law_metas(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of a metadata service: five of many results, missing scores and snippets, a flat payload, one that is cut off."""
    k = F.col("c_custkey")
    article = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("l"), _text("c_custkey")).alias("label"), F.when(k % 4 != 0, "s").alias("snippet"))))
    item = F.struct(k.alias("law_id"), F.when(k % 3 != 0, F.col("c_name")).alias("law_name"), F.col("c_mktsegment").alias("law_type"), F.when(k % 4 != 0, k % 100).alias("score"), article.alias("matched_articles"))
    listed = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("reply")).agg(F.array_sort(F.collect_list(item)).alias("results"))  # by law_id
    whole = F.to_json(F.struct(F.struct("results", F.lit(9).alias("total")).alias("data")))
    payload = F.when(F.col("reply") % 5 < 3, whole).when(F.col("reply") % 5 == 3, F.to_json(F.struct("results"))).otherwise(F.substring(whole, 1, 30))
    found = listed.select("reply", F.explode(envelopes.law_metas(payload, 5)).alias("x")).select("reply", "x.*")
    shown = F.transform("articles", lambda a: F.concat(a["label"], F.lit(":"), a["snippet"]))
    return found.select("reply", "law_id", "law_name", "law_type", "score", F.concat_ws(",", shown).alias("articles"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier)
SELECT ['law', 'prec', 'expc', 'detc', 'decc', 'admrul', 'ordin'][s_nationkey % 7 + 1] AS target, CAST(k AS VARCHAR) AS id, s_name AS title, CASE WHEN k % 2 = 0 THEN s_nationkey || ' · b' ELSE 'b' END AS subtitle, '20260101' AS date,
    CASE WHEN k % 3 = 0 THEN 'https://site/' || k ELSE 'http://x' END AS url FROM s WHERE (m > 1 OR s_nationkey % 2 = 0) AND s_nationkey % 9 < 7""")
def search_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of all seven services in one table, one item or many in each, some cut off: a parse for each payload, a plan for all."""
    k, items = F.col("s_suppkey"), []
    for t in envelopes.TARGETS.values():
        fields = [_text("s_suppkey").alias(t.number), F.col("s_name").alias(t.title), F.when(k % 2 == 0, _text("s_nationkey")).otherwise("").alias(t.subtitle[0]), F.lit("b").alias(t.subtitle[1]), F.lit("20260101").alias(t.date),
                  F.when(k % 3 == 0, F.concat(F.lit("/"), _text("s_suppkey"))).otherwise("http://x").alias(t.link)]
        items.append(F.to_json(F.struct(*fields)))
    number, own = F.col("s_nationkey") % 7, F.element_at(F.array(*items), (F.col("s_nationkey") % 7 + 1).cast("int"))
    rows = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(own)).alias("own"))
    inner = F.when((F.size("own") == 1) & (F.col("s_nationkey") % 2 == 0), F.col("own")[0]).when(F.size("own") == 1, F.lit('"none"')).otherwise(F.concat(F.lit("["), F.concat_ws(",", "own"), F.lit("]")))
    front = _choice(number, *['{"' + '":{"'.join(t.path) + '":' for t in envelopes.TARGETS.values()])
    payload = F.concat(front, inner, F.when(F.col("s_nationkey") % 9 < 7, F.repeat(F.lit("}"), _choice(number, *[len(t.path) for t in envelopes.TARGETS.values()]))).otherwise("]"))
    return envelopes.search_mixed(rows.select(_choice(number, *envelopes.TARGETS).alias("target"), payload.alias("payload")), "https://site")


@query(rf"""WITH {NODES} SELECT doc_id, md5(nfc_normalize(title)) AS title_md5, CAST(kind + 1 AS INTEGER) AS level FROM node""")
def functions_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """A table function and a function of the registry, both called by name."""
    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.concat(F.element_at(F.array(*map(F.lit, ("# h ", "## h ", "### h ", "b "))), i % 4 + 1), s))
    docs = table(spark, folder, "documents").select("doc_id", F.concat_ws("\n", marked).alias("text"))
    return named.rows(spark, "headings_of", docs, "text", "doc_id").select("doc_id", F.md5(named.call("nfc", F.col("title"))).alias("title_md5"), "level")


@query("SELECT (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS ingested, (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS skipped")
def ingest_observed(spark: SparkSession, folder: str) -> DataFrame:
    """What an insert added and skipped, counted while it wrote."""
    told = ingest.insert(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", F.col("doc_id"), new_path(spark, "inserted"))
    return spark.createDataFrame([(told["ingested"], told["skipped"])], "ingested long, skipped long")


def _parts(spark: SparkSession, folder: str, run, parts: list[Column]) -> DataFrame:
    """Runs a stream over the events' parts, which come one after the other: run(stream, target, checkpoint) each time; then the target."""
    base, events = new_path(spark, "stream"), table(spark, folder, "events")
    for number, part in enumerate(parts):
        events.where(part).write.parquet(f"{base}/in/{number}")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in/*")
        run(source, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out")


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY ALL")
def stream_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """Events in three batches, of which two repeat a part of the others: each event once, and the target is never read."""
    keys = [F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0, F.col("event_id") % 2 == 0]
    found = _parts(spark, folder, lambda s, out, at: state.unseen_into(s, out, at, "event_id"), keys)
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("""WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'purchase' GROUP BY ALL),
one AS (SELECT event_id, user_id, ts FROM events LEFT JOIN m USING (user_id) WHERE event_id % 2 = 0 AND (mark IS NULL OR ts > mark)),
higher AS (SELECT user_id, max(ts) AS mark FROM (SELECT user_id, mark AS ts FROM m UNION ALL SELECT user_id, ts FROM one) GROUP BY ALL)
SELECT event_id, user_id FROM one UNION ALL SELECT event_id, user_id FROM events LEFT JOIN higher USING (user_id) WHERE event_id % 2 = 1 AND (mark IS NULL OR ts > mark)""")
def stream_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Events in two batches against marks that the first one raises: what comes late in the second is dropped."""
    events = table(spark, folder, "events")
    marks = incremental.marks_of(events.where("event_type = 'purchase'"), "user_id", "ts")
    found = _parts(spark, folder, lambda s, out, at: state.start_newer(s, "user_id", "ts", out, at, marks), [F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1])
    return found.select("event_id", "user_id")
