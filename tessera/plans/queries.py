"""The library's queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, cells, evaluation, fusion, grams, grep, ingest, names, trees, vectors
from tessera.plans import search
from tessera.plans.registry import query, table
from tessera.sources.tables import new_path, shared_folder, written
from tessera.streaming import incremental

# ---- tokens and BM25

TOKENS = r"""
words AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-zA-Z0-9]{2,}') AS ws FROM src),
tokens AS (SELECT * EXCLUDE (ws), CASE WHEN len(ws) = 0 THEN ['_empty_'] ELSE ws || flatten(list_transform(list_filter(ws, lambda w: len(w) >= 2),
    lambda w: list_transform(range(1, len(w)), lambda i: w[i:i + 1]))) END AS ts FROM words)"""


@query(f"WITH src AS (SELECT doc_id, text FROM documents), {TOKENS} SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(ts, lambda t: len(t))) AS BIGINT) AS n_chars FROM tokens")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = bm25.busy(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", T.tokenize(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.length(F.array_join("ts", "")).cast("long").alias("n_chars"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("wanted"))


BM25 = rf"""
src AS (SELECT doc_id AS id, text, FALSE AS asked FROM documents UNION ALL SELECT item_id, text, TRUE FROM benchmark), {TOKENS},
each AS (SELECT id, asked, unnest(ts) AS term FROM tokens),
post AS (SELECT id AS doc_id, term, count(*) AS tf FROM each WHERE NOT asked GROUP BY ALL),
lens AS (SELECT id AS doc_id, len(ts) AS dl FROM tokens WHERE NOT asked),
sizes AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, sizes GROUP BY term, n),
stats AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
want AS (SELECT id AS query_id, term, count(*) AS times FROM each WHERE asked GROUP BY ALL),
shared AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM want JOIN stats USING (term) JOIN post USING (term) JOIN lens USING (doc_id), sizes GROUP BY ALL),
scored AS (SELECT item_id AS query_id, d.doc_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN shared s ON s.query_id = item_id AND s.doc_id = d.doc_id)"""


def _ranks(source: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM {source} QUALIFY rank < {k})"


FACETS = ["source", "lang", "n_chars"]


def _index(spark: SparkSession, folder: str) -> bm25.Index:
    """The index of these documents, kept in the shared folder under their files' checksum."""
    return bm25.kept(table(spark, folder, "documents"), f"{shared_folder(spark)}/tessera", facets=FACETS)


@query(f"WITH {BM25}, {_ranks('scored', 5, 'best')} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best")
def bm25_top5(spark: SparkSession, folder: str) -> DataFrame:
    found = bm25.search(_asked(spark, folder), table(spark, folder, "documents").select("doc_id", "text"), 5, index=_index(spark, folder))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


KEPT = "kept AS (SELECT s.* FROM scored s JOIN documents d USING (doc_id) WHERE d.source = 'src' || (query_id % 20) AND d.lang = 'fr')"


@query(f"WITH {BM25}, {KEPT}, {_ranks('kept', 5, 'best')} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best")
def bm25_filtered(spark: SparkSession, folder: str) -> DataFrame:
    found = bm25.top(_asked(spark, folder), _index(spark, folder), 5, equal=("source", "wanted"), where=lambda f: f["lang"] == "fr")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {BM25}, {KEPT.replace("d.lang = 'fr'", "d.lang = 'fr' AND d.n_chars > 3000")}, {_ranks('kept', 5, 'a')}, {_ranks('scored', 5, 'b')},
held AS (SELECT query_id, count(*) AS n FROM a GROUP BY ALL),
both_ AS (SELECT *, 0 AS part FROM a UNION ALL SELECT b.*, 1 FROM b ANTI JOIN a USING (query_id, doc_id) WHERE coalesce((SELECT n FROM held WHERE held.query_id = b.query_id), 0) < 5)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, rank) - 1 AS INTEGER) AS rank FROM both_""")
def bm25_fallback_merge(spark: SparkSession, folder: str) -> DataFrame:
    asked, index = _asked(spark, folder), _index(spark, folder)
    named = bm25.top(asked, index, 5, equal=("source", "wanted"), where=lambda f: (f["lang"] == "fr") & (f["n_chars"] > 3000))
    found = bm25.with_fallback(named, bm25.top(asked, index, 5))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# ---- vectors, fusion, order, citations

DISTANCES = """
pairs AS (SELECT q.vec_id // 100 AS query_id, v.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) - 1 AS rank FROM pairs QUALIFY rank < 20)"""


def _near(spark: SparkSession, folder: str, k: int = 20) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, held against all rows."""
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("qvec"))
    return vectors.nearest(asked, rows.withColumnRenamed("vec_id", "doc_id"), k, key="doc_id")


@query(f"WITH {DISTANCES} SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near")
def vector_top20(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


def _cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, cells.Index]:
    """Every hundredth vector as a query, all vectors, and their index of cells."""
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = rows.where("doc_id % 100 = 0").select((F.col("doc_id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("qvec"))
    return asked, rows, cells.build(rows, 64, key="doc_id")


@query(f"WITH {DISTANCES} SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near")
def vector_cells_all(spark: SparkSession, folder: str) -> DataFrame:
    """The index of cells with every cell looked into: the exact result."""
    asked, _, index = _cells(spark, folder)
    return cells.nearest(asked, index, 20, len(index.centres)).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT count(*) AS queries, 20 AS k, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_cells_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the cells that `probes_for` settles on find nine tenths of the exact twenty nearest, measured over all queries."""
    asked, rows, index = _cells(spark, folder)
    right = written(vectors.nearest(asked, rows, 20, key="doc_id").select("query_id", "doc_id"), "right")
    probes, _ = cells.probes_for(asked, index, rows, 20, right=right)
    found = cells.nearest(asked, index, 20, probes).select("query_id", "doc_id", F.lit(1).alias("hit"))
    told = right.join(found, ["query_id", "doc_id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))
    return asked.agg(F.count("*").alias("queries"), F.lit(20).alias("k")).crossJoin(told)  # one row each


PREFERRED = """held AS (SELECT pairs.*, coalesce(contains(text, CASE WHEN query_id % 2 = 0 THEN 'tion' ELSE 'not in any text' END), FALSE) AS met FROM pairs LEFT JOIN documents d ON d.doc_id = pairs.doc_id),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, met ORDER BY round(distance, 9), doc_id) - 1 AS rank FROM held),
kept_near AS (SELECT query_id, doc_id, distance, rank FROM firsts QUALIFY rank < 20 AND met = max(met) OVER (PARTITION BY query_id))"""


@query(f"WITH {DISTANCES}, {PREFERRED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM kept_near")
def vector_contains_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _near_with_word(spark, folder).select("query_id", "doc_id", "rank")


def _near_with_word(spark: SparkSession, folder: str, k: int = 20) -> DataFrame:
    """The nearest documents that hold the query's word, or of all where none does. Texts stay where they are: each gives a flag for each word."""
    rows, words = table(spark, folder, "embeddings"), ["tion", "not in any text"]
    flags = table(spark, folder, "documents").select("doc_id", F.array(*[F.col("text").contains(w) for w in words]).alias("flags"))
    asked = rows.where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("qvec")).withColumn("word", (F.col("query_id") % 2).cast("int"))
    held = rows.withColumnRenamed("vec_id", "doc_id").join(flags, "doc_id", "left")
    return vectors.nearest(asked, held, k, key="doc_id", flag=("flags", "word"))


FUSED = f"""{BM25}, {_ranks('scored', 20, 'lexical')}, {DISTANCES},
parts AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank + 1) AS s, rank AS place FROM near WHERE query_id IN (SELECT item_id FROM benchmark)
    UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank + 1), 1000 + rank FROM lexical),
sums AS (SELECT query_id, doc_id, sum(s) AS score, min(place) AS place FROM parts GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place, doc_id) - 1 AS rank FROM sums QUALIFY rank < 20)"""
BOOSTED = f"""{FUSED},
raised AS (SELECT f.query_id, f.doc_id, f.score + CASE WHEN d.source = 'src' || (query_id % 20) THEN 0.3 ELSE 0 END AS score, f.rank AS old, d.source, d.text FROM fused f JOIN documents d USING (doc_id)),
boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, old, doc_id) - 1 AS rank FROM raised)"""


def _hybrid(spark: SparkSession, folder: str, **settings) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    near = _near(spark, folder).join(_asked(spark, folder).select("query_id"), "query_id", "left_semi")
    return search.hybrid(_asked(spark, folder), docs, near, matches=fusion.name_matches(F.col("source"), F.col("source"), F.col("wanted")), index=_index(spark, folder), **settings)


@query(f"WITH {FUSED} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    lexical = bm25.search(asked, table(spark, folder, "documents").select("doc_id", "text"), 20, index=_index(spark, folder))
    near = _near(spark, folder).join(asked.select("query_id"), "query_id", "left_semi")
    return fusion.reciprocal_ranks(near, lexical).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {BOOSTED} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM boosted WHERE rank < 5")
def hybrid_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {BOOSTED},
given AS (SELECT b.*, CASE WHEN query_id % 5 = 4 THEN rank WHEN rank = 2 THEN 0 WHEN rank = query_id % 5 THEN 1 WHEN rank = 1 THEN 4 ELSE 100 + rank END AS place FROM boosted b WHERE rank < 5)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS INTEGER) AS rank FROM given""")
def rerank_permutation(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.when(F.col("query_id") % 5 == 4, "no list").otherwise(F.concat(F.lit("ranks: [3, "), (F.col("query_id") % 5 + 1).cast("string"), F.lit(", 1000, 9, 2] of five")))
    orders = _asked(spark, folder).select("query_id", T.rank_list(reply).alias("order"))
    return _hybrid(spark, folder, orders=orders).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {BOOSTED},
firsts AS (SELECT query_id, round(least(1.0, score / 0.033), 3) AS confidence FROM boosted WHERE rank = 0)
SELECT b.query_id, CAST(b.rank AS INTEGER) AS rank, b.source AS law_id, '§' || b.doc_id AS article, '20260401' AS version, md5(replace(left(b.text, 400), chr(10), ' ')) AS excerpt_md5,
    confidence, CASE WHEN confidence >= 0.7 THEN 'applies' WHEN confidence >= 0.4 THEN 'ambiguous' ELSE 'does_not_apply' END AS verdict
FROM boosted b JOIN firsts USING (query_id) WHERE b.rank < 5""")
def citations_verdict(spark: SparkSession, folder: str) -> DataFrame:
    asked, docs = _asked(spark, folder), table(spark, folder, "documents").select("doc_id", "text", "source")
    hits = written(_hybrid(spark, folder), "hits")
    rows = hits.join(docs, "doc_id").join(fusion.verdicts(asked, hits), "query_id")
    article = F.concat(F.lit("제"), F.col("doc_id").cast("string"), F.lit("조의2"))
    rows = rows.withColumn("c", fusion.citation(F.col("source"), F.col("source"), article, F.lit("2026-04-01"), F.col("text")))
    return rows.select("query_id", "rank", "c.law_id", "c.article", "c.version", F.md5("c.excerpt").alias("excerpt_md5"), "confidence", "verdict")


@query(f"""WITH {BM25}, {_ranks('scored', 20, 'lexical')}, {DISTANCES},
ks AS (SELECT unnest([30.0, 60.0, 100.0]) AS k),
parts AS (SELECT k, query_id, doc_id, 1.0::DOUBLE / (k + rank + 1) AS s, rank AS place FROM near, ks WHERE query_id IN (SELECT item_id FROM benchmark)
    UNION ALL SELECT k, query_id, doc_id, 1.0::DOUBLE / (k + rank + 1), 1000 + rank FROM lexical, ks),
sums AS (SELECT k, query_id, doc_id, sum(s) AS score, min(place) AS place FROM parts GROUP BY ALL)
SELECT CAST(k AS DOUBLE) AS k, query_id, doc_id, CAST(row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 12) DESC, place, doc_id) - 1 AS INTEGER) AS rank FROM sums QUALIFY rank < 5""")
def constant_sweep(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    lexical = written(bm25.search(asked, table(spark, folder, "documents").select("doc_id", "text"), 20, index=_index(spark, folder)), "lexical")
    near = written(_near(spark, folder).join(asked.select("query_id"), "query_id", "left_semi"), "near")
    return search.sweep(near, lexical, [30.0, 60.0, 100.0]).select("k", "query_id", "doc_id", "rank")


# ---- names, keywords, grep

ALIASES = [("mentra", 0), ("tion", 1), ("keit", 2), ("ment", 3), ("ción", 4)]


@query("""WITH a(name, o) AS (VALUES ('mentra', 0), ('tion', 1), ('keit', 2), ('ment', 3), ('ción', 4))
SELECT doc_id, (SELECT min_by(name, o) FROM a WHERE contains(d.text, a.name)) AS detected FROM documents d""")
def detect_first_alias(spark: SparkSession, folder: str) -> DataFrame:
    return names.detect(table(spark, folder, "documents").select("doc_id", "text"), spark.createDataFrame(ALIASES, "name string, ordinal int"), text="text").select("doc_id", "detected")


def _grep_sql(mode: str) -> str:
    holds = "list_bool_and" if mode == "AND" else "list_bool_or"
    return f"""WITH q(query_id, ks) AS (VALUES (1, ['the', 'CASINO']), (2, ['der', 'keit', 'und']), (3, ['stupid', 'de', 'tion']))
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS INTEGER) AS rank
FROM q, documents d WHERE {holds}(list_transform(ks, lambda k: contains(lower(coalesce(d.text, '')), lower(k)))) QUALIFY rank < 100"""


def _grep(spark: SparkSession, folder: str, sign: str) -> DataFrame:
    asked = spark.createDataFrame([(1, f"the{sign}CASINO"), (2, f"der{sign}keit{sign}und"), (3, f"stupid{sign}de{sign}tion")], "query_id int, query string")
    parsed = asked.select("query_id", grep.parse(F.col("query")).alias("p")).select("query_id", "p.keywords", "p.mode")
    return grep.search(table(spark, folder, "documents"), parsed, 100)


@query(_grep_sql("AND"))
def grep_and(spark: SparkSession, folder: str) -> DataFrame:
    return _grep(spark, folder, " ")


@query(_grep_sql("OR"))
def grep_or(spark: SparkSession, folder: str) -> DataFrame:
    return _grep(spark, folder, " OR ")


def _grams(spark: SparkSession, folder: str, sign: str, scoped: bool) -> DataFrame:
    """`_grep` by the index of grams; scoped: held to folders, but for the second query."""
    asked = spark.createDataFrame([(1, f"the{sign}CASINO", ["src1", "src2", "src3"]), (2, f"der{sign}keit{sign}und", None), (3, f"stupid{sign}de{sign}tion", ["src4", "no such"])], "query_id int, query string, folders array<string>")
    parsed = asked.select("query_id", grep.parse(F.col("query")).alias("p"), F.col("folders") if scoped else F.lit(None).cast("array<string>").alias("folders")).select("query_id", "p.keywords", "p.mode", "folders")
    docs = table(spark, folder, "documents")
    return grams.search(grams.kept(docs, f"{shared_folder(spark)}/tessera", folder="source"), docs, parsed, 100)


@query(_grep_sql("AND"))
def grep_indexed_and(spark: SparkSession, folder: str) -> DataFrame:
    return _grams(spark, folder, " ", False)


@query(_grep_sql("OR"))
def grep_indexed_or(spark: SparkSession, folder: str) -> DataFrame:
    return _grams(spark, folder, " OR ", False)


@query(_grep_sql("OR").replace("FROM q, documents d WHERE", "FROM q, documents d WHERE (query_id = 2 OR list_contains(CASE query_id WHEN 1 THEN ['src1', 'src2', 'src3'] ELSE ['src4'] END, d.source)) AND"))
def grep_in_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Searches held to folders of the corpus, by the index of grams."""
    return _grams(spark, folder, " OR ", True)


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
hits AS (SELECT *, contains(lower(s), 'stupid') OR contains(lower(s), 'casino') AS hit FROM lines),
near AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS shown FROM hits),
kept AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM near WHERE shown),
texts AS (SELECT doc_id, string_agg(CASE WHEN before IS NOT NULL AND n > before + 1 THEN '--' || chr(10) ELSE '' END || n || CASE WHEN hit THEN ':' ELSE '-' END || s, chr(10) ORDER BY n) AS t FROM kept GROUP BY doc_id)
SELECT doc_id, md5(left(array_to_string(string_split(t, chr(10))[1:25], chr(10)), 1500)) AS excerpt_md5 FROM texts""")
def grep_context(spark: SparkSession, folder: str) -> DataFrame:
    return grep.context(table(spark, folder, "documents"), F.array(F.lit("stupid"), F.lit("casino"))).select("doc_id", F.md5("excerpt").alias("excerpt_md5"))


@query(r"""SELECT page_id, md5(t) AS cleaned_md5, CAST(length(t) AS INTEGER) AS n FROM (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def html_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.strip_html(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("cleaned_md5"), F.length("t").alias("n"))


# ---- tables kept current

@query("SELECT doc_id, source FROM documents d ANTI JOIN labels l USING (doc_id)")
def ingest_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.new_rows(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", F.col("doc_id")).select("doc_id", "source")


@query("SELECT doc_id, lang, n_chars FROM documents d ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'labelled', CAST(quality AS BIGINT) FROM labels")
def upsert_by_key(spark: SparkSession, folder: str) -> DataFrame:
    incoming = table(spark, folder, "labels").select("doc_id", F.lit("labelled").alias("lang"), F.col("quality").cast("long").alias("n_chars"))
    return ingest.upsert(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), incoming, "doc_id", F.col("lang"))


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return old, old.where("o_orderstatus != 'P'").withColumn("o_orderstatus", F.when(F.col("o_custkey") < 100, F.lit("X")).otherwise(F.col("o_orderstatus")))


@query("""WITH new AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus != 'P' GROUP BY ALL), old AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT old.o_custkey, CASE WHEN new.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old LEFT JOIN new USING (o_custkey) WHERE new.n IS NULL OR new.n != old.n OR o_custkey < 100""")
def delta_groups(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.changed_groups(*_orders(spark, folder), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus != 'P'")
def delta_refresh(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.refreshed(*_orders(spark, folder), "o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH marks AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT event_id, user_id FROM events LEFT JOIN marks USING (user_id) WHERE mark IS NULL OR ts > mark""")
def hwm_filter(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return incremental.above_mark(events, incremental.marks_of(events.where("event_type = 'purchase'"), "user_id", "ts"), "user_id", "ts").select("event_id", "user_id")


@query(r"""SELECT CAST(conv_id AS VARCHAR) AS agent_id, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, md5(concat_ws(chr(10) || chr(10), nullif(c, ''), 'Attachments:' || chr(10) || 'u' || turn || chr(10) || 'second', 'Embed title: only a title' || chr(10) || 'Embed title: t' || chr(10) || 'Embed description: d')) AS content_md5
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM conversations)""")
def message_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        "conv_id", F.col("text").alias("content"), F.lit("2026-05-06T12:00:00+00:00").alias("timestamp"), F.struct((F.col("role") == "assistant").alias("bot")).alias("author"),
        F.array(F.struct(F.concat(F.lit(" u"), F.col("turn").cast("string")).alias("url")), F.struct(F.lit("second").alias("url")), F.struct(F.lit(" ").alias("url"))).alias("attachments"),
        F.array(F.struct(F.lit("only a title").alias("title"), F.lit(None).cast("string").alias("description")), F.struct(F.lit("t ").alias("title"), F.lit("d").alias("description"))).alias("embeds"),
    )
    return incremental.message_rows(rows, F.col("conv_id").cast("string")).select("agent_id", "role", F.md5("content").alias("content_md5"))


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY ALL")
def stream_append(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream into a table, twice from the start: the replay adds nothing."""
    base = new_path(spark, "stream")
    schema = table(spark, folder, "events").schema
    for run in range(2):
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        incremental.stream_into(source, f"{base}/table", f"{base}/checkpoint-{run}", "event_id").awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


# ---- hierarchies

def _hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    region, nation, customer, orders = (table(spark, folder, n) for n in ("region", "nation", "customer", "orders"))
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child"))
        .union(customer.select(node("n", "c_nationkey"), node("c", "c_custkey"))).union(orders.select(node("c", "o_custkey"), node("o", "o_orderkey"))))


@query("""WITH RECURSIVE links AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
down AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, child, depth + 1 FROM down JOIN links ON parent = node)
SELECT root, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM down GROUP BY ALL""")
def subtree_collect(spark: SparkSession, folder: str) -> DataFrame:
    roots = table(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return trees.descendants(_hierarchy(spark, folder), roots).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM orders)
SELECT o_custkey, o_orderkey FROM s WHERE upto <= 700000""")
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return trees.within_budget(table(spark, folder, "orders"), F.round("o_totalprice").cast("long"), 700_000, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT c_nationkey AS k, 3 AS level FROM customer UNION ALL SELECT n_nationkey, 2 FROM nation UNION ALL SELECT c_nationkey, 5 FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(k AS INTEGER) AS doc_id, count(*) AS nodes, count(*) FILTER (level = 5) AS articles, max(level) AS max_depth FROM n GROUP BY k""")
def tree_stats(spark: SparkSession, folder: str) -> DataFrame:
    nation, customer, orders = (table(spark, folder, n) for n in ("nation", "customer", "orders"))
    level = lambda k, n: [F.col(k).alias("doc_id"), F.lit(n).alias("level"), trees.level_name(F.lit(n)).alias("level_name")]
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return trees.statistics(customer.select(*level("c_nationkey", 3)).union(nation.select(*level("n_nationkey", 2))).union(placed.select(*level("c_nationkey", 5))))


# ---- reports

@query(f"""WITH {BM25}, {_ranks('scored', 5, 'best')},
hit AS (SELECT query_id, rank, contains(d.text, left(b.text, 60)) AS h FROM best JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id)
SELECT item_id AS query_id, coalesce(bool_or(h AND rank < 1), FALSE) AS hit_at_1, coalesce(bool_or(h AND rank < 3), FALSE) AS hit_at_3 FROM benchmark LEFT JOIN hit ON query_id = item_id GROUP BY item_id""")
def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    asked, docs = _asked(spark, folder), table(spark, folder, "documents").select("doc_id", "text")
    found = bm25.search(asked, docs, 5, index=_index(spark, folder)).join(docs, "doc_id").join(asked.select("query_id", "query"), "query_id")
    hits = found.withColumn("hit", evaluation.loose_hit(F.col("text"), F.array(F.substring("query", 1, 60))))
    return evaluation.hits_at(hits, asked, "hit", [1, 3])


@query(f"""WITH {BOOSTED},
runs AS (SELECT 'vector' AS mode, query_id, doc_id, rank FROM near UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM lexical UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM boosted),
hit AS (SELECT mode, query_id, min(rank) AS best FROM runs JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE contains(d.text, left(b.text, 60)) GROUP BY ALL)
SELECT m.mode, count(*) AS n, count(*) FILTER (best < 1) AS hits_at_1, count(*) FILTER (best < 3) AS hits_at_3 FROM benchmark CROSS JOIN (VALUES ('vector'), ('bm25'), ('hybrid')) m(mode) LEFT JOIN hit h ON h.mode = m.mode AND query_id = item_id GROUP BY m.mode""")
def regression_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The same queries by vectors, by words and by both with the boost, each against what a right document holds."""
    asked, docs, near = _asked(spark, folder), table(spark, folder, "documents").select("doc_id", "text"), _near(spark, folder)
    lexical = bm25.search(asked, docs, 20, index=_index(spark, folder))
    hit = evaluation.loose_hit(F.col("text"), F.array(F.substring("query", 1, 60)))
    return search.regression({"vector": near, "bm25": lexical, "hybrid": _hybrid(spark, folder)}, asked, docs, hit)


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level, lang, source, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())""")
def score_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").join(table(spark, folder, "labels"), "doc_id")
    return evaluation.averages(rows, ["lang", "source"], ["quality", "toxic"], 6).select("level", "lang", "source", "n", "quality", "toxic")


@query("SELECT role, count(*) AS calls, CAST(sum(turn) AS BIGINT) AS turn, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def ledger_by_role(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("tokens", T.token_estimate(F.col("text")).cast("long"))
    return evaluation.ledger(rows, "role", ["turn", "tokens"])


@query("""SELECT CAST(coalesce(sum(user_id) FILTER (event_type = 'click'), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(user_id) FILTER (contains(event_type, 'u')), 0) AS BIGINT) AS with_u, CAST(coalesce(sum(user_id) FILTER (value > 20), 0) AS BIGINT) AS large FROM events""")
def filtered_sums(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return evaluation.sums_where(table(spark, folder, "events"), F.col("user_id").cast("long"), {"clicks": kind == "click", "with_u": F.lower(kind).contains("u"), "large": F.col("value") > 20})


@query("SELECT l_linenumber, count(*) FILTER (l_returnflag = 'R') AS h1, count(*) FILTER (l_returnflag != 'R') AS h3 FROM lineitem GROUP BY ALL ORDER BY h1 DESC, h3 DESC, l_linenumber LIMIT 1")
def best_param(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.count_if(F.col("l_returnflag") == "R").alias("h1"), F.count_if(F.col("l_returnflag") != "R").alias("h3"))
    return evaluation.best(rows, "l_linenumber", "h1", "h3")


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '(missing)') AS answer FROM documents LEFT JOIN labels USING (doc_id)")
def default_left_join(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("answer"))
    return evaluation.answered(table(spark, folder, "documents").select("doc_id"), answers, "doc_id", "answer")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def source_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.distribution(table(spark, folder, "documents"), "source", 20)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.first_per_group(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT mode, n, hits_at_1, hits_at_3, round(mean_latency, 6) AS mean_latency FROM (SELECT event_type AS mode, count(*) AS n, count(*) FILTER (value < 10) AS hits_at_1, count(*) FILTER (value < 30) AS hits_at_3, avg(user_id) AS mean_latency FROM events GROUP BY ALL)""")
def rate_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("event_type").alias("mode"), (F.col("value") < 10).alias("hit_at_1"), (F.col("value") < 30).alias("hit_at_3"), F.col("user_id").alias("latency_ms"))
    return evaluation.rate_by_mode(rows).withColumn("mean_latency", F.round("mean_latency", 6))


@query("""WITH k AS (SELECT item_id, text AS answer, [left(text, 20), 'not in it', substr(text, 30, 5)] AS wanted FROM benchmark)
SELECT item_id, len(list_filter(wanted, lambda w: contains(answer, w)))::INTEGER AS hits, round_even(len(list_filter(wanted, lambda w: contains(answer, w))) / 3, 2) AS rate FROM k""")
def keyword_rates(spark: SparkSession, folder: str) -> DataFrame:
    wanted = F.array(F.substring("text", 1, 20), F.lit("not in it"), F.substring("text", 30, 5))
    rows = table(spark, folder, "benchmark").select("item_id", "text", wanted.alias("wanted")).withColumn("h", T.hit_strings(F.col("text"), F.col("wanted")))
    return rows.select("item_id", F.size("h").alias("hits"), T.hit_rate(F.col("h"), F.col("wanted")).alias("rate"))
