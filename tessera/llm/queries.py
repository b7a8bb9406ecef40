"""The subpackage's queries, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, delta_lloyd, filter_audit, jaccard, katz, length_histogram, packing, quality_classifier, quality_rules, recompression, repeats, revisits, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_count_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


def op2_not_modified(spark: SparkSession, folder: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, folder, "pages")))
    headers = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "url", "response_id", "outcome", headers.alias("headers"), F.coalesce("digest", F.lit("")).alias("digest"))


def op3_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram.length_histogram(length_histogram.encoded_lengths(table(spark, folder, "documents")))


def op4_concat_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = katz.score(table(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_previous_factors(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    return found.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_prefix_containment(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_recompression(spark: SparkSession, folder: str) -> DataFrame:
    found = recompression.without_earlier(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_orders(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_delta_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    found = delta_lloyd.cluster(table(spark, folder, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    "op1_count_tree_join": op1_count_tree_join,
    "op2_not_modified": op2_not_modified,
    "op3_length_histogram": op3_length_histogram,
    "op4_concat_and_cut": op4_concat_and_cut,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_previous_factors": op6_previous_factors,
    "op7_boosted_quality": op7_boosted_quality,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_ordinal_toxicity": op9_ordinal_toxicity,
    "op10_prefix_containment": op10_prefix_containment,
    "op11_recompression": op11_recompression,
    "op12_filter_orders": op12_filter_orders,
    "op13_delta_lloyd": op13_delta_lloyd,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAINMENT_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
    FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
places AS (
    SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM d, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
found AS (SELECT doc_id, p, places.n, item_id FROM places JOIN windows USING (win) WHERE places.n = windows.n),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM found), unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

REVISITS_SQL = r"""
WITH parts AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
hosts AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS host, regexp_replace(substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1), '(^|[?&])(ref|utm_[a-z]+)=[^&]*', '\1', 'g') AS rest FROM parts),
named AS (SELECT page_id, html, md5(coalesce(html, '')) AS digest,
    regexp_replace(lower(host), ':(80|443)$', '') || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '[?&]+$', ''), '[?]&+', '?', 'g'), '&&+', '&', 'g'), '/(index[.]html?)?$', '') AS url,
    CAST('0x' || md5(coalesce(url, ''))[1:1] AS BIGINT) AS own, CAST('0x' || md5(coalesce(html, ''))[1:4] AS BIGINT) AS delay FROM hosts),
asks AS (SELECT page_id * 2 + 1 AS record_id, url, page_id * 60 + 1 + delay AS ts, 't' || (page_id % 1000) AS changed,
    CASE WHEN own = 0 THEN 'other' WHEN own = 1 THEN NULL ELSE digest END AS tag FROM named),
found AS (SELECT a.*, p.page_id, p.digest, p.digest AS own_tag, 't' || (p.page_id % 1000) AS own_changed
    FROM asks a ASOF LEFT JOIN (SELECT *, page_id * 60 AS ts FROM named) p ON a.url = p.url AND a.ts > p.ts)
SELECT record_id, url, page_id * 2 AS response_id, outcome,
    CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=60;content-type=text/html;date=' || ts || ';etag="' || digest || '"' ELSE '' END AS headers,
    CASE WHEN outcome = 'resolved' THEN digest ELSE '' END AS digest
FROM (SELECT *, CASE WHEN page_id IS NULL THEN 'missing' WHEN coalesce(tag = own_tag, changed = own_changed) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found)
"""

EARLIER_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS t(p)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, q FROM windows JOIN firsts USING (win), unnest(range(p, p + 13)) AS t(q) WHERE first < doc_id),
each AS (SELECT doc_id, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(q)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM each ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

ORDERS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM t LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || e.x || f.x AS o FROM letters a, letters b, letters c, letters e, letters f
    WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM orders, unnest(range(1, 6)) AS t(s)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
found AS (SELECT part, o, s, x, CASE WHEN before != '' THEN regexp_matches(fails, '[' || before || ']') ELSE false END AS earlier, contains(fails, x) AS own, fails, n, good, toxic FROM cells, steps),
sums AS (SELECT part, o, s, x, sum(CASE WHEN NOT earlier AND NOT own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT earlier AND own THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN earlier AND own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT earlier AND own THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT earlier AND own THEN toxic ELSE 0 END) AS toxic_lost FROM found GROUP BY part, o, s, x)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums
"""


def _lloyd_sql(rounds: int = 3) -> str:
    """A round: every vector with its distance to every centroid, the nearest, and the floor of each cluster's mean."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, v, min(struct_pack(d := CAST({distance} AS BIGINT), k := k)) AS best FROM q, c{r} GROUP BY vec_id, v)")
        if r < rounds:
            means = f"m{r} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT best.k AS k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{r}, unnest(range(1, 65)) AS t(i) GROUP BY best.k, i) GROUP BY k)"
            steps += [means, f"c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))"]
    return f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM q ORDER BY h LIMIT 16)),
{", ".join(steps)},
e AS (SELECT k, sum(best.d) AS own FROM (SELECT *, best.k AS k FROM a{rounds}) GROUP BY k)
SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(own) FROM e) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN e ON e.k = best.k JOIN c{rounds} ON c{rounds}.k = best.k
"""


ORACLE_SQL: dict[str, str] = {"op2_not_modified": REVISITS_SQL, "op10_prefix_containment": CONTAINMENT_SQL, "op11_recompression": EARLIER_SQL, "op12_filter_orders": ORDERS_SQL, "op13_delta_lloyd": _lloyd_sql()}
