"""The registered queries of this package: thin functions that apply an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontaminate, exact_dedup, html_text, mixing, pii, quality, simhash, substring_dedup, url_filter, warc
from loomstone.llm.common import fresh_path

#: (host, path, verdict) of op1.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


#: Rows that op3 never learns from.
HELD_OUT = "crc32(CAST(CAST({} AS STRING) AS BINARY)) % 4 = 2"


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=~F.expr(HELD_OUT.format("mark_id")))
    held_out = F.coalesce(F.expr(HELD_OUT.format("doc_id")), F.lit(False))
    return quality.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty index of its own in the shared folder, which two ranges of ids reach one after the other."""
    docs, name = table(spark, sf_dir, "documents"), f"digest_index_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name, exact_dedup.buckets_for(docs.count()), fresh_path(spark, name))
    judged = exact_dedup.exact_dedup(docs, index, batches=2).drop("row_no")
    index.drop()
    return judged


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slots, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(placed, slots)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


#: Of op10: most pages are larger than one segment.
WARC_SEGMENT = 2_048


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path, segment_bytes=WARC_SEGMENT)
    return warc.read_archives(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_warc": op10_warc,
}


def _op1_sql() -> str:
    bound = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    hard = " + ".join(f"{bound(t)}::BIGINT" for t in url_filter.STRICT)
    soft = " + ".join(f"{bound(t)}::BIGINT" for t in url_filter.SOFT)
    weight = " + ".join(f"{w} * {bound(t)}::BIGINT" for t, w in url_filter.SOFT.items())
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rules}),
p AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS u,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END AS host0,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
j AS (SELECT *, translate(host0, '{upper}', '{lower}') AS host, {hard} AS strict_hits, {soft} AS soft_hits, {weight} AS soft_weight FROM p),
fit AS (SELECT j.page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
        FROM j JOIN rules ON (j.host = rh OR ends_with(j.host, '.' || rh)) AND starts_with(j.path, rp) GROUP BY 1)
SELECT j.page_id, host, path, rule,
  coalesce(rv, CASE WHEN strict_hits > 0 OR (soft_hits >= 2 AND soft_weight >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, soft_weight
FROM j LEFT JOIN fit USING (page_id)"""


ORACLE = {
    "op1_url_filter": _op1_sql(),
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT DISTINCT win.doc_id, win.i FROM win JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY 1) f USING (h) WHERE win.doc_id > least),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
near AS (SELECT pos.doc_id, p, word, max(hit.i) OVER (PARTITION BY pos.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS last_hit
  FROM pos LEFT JOIN hit ON hit.doc_id = pos.doc_id AND hit.i = p),
agg AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (last_hit > p - 50) AS n_removed,
  string_agg(word, ' ' ORDER BY p) FILTER (last_hit IS NULL OR last_hit <= p - 50) AS kept FROM near GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN agg USING (doc_id)""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op8_decontamination": r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x20!-/:-@\[-`{-~]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x20!-/:-@\[-`{-~]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY 1),
f AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM s d JOIN s i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_item""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS b FROM pages),
q AS (SELECT page_id, h, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  list_sum(list_transform(range(1, 6), lambda j: substr(b, 5 * k + j, 1)::INT << (5 - j)))::INT + 1, 1)), '') AS payload_digest FROM p),
g AS (SELECT h, max(page_id) AS last_id FROM p GROUP BY 1)
SELECT page_id, strlen(q.h) AS payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to, NULL::VARCHAR AS error FROM q JOIN g ON q.h = g.h""",
}
