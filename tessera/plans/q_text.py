"""Registered queries: text cleaning / splitting, JSON flattening, HTML to
text, URL classification and code-block extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as textfn
from tessera.operators import transforms as tf
from tessera.plans.registry import query
from tessera.sources.files import table

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


query("text_clean", f"""SELECT doc_id, regexp_replace(lower({_strip('text')}), '[^a-zA-Z0-9\\s.,!?''-]', '', 'g') AS text
FROM documents""")(
    lambda spark, d: tf.text_clean(table(spark, d, "documents", spread=True).select("doc_id", "text"), "text",
                                   remove_special=True))

query("text_clean_html", f"""SELECT page_id, regexp_replace(regexp_replace(lower({_strip('html')}), '<[^>]+>', '', 'g'),
 'https?://\\S+', '', 'g') AS html FROM pages""")(
    lambda spark, d: tf.text_clean(table(spark, d, "pages", spread=True).select("page_id", "html"), "html",
                                   remove_html=True, remove_urls=True))

query("text_split", """WITH w AS (SELECT doc_id, lang, source, n_chars,
  list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, array_to_string(ws[s + 1 : s + 200], ' ') AS text, lang, source, n_chars, CAST(s AS BIGINT) AS _chunk_idx
FROM w, LATERAL (SELECT unnest(generate_series(0, len(ws) - 1, 180)) AS s) g WHERE len(ws) > 0""")(
    lambda spark, d: tf.text_split(table(spark, d, "documents", spread=True).select("doc_id", "text", "lang", "source", "n_chars"),
                                   "text", 200, 20))

query("flatten_json", """SELECT event_id, user_id, event_type, value,
 CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")(
    lambda spark, d: tf.flatten_json(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"),
                                     "props"))

query("html_to_text", """WITH c AS (SELECT page_id, html,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
   '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<[^>]+>', ' ', 'g'),
   '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS full_text FROM pages)
SELECT page_id, full_text AS text, CAST(length(full_text) AS BIGINT) AS n_chars,
 regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM c""")(
    lambda spark, d: table(spark, d, "pages", spread=True)
    .select("page_id", "html", textfn.html_to_text(F.col("html")).alias("text"))
    .select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"), textfn.html_title(F.col("html")).alias("title")))

query("url_source", """SELECT page_id, url,
 CASE WHEN regexp_matches(url, 'arxiv\\.org/(?:abs|pdf)/(\\d+\\.\\d+)') THEN 'arxiv'
      WHEN regexp_matches(url, 'semanticscholar\\.org/paper/([a-f0-9]+)') THEN 'semanticscholar'
      WHEN contains(url, 'openreview.net') THEN 'openreview' ELSE 'generic' END AS source,
 CASE WHEN regexp_matches(url, 'arxiv\\.org/(?:abs|pdf)/(\\d+\\.\\d+)') THEN regexp_extract(url, 'arxiv\\.org/(?:abs|pdf)/(\\d+\\.\\d+)', 1)
      WHEN regexp_matches(url, 'semanticscholar\\.org/paper/([a-f0-9]+)') THEN regexp_extract(url, 'semanticscholar\\.org/paper/([a-f0-9]+)', 1)
      WHEN contains(url, 'openreview.net') AND regexp_matches(url, 'id=([A-Za-z0-9_-]+)') THEN regexp_extract(url, 'id=([A-Za-z0-9_-]+)', 1)
 END AS paper_id FROM pages""")(
    lambda spark, d: table(spark, d, "pages", spread=True).select(
        "page_id", "url", textfn.url_source(F.col("url")).alias("source"),
        textfn.url_paper_id(F.col("url")).alias("paper_id")))


def code_blocks_table(df, text_col: str = "text", keys=("conv_id", "turn")):
    blocks = df.select(*keys, F.posexplode(textfn.code_blocks(F.col(text_col))).alias("block_idx", "b"))
    return blocks.select(*keys, F.col("block_idx").cast("bigint").alias("block_idx"),
                         F.col("b.source").alias("source"), F.col("b.content").alias("content"))


query("code_blocks", """WITH b AS (SELECT conv_id, turn, list_concat(
   list_transform(regexp_extract_all(text, '<code>(.*?)</code>', 1, 's'), lambda s: {'source': 'code_tag', 'content': regexp_replace(s, '^\\s+|\\s+$', '', 'g')}),
   list_filter(list_transform(regexp_extract_all(text, '```(?:python)?\\n(.*?)```', 1, 's'), lambda s: {'source': 'markdown', 'content': regexp_replace(s, '^\\s+|\\s+$', '', 'g')}), lambda x: length(x.content) > 50)
 ) AS bl FROM conversations)
SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS block_idx, bl[i].source AS source, bl[i].content AS content
FROM b, LATERAL (SELECT unnest(generate_series(1, len(bl))) AS i) g""")(
    lambda spark, d: code_blocks_table(table(spark, d, "conversations")))
