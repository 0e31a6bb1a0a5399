"""Registered queries: vocabularies, BPE pair counts / merges, encode /
decode, padding, sequence packing, sequential split, chat rendering and
response masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import subwords as sw
from tessera.operators import tokens as tk
from tessera.plans.registry import query
from tessera.session import checkpoint_dir
from tessera.sources.files import table


def ids_text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_CHARS = "regexp_extract_all(text, '(?s).', 0)"

query("char_vocab", f"""SELECT ch AS token, CAST(row_number() OVER (ORDER BY ch) - 1 AS BIGINT) AS id
FROM (SELECT DISTINCT unnest({_CHARS}) AS ch FROM documents)""")(
    lambda spark, d: tk.char_vocab(table(spark, d, "documents", spread=True)))

_SPECIALS_SQL = ("SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[BOS]', 2), ('[EOS]', 3), ('[MASK]', 4)) "
                 "s(token, id)")
_WORD_VOCAB_SQL = f"""(SELECT token, CAST(id AS BIGINT) AS id FROM ({_SPECIALS_SQL}) sp
UNION ALL SELECT w, CAST(row_number() OVER (ORDER BY w) + 4 AS BIGINT) FROM (
  SELECT DISTINCT unnest({_WORDS}) AS w FROM documents) top)"""

query("word_vocab", f"SELECT * FROM {_WORD_VOCAB_SQL} v")(
    lambda spark, d: tk.word_vocab(table(spark, d, "documents", spread=True), vocab_size=None))

query("bpe_pair_counts", f"""WITH wc AS (SELECT w, count(*) AS c FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w),
s AS (SELECT regexp_extract_all(w, '(?s).', 0) AS s, c FROM wc)
SELECT s[i] AS "left", s[i + 1] AS "right", CAST(sum(c) AS BIGINT) AS count
FROM s, LATERAL (SELECT unnest(range(1, len(s))) AS i) x GROUP BY ALL HAVING sum(c) >= 2""")(
    lambda spark, d: tk.bpe_pair_counts(table(spark, d, "documents", spread=True)))

N_MERGES = 20


def _bpe_sql() -> str:
    """One pair of CTEs per merge: the best pair, and the words with it merged.
    Symbols are framed by chr(2) and chr(3), so that a merge is a plain replace."""
    parts = [f"""w0 AS MATERIALIZED (SELECT array_to_string(list_transform(regexp_extract_all(w, '(?s).', 0),
  lambda x: chr(2) || x || chr(3)), '') AS syms, c FROM (SELECT w, count(*) AS c FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w))"""]
    for r in range(N_MERGES):
        parts.append(f"""t{r} AS MATERIALIZED (SELECT s[i] AS l, s[i + 1] AS r, CAST(sum(c) AS BIGINT) AS n
 FROM (SELECT regexp_extract_all(syms, '\x02([^\x03]*)\x03', 1) AS s, c FROM w{r}) q, LATERAL (SELECT unnest(range(1, len(s))) AS i) x
 GROUP BY ALL HAVING sum(c) >= 2 ORDER BY n DESC, l, r LIMIT 1)""")
        parts.append(f"""w{r + 1} AS MATERIALIZED (SELECT replace(syms, (SELECT chr(2) || l || chr(3) || chr(2) || r || chr(3) FROM t{r}),
 (SELECT chr(2) || l || r || chr(3) FROM t{r})) AS syms, c FROM w{r})""")
    rows = " UNION ALL ".join(f'SELECT {r} AS rank, l AS "left", r AS "right", n AS count FROM t{r}' for r in range(N_MERGES))
    return "WITH " + ",\n".join(parts) + "\n" + rows


query("bpe_merges", _bpe_sql())(lambda spark, d: tk.bpe_merges(table(spark, d, "documents", spread=True), n_merges=N_MERGES))


# -- subwords: one more CTE chain per merge, on symbols framed by chr(2) and chr(3)

_WORD_COUNTS = f"(SELECT w, count(*) AS c FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w)"
#: Symbols as rare as this are left out of the WordPiece vocabulary, so that some words are unknown.
RARE_SYMBOL = 20
N_PIECES = 15


def _wordpiece_ctes(n: int) -> list[str]:
    parts = [f"""w0 AS MATERIALIZED (SELECT w, array_to_string(list_transform(list_zip(regexp_extract_all(w, '(?s).', 0),
  range(len(regexp_extract_all(w, '(?s).', 0)))), lambda x: chr(2) || CASE WHEN x[2] = 0 THEN '' ELSE '##' END || x[1] || chr(3)), '') AS syms, c
  FROM {_WORD_COUNTS})"""]
    for r in range(n):
        parts.append(f"""s{r} AS MATERIALIZED (SELECT regexp_extract_all(syms, '\x02([^\x03]*)\x03', 1) AS s, c FROM w{r}),
u{r} AS MATERIALIZED (SELECT x, sum(c) AS n FROM (SELECT unnest(s) AS x, c FROM s{r}) GROUP BY x),
t{r} AS MATERIALIZED (SELECT p.l, p.r, p.n FROM (SELECT s[i] AS l, s[i + 1] AS r, CAST(sum(c) AS BIGINT) AS n
   FROM s{r}, LATERAL (SELECT unnest(range(1, len(s))) AS i) x GROUP BY ALL HAVING sum(c) >= 2) p
  JOIN u{r} a ON a.x = p.l JOIN u{r} b ON b.x = p.r
  ORDER BY p.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE) DESC, p.n DESC, p.l, p.r LIMIT 1),
w{r + 1} AS MATERIALIZED (SELECT w, replace(syms, (SELECT chr(2) || l || chr(3) || chr(2) || r || chr(3) FROM t{r}),
 (SELECT chr(2) || l || substr(r, 3) || chr(3) FROM t{r})) AS syms, c FROM w{r})""")
    return parts


_WP_MERGES = " UNION ALL ".join(f'SELECT {r} AS rank, l AS "left", r AS "right", l || substr(r, 3) AS token, n AS count FROM t{r}'
                                for r in range(N_PIECES))
query("wordpiece_merges", "WITH " + ",\n".join(_wordpiece_ctes(N_PIECES)) + "\n" + _WP_MERGES)(
    lambda spark, d: sw.wordpiece_merges(table(spark, d, "documents", spread=True), n_merges=N_PIECES))

_WP_VOCAB = f"""wp AS MATERIALIZED (SELECT token, CAST(row_number() OVER (ORDER BY rank, token) + 4 AS BIGINT) AS id FROM (
  SELECT token, min(rank) AS rank FROM (SELECT x AS token, -1 AS rank FROM u0 WHERE n >= {RARE_SYMBOL}
   UNION ALL SELECT token, rank FROM ({_WP_MERGES})) GROUP BY token)),
body AS MATERIALIZED (SELECT id, starts_with(token, '##') AND len(token) > 2 AS cont,
  CASE WHEN starts_with(token, '##') AND len(token) > 2 THEN substr(token, 3) ELSE token END AS b FROM wp),
lens AS (SELECT DISTINCT len(b) AS n FROM body),
best AS MATERIALIZED (SELECT w, p, max(n) AS n FROM (SELECT w, unnest(range(1, len(w) + 1)) AS p FROM w0) q, lens
  WHERE EXISTS (SELECT 1 FROM body WHERE cont = (p > 1) AND len(b) = lens.n AND b = substr(w, p, lens.n)) GROUP BY w, p),
walk AS (SELECT w, 1::BIGINT AS p, '' AS ids FROM w0
  UNION ALL SELECT k.w, k.p + b.n, k.ids || ' ' || v.id FROM walk k JOIN best b ON b.w = k.w AND b.p = k.p
   JOIN body v ON v.cont = (k.p > 1) AND v.b = substr(k.w, k.p, b.n)),
coded AS MATERIALIZED (SELECT w0.w, coalesce(substr(k.ids, 2), '1') AS ids FROM w0 LEFT JOIN walk k ON k.w = w0.w AND k.p = len(w0.w) + 1)"""
_TOKS = f"toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))"
_CODED_DOCS = """SELECT doc_id, string_agg(ids, ' ' ORDER BY pos) AS ids,
 CAST(sum(len(string_split(ids, ' '))) AS BIGINT) AS n_tokens FROM toks JOIN coded USING (w) GROUP BY doc_id"""


def _counted(spark, docs):
    """The distinct words, counted once for merges and vocabulary."""
    checkpoint_dir(spark)
    return tk.word_counts(docs).checkpoint()


def _wordpiece(spark, d):
    docs = table(spark, d, "documents", spread=True)
    counted = _counted(spark, docs)
    merges = sw.wordpiece_merges(docs, n_merges=N_PIECES, counted=counted)
    vocab = sw.subword_vocab(docs, merges, wordpiece=True, min_count=RARE_SYMBOL, counted=counted).checkpoint()
    return sw.encode_wordpiece(docs, vocab), vocab


def _as_text(enc):
    return enc.where(F.size("ids") > 0).select("doc_id", ids_text(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n_tokens"))


query("encode_wordpiece", "WITH RECURSIVE " + ",\n".join([*_wordpiece_ctes(N_PIECES), _WP_VOCAB, _TOKS]) + "\n" + _CODED_DOCS)(
    lambda spark, d: _as_text(_wordpiece(spark, d)[0]))


def _decode_wordpiece(spark, d):
    enc, vocab = _wordpiece(spark, d)
    return sw.decode_wordpiece(enc.where(F.size("ids") > 0), vocab).select("doc_id", "text")


query("decode_wordpiece", "WITH RECURSIVE " + ",\n".join([*_wordpiece_ctes(N_PIECES), _WP_VOCAB, _TOKS]) + """
SELECT doc_id, string_agg(CASE WHEN ids = '1' THEN '[UNK]' ELSE w END, ' ' ORDER BY pos) AS text
FROM toks JOIN coded USING (w) GROUP BY doc_id""")(_decode_wordpiece)


def _bpe_coded_sql() -> str:
    parts = [f"""w0 AS MATERIALIZED (SELECT w, array_to_string(list_transform(regexp_extract_all(w, '(?s).', 0),
  lambda x: chr(2) || x || chr(3)), '') AS syms, c FROM {_WORD_COUNTS})"""]
    for r in range(N_MERGES):
        parts.append(f"""t{r} AS MATERIALIZED (SELECT s[i] AS l, s[i + 1] AS r, CAST(sum(c) AS BIGINT) AS n
 FROM (SELECT regexp_extract_all(syms, '\x02([^\x03]*)\x03', 1) AS s, c FROM w{r}) q, LATERAL (SELECT unnest(range(1, len(s))) AS i) x
 GROUP BY ALL HAVING sum(c) >= 2 ORDER BY n DESC, l, r LIMIT 1),
w{r + 1} AS MATERIALIZED (SELECT w, replace(syms, (SELECT chr(2) || l || chr(3) || chr(2) || r || chr(3) FROM t{r}),
 (SELECT chr(2) || l || r || chr(3) FROM t{r})) AS syms, c FROM w{r})""")
    merged = " UNION ALL ".join(f"SELECT l || r AS token, {r} AS rank FROM t{r}" for r in range(N_MERGES))
    parts.append(f"""vb AS MATERIALIZED (SELECT token, CAST(row_number() OVER (ORDER BY rank, token) + 4 AS BIGINT) AS id FROM (
  SELECT token, min(rank) AS rank FROM (SELECT DISTINCT unnest(regexp_extract_all(w, '(?s).', 0)) AS token, -1 AS rank FROM w0
   UNION ALL {merged}) GROUP BY token))""")
    parts.append(f"""coded AS MATERIALIZED (SELECT w, string_agg(CAST(vb.id AS VARCHAR), ' ' ORDER BY i) AS ids FROM (
  SELECT w, unnest(s) AS token, generate_subscripts(s, 1) AS i FROM (
   SELECT w, regexp_extract_all(syms, '\x02([^\x03]*)\x03', 1) AS s FROM w{N_MERGES})) JOIN vb USING (token) GROUP BY w)""")
    return "WITH " + ",\n".join([*parts, _TOKS]) + "\n" + _CODED_DOCS


def _encode_bpe(spark, d):
    docs = table(spark, d, "documents", spread=True)
    counted = _counted(spark, docs)
    merges = tk.bpe_merges(docs, n_merges=N_MERGES, counted=counted)
    return _as_text(sw.encode_bpe(docs, merges, sw.subword_vocab(docs, merges, counted=counted)))


query("encode_bpe", _bpe_coded_sql())(_encode_bpe)


def _encoded(spark, d):
    docs = table(spark, d, "documents", spread=True)
    vocab = tk.word_vocab(docs, vocab_size=None)
    return tk.encode_words(docs, vocab), vocab


_ENC_SQL = f"""v AS {_WORD_VOCAB_SQL},
toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
enc AS (SELECT doc_id, pos, w, coalesce(v.id, 1) AS id FROM toks LEFT JOIN v ON toks.w = v.token)"""


def _encode_words(spark, d):
    enc, _ = _encoded(spark, d)
    return enc.select("doc_id", ids_text(F.col("ids")).alias("ids"), F.size("ids").cast("bigint").alias("n_tokens"))


query("encode_words", f"""WITH {_ENC_SQL}
SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids, CAST(count(*) AS BIGINT) AS n_tokens
FROM enc GROUP BY doc_id""")(_encode_words)


def _decode_words(spark, d):
    enc, vocab = _encoded(spark, d)
    return tk.decode_ids(enc, vocab).select("doc_id", "text")


query("decode_words", f"""WITH {_ENC_SQL}
SELECT doc_id, string_agg(coalesce((SELECT token FROM v WHERE v.id = enc.id), '?'), ' ' ORDER BY pos) AS text
FROM enc GROUP BY doc_id""")(_decode_words)


def _pad(spark, d):
    enc, _ = _encoded(spark, d)
    ids, mask = tk.pad_truncate(F.col("ids"), 128)
    return enc.select("doc_id", ids_text(ids).alias("input_ids"), ids_text(mask).alias("attention_mask"))


query("pad_truncate", f"""WITH {_ENC_SQL},
e AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM enc GROUP BY doc_id),
k AS (SELECT doc_id, ids[1:128] AS kept FROM e)
SELECT doc_id,
 array_to_string(list_concat(kept, list_transform(range(greatest(128 - len(kept), 0)), lambda x: 0)), ' ') AS input_ids,
 array_to_string(list_concat(list_transform(range(len(kept)), lambda x: 1),
   list_transform(range(greatest(128 - len(kept), 0)), lambda x: 0)), ' ') AS attention_mask FROM k""")(_pad)

PACK_LEN = 256


def packed(spark, d):
    docs = table(spark, d, "documents", spread=True).select("doc_id", "text")
    enc = tk.char_encoder(tk.char_vocab(docs))
    return tk.pack_sequences(docs, PACK_LEN, n_tokens=F.length("text"), encode_fn=enc)


_PACK_SQL = f"""WITH cv AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id
  FROM (SELECT DISTINCT unnest({_CHARS}) AS ch FROM documents)),
t AS (SELECT doc_id, unnest(a) AS ch, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, {_CHARS} AS a FROM documents)),
g AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS gpos, cv.id FROM t JOIN cv USING (ch)),
ns AS (SELECT (count(*) - 1) // {PACK_LEN} AS n FROM g),
inp AS (SELECT gpos // {PACK_LEN} AS k, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY gpos) AS s FROM g, ns
  WHERE gpos < n * {PACK_LEN} GROUP BY 1),
lab AS (SELECT (gpos - 1) // {PACK_LEN} AS k, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY gpos) AS s FROM g, ns
  WHERE gpos >= 1 AND gpos <= n * {PACK_LEN} GROUP BY 1),
packed AS (SELECT CAST(k AS BIGINT) AS seq_id, inp.s AS input_ids, lab.s AS labels,
  CASE WHEN k >= n - greatest(1, n // 10) THEN 'validation' ELSE 'train' END AS split FROM inp JOIN lab USING (k), ns)"""

query("pack_sequences", _PACK_SQL + "\nSELECT * FROM packed")(
    lambda spark, d: packed(spark, d).select("seq_id", ids_text(F.col("input_ids")).alias("input_ids"),
                                             ids_text(F.col("labels")).alias("labels"), "split"))
query("split_sequential", _PACK_SQL + "\nSELECT split, CAST(count(*) AS BIGINT) AS n_seqs FROM packed GROUP BY split")(
    lambda spark, d: packed(spark, d).groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_seqs")))

query("render_chat", """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
 string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")(
    lambda spark, d: tk.render_chat(table(spark, d, "conversations")))

query("response_mask", """SELECT conv_id,
 CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) AS BIGINT) AS total_chars,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS trained_chars,
 round(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)
   / sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))), 4) AS trained_share
FROM conversations GROUP BY conv_id""")(
    lambda spark, d: tk.response_mask(table(spark, d, "conversations")))

query("render_chat_llama3", """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
 string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")(
    lambda spark, d: tk.render_chat(table(spark, d, "conversations"), template="llama-3"))
query("render_chat_alpaca", """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
 string_agg(CASE WHEN role = 'user' THEN '### Instruction:' || chr(10) || text || chr(10) || chr(10)
   WHEN role = 'assistant' THEN '### Response:' || chr(10) || text || chr(10) || chr(10)
   ELSE text || chr(10) || chr(10) END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")(
    lambda spark, d: tk.render_chat(table(spark, d, "conversations"), template="alpaca"))


def _template_sql(template):
    """The same format in SQL."""
    import re

    def pieces(pattern):
        parts = [p for p in re.split(r"(\{role\}|\{content\})", pattern) if p]
        return " || ".join("role" if p == "{role}" else "text" if p == "{content}"
                           else "'" + p.replace("\n", "' || chr(10) || '") + "'" for p in parts)
    by_role = tk.CHAT_TEMPLATES[template]
    cases = "".join(f" WHEN role = '{r}' THEN {pieces(p)}" for r, p in by_role.items() if r != "*")
    turn = f"CASE{cases} ELSE {pieces(by_role['*'])} END" if cases else pieces(by_role["*"])
    return f"""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg({turn}, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""


for _t in ("mistral", "gemma", "phi-3", "qwen-2.5", "vicuna", "zephyr", "unsloth"):
    query("render_chat_" + _t.replace("-", "_").replace(".", "_"), _template_sql(_t))(
        lambda spark, d, t=_t: tk.render_chat(table(spark, d, "conversations"), template=t))
