"""Tokeniser vocabularies, encode / decode, padding, sequence packing,
chat rendering and response masks.

Vocabularies are distinct-value aggregates (partial aggregation), so the
corpus is never gathered; only the vocabulary itself - bounded by
``vocab_size`` or by the distinct character count - is ever small enough to
be numbered in one window or shipped as a map literal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import fround

from tessera.functions import text as textfn
from tessera.operators.numbering import offsets_by_key, prefix_sum
from tessera.session import checkpoint_dir

# Special tokens and their ids, as in the reference.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]", "[MASK]"]
UNK_ID = 1
PAD_ID = 0
DECODE_UNKNOWN = "?"
#: Vocabularies of up to so many entries are broadcast; larger ones are joined, with the same result.
MAP_VOCAB_LIMIT = 1_000_000


def chars(c: Column) -> Column:
    """Code points of a string (a surrogate pair stays one character)."""
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


def _specials(spark) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, id bigint")


def _batch_code_points(texts) -> tuple:
    """(code points of all texts concatenated as uint32, per-text lengths,
    null mask) for one Arrow string array."""
    vals = texts.to_pylist()
    lens = np.fromiter((len(t) if t is not None else 0 for t in vals), dtype=np.int64, count=len(vals))
    joined = "".join(t for t in vals if t is not None)
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32) if joined else np.zeros(0, np.uint32)
    return cps, lens, [t is None for t in vals]


def distinct_chars(df: DataFrame, text: str = "text") -> DataFrame:
    """token: the distinct characters, found per Arrow batch with np.unique
    (vectorised) and merged by a distributed ``distinct``."""
    schema = T.StructType([T.StructField("cp", T.LongType())])

    def per_batch(batches):
        for rb in in_slices(batches, 0):
            cps, _, _ = _batch_code_points(rb.column(0))
            u = np.unique(cps).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64())], names=["cp"])
    cps = df.select(text).mapInArrow(per_batch, schema).distinct()
    return cps.select(_chr_udf(F.col("cp")).alias("token"))


def _split_words(texts):
    """Python ``str.split()`` over an Arrow string array: (list offsets,
    flat words) with the empty pieces Arrow keeps at the ends removed."""
    import pyarrow.compute as pc
    split = pc.utf8_split_whitespace(texts)
    flat = split.flatten()
    keep = (pc.utf8_length(flat).to_numpy(zero_copy_only=False) > 0)
    cum = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
    offs = split.offsets.to_numpy()
    return pa.array(cum[offs], pa.int32()), flat.filter(pa.array(keep))


def distinct_words(df: DataFrame, text: str = "text") -> DataFrame:
    """token: distinct whitespace words, de-duplicated per Arrow batch with
    Arrow kernels, then by a distributed ``distinct``."""
    schema = T.StructType([T.StructField("token", T.StringType())])

    def per_batch(batches):
        import pyarrow.compute as pc
        for rb in in_slices(batches, 0):
            u = pc.unique(_split_words(rb.column(0))[1])
            yield pa.RecordBatch.from_arrays([u.cast(pa.string())], names=["token"])
    return df.select(text).mapInArrow(per_batch, schema).distinct()


@F.pandas_udf(T.StringType())
def _chr_udf(cp: pd.Series) -> pd.Series:
    return cp.map(lambda c: chr(int(c)))


def char_vocab(df: DataFrame, text: str = "text", with_specials: bool = False) -> DataFrame:
    """token, id: sorted distinct characters; ids from 0, or from 5 after the
    special tokens for a trained tokeniser."""
    d = distinct_chars(df, text)
    off = len(SPECIAL_TOKENS) if with_specials else 0
    v = d.select("token", (F.row_number().over(Window.orderBy("token")) - 1 + off).cast("bigint").alias("id"))
    return _specials(df.sparkSession).unionByName(v) if with_specials else v


def word_vocab(df: DataFrame, text: str = "text", vocab_size: int | None = 8000, frequency: bool = False) -> DataFrame:
    """token, id: specials 0-4, then the first ``vocab_size - 5`` distinct
    whitespace words (None: all) in alphabetical order (the reference's rule),
    or the most frequent ones with ``frequency=True``."""
    n = None if vocab_size is None else max(int(vocab_size) - len(SPECIAL_TOKENS), 0)
    if frequency:
        words = df.select(F.explode(textfn.words(F.col(text))).alias("token"))
        top, order = words.groupBy("token").agg(F.count(F.lit(1)).alias("c")), [F.col("c").desc(), F.col("token").asc()]
    else:
        top, order = distinct_words(df, text), [F.col("token").asc()]
    if n is not None:
        top = top.orderBy(*order).limit(n)
    checkpoint_dir(df.sparkSession)
    v = prefix_sum(top.checkpoint(), order, out="id").select("token", (F.col("id") + len(SPECIAL_TOKENS)).cast("bigint").alias("id"))
    return _specials(df.sparkSession).unionByName(v)


#: Bytes of text, or of ids, that a task's Python handles at once.
SLICE_BYTES = 4 * 1024 * 1024
#: Bytes whose distinct words, or ids, meet a joined vocabulary together.
CHUNK_BYTES = 4 * SLICE_BYTES


def in_slices(batches, column: int, limit: int = SLICE_BYTES):
    """Arrow batches cut into slices of at most ``limit`` bytes in a text or
    list column; a row beyond that is a slice by itself.  Spark's batches hold
    thousands of rows of any length, and a step needs many times their size."""
    import pyarrow.compute as pc
    for rb in batches:
        col = rb.column(column)
        size = pc.multiply(pc.list_value_length(col), 8) if pa.types.is_list(col.type) else pc.binary_length(col)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < rb.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield rb.slice(at, to - at)
            at = to


def _look_up(df: DataFrame, vocab: DataFrame, key: str, value: str, items, column: int, rebuild, schema: T.StructType) -> DataFrame:
    """The rows of ``df`` with each item looked up in a vocabulary too large to
    be broadcast.  ``items(batch)`` gives what to keep of a chunk of rows (a
    record batch) and its items, flat.  A chunk sends each distinct item once,
    with its places, to the join, so no row is copied per item and no frequent
    item fills a partition; ``rebuild(kept, places, values)`` gets them back."""
    found = T.StructType([T.StructField("__chunk", T.LongType()), T.StructField(key, vocab.schema[key].dataType),
                          T.StructField("__at", T.ArrayType(T.IntegerType())), T.StructField("__kept", T.BinaryType())])

    def send(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for i, rb in enumerate(in_slices(batches, column, CHUNK_BYTES)):
            kept, flat = items(rb)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kept.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                w.write_batch(kept)
            coded = flat.dictionary_encode()
            codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            places = np.argsort(codes, kind="stable").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary) + 1))]).astype(np.int32)
            # the last list: places of null items; it also carries what is kept
            at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            n, blob = len(at), out.getvalue().to_pybytes()
            keys = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
            first = pa.array([blob] + [None] * (n - 1), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, (task << 33) + i, np.int64)), keys, at, first],
                                             names=["__chunk", key, "__at", "__kept"])

    def gather(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        blob = next(x for x in table.column("__kept").drop_null())
        kept = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
        at = table.column("__at").combine_chunks()
        sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
        values = table.column(value).combine_chunks().take(pa.array(np.repeat(np.arange(len(at)), sizes)))
        return pa.Table.from_batches([rebuild(kept, at.flatten().to_numpy(), values)])
    j = df.mapInArrow(send, found).join(vocab.select(key, value), key, "left")
    return j.groupBy("__chunk").applyInArrow(gather, schema)


def _encode_by_join(df: DataFrame, vocab: DataFrame, text: str, keys) -> DataFrame:
    """One row per row of ``df``, whatever its keys: a null text gives null
    ids, a blank one none."""
    src, unk = df.select(*keys, text), UNK_ID
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("ids", T.ArrayType(T.LongType()))])

    def items(rb):
        t = rb.column(len(keys))
        offsets, flat = _split_words(t)
        n = pa.array(np.diff(offsets.to_numpy()), pa.int32(), mask=t.is_null().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([*rb.columns[:len(keys)], n], names=[*schema.names[:-1], "n"]), flat.cast(pa.string())

    def rebuild(kept, places, values):
        n = kept.column(len(keys))
        offsets = np.concatenate([[0], np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        ids = np.full(offsets[-1], unk, np.int64)
        ids[places] = values.fill_null(unk).to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=n.is_null())
        return pa.RecordBatch.from_arrays([*kept.columns[:len(keys)], lists], names=schema.names)
    return _look_up(src, vocab.select("token", F.col("id").cast("long").alias("id")), "token", "id", items, len(keys), rebuild, schema)


_TABLES: dict = {}


def _word_table(shared) -> dict:
    """Word to id, built once per Python worker from its broadcast."""
    if shared.value is not _TABLES.get("value"):
        words, ids = shared.value
        _TABLES.update(value=shared.value, table=dict(zip(words, ids.tolist())))
    return _TABLES["table"]


def encode_words(df: DataFrame, vocab: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """keys..., ids ARRAY<BIGINT> (whitespace words, unknown -> 1).  A
    vocabulary of at most ``MAP_VOCAB_LIMIT`` entries is broadcast; a worker
    looks up the distinct words of each Arrow batch in one table (Unicode
    whitespace split, dictionary, ``take``, the lists rebuilt on the same
    offsets); a larger one is
    joined on the exploded tokens and regrouped per document."""
    rows = vocab.select("token", "id").limit(MAP_VOCAB_LIMIT + 1).collect()
    if len(rows) > MAP_VOCAB_LIMIT:
        return _encode_by_join(df, vocab, text, keys)
    words = [r[0] for r in rows]
    ids = np.array([int(r[1]) for r in rows], dtype=np.int64)
    bc = df.sparkSession.sparkContext.broadcast((words, ids))
    src = df.select(*keys, text)
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("ids", T.ArrayType(T.LongType()))])
    unk = UNK_ID

    def per_batch(batches):
        table = _word_table(bc)
        for rb in in_slices(batches, len(keys)):
            t = rb.column(len(keys))
            offsets, flat = _split_words(t)
            coded = flat.dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            found = pa.array([table.get(w, unk) for w in coded.dictionary.to_pylist()], pa.int64())
            lst = pa.ListArray.from_arrays(offsets, found.take(coded.indices), mask=t.is_null())
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(len(keys))] + [lst],
                                             names=list(keys) + ["ids"])
    return src.mapInArrow(per_batch, schema)


def char_ids(df: DataFrame, vocab: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    return char_encoder(vocab, text)(df.select(*keys, text)).select(*keys, "ids")


def char_encoder(vocab: DataFrame, text: str = "text", out: str = "ids"):
    """``DataFrame -> DataFrame`` adding ``out`` = character ids of ``text``
    (unknown -> 1).  Vectorised per Arrow batch: one UTF-32 view of the
    batch's text, a sorted code-point table and ``searchsorted``; the id
    lists are built directly as an Arrow list column (``mapInArrow``)."""
    rows = vocab.select("token", "id").where(F.length("token") == 1).collect()  # at most the code points there are
    pairs = sorted((ord(r[0]), int(r[1])) for r in rows if r[0] is not None and len(r[0]) == 1)
    table = (np.array([p[0] for p in pairs], dtype=np.uint32), np.array([p[1] for p in pairs], dtype=np.int64))
    unk = UNK_ID

    def encode_frame(df: DataFrame) -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast(table)
        idx = df.columns.index(text)
        schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.LongType()))])

        def per_batch(batches):
            keys, ids = bc.value
            for rb in in_slices(batches, idx):
                cps, lens, nulls = _batch_code_points(rb.column(idx))
                pos = np.searchsorted(keys, cps)
                pos_c = np.minimum(pos, max(len(keys) - 1, 0))
                hit = (pos < len(keys)) & (keys[pos_c] == cps) if len(keys) else np.zeros(len(cps), bool)
                vals = np.where(hit, ids[pos_c] if len(ids) else 0, unk).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lens)])
                if offsets[-1] > np.iinfo(np.int32).max:  # more than a list column can index
                    raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch for such long texts")
                offsets = offsets.astype(np.int32)
                lst = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(vals, pa.int64()),
                                               mask=pa.array(nulls, pa.bool_()))
                yield pa.RecordBatch.from_arrays(list(rb.columns) + [lst], names=list(rb.schema.names) + [out])
        return df.mapInArrow(per_batch, schema)
    return encode_frame


def decode_ids(df: DataFrame, vocab: DataFrame, ids: str = "ids", sep: str = " ") -> DataFrame:
    """Adds ``text``: ids joined back to tokens (unknown -> "?"), vectorised
    per Arrow batch: binary search in the ids, Arrow ``take`` on the flat ids
    and ``binary_join`` per list; a larger vocabulary is joined."""
    rows = vocab.select("id", "token").where(F.col("id").isNotNull()).limit(MAP_VOCAB_LIMIT + 1).collect()
    if len(rows) > MAP_VOCAB_LIMIT:
        return _decode_by_join(df, vocab, ids, sep)
    known = sorted({int(i): t for i, t in rows}.items())
    bc = df.sparkSession.sparkContext.broadcast((np.array([i for i, _ in known], np.int64), [t for _, t in known]))
    idx = df.columns.index(ids)
    schema = T.StructType(df.schema.fields + [T.StructField("text", T.StringType())])
    unknown = DECODE_UNKNOWN

    def per_batch(batches):
        import pyarrow.compute as pc
        keys, tokens = bc.value
        table = pa.array(tokens + [unknown], pa.string())  # last slot: unknown ids
        for rb in in_slices(batches, idx):
            col = rb.column(idx)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pos = np.searchsorted(keys, flat)
            hit = (pos < len(keys)) & (keys[np.minimum(pos, len(keys) - 1)] == flat) if len(keys) else np.zeros(len(flat), bool)
            toks = pc.take(table, pa.array(np.where(hit, pos, len(keys)), pa.int64()))
            offs = col.offsets.to_numpy().astype(np.int64)
            offs = pa.array(offs - offs[0], pa.int32())  # flatten() is slice-relative
            lists = pa.ListArray.from_arrays(offs, toks, mask=col.is_null())
            text = pc.binary_join(lists, sep)
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [text], names=list(rb.schema.names) + ["text"])
    return df.mapInArrow(per_batch, schema)


def _decode_by_join(df: DataFrame, vocab: DataFrame, ids: str, sep: str) -> DataFrame:
    column, unknown = df.columns.index(ids), DECODE_UNKNOWN
    schema = T.StructType(df.schema.fields + [T.StructField("text", T.StringType())])

    def items(rb):
        return rb, rb.column(column).flatten().cast(pa.int64())

    def rebuild(kept, places, values):
        import pyarrow.compute as pc
        col = kept.column(column)
        offs = np.concatenate([[0], np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))])
        back = np.empty(offs[-1], np.int64)
        back[places] = np.arange(len(places))
        lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values.fill_null(unknown).take(pa.array(back)), mask=col.is_null())
        return pa.RecordBatch.from_arrays([*kept.columns, pc.binary_join(lists, sep)], names=schema.names)
    return _look_up(df, vocab.select(F.col("id").cast("long").alias("id"), "token"), "id", "token", items, column, rebuild, schema)


def pad_truncate(ids: Column, max_length: int = 128, pad_id: int = PAD_ID) -> tuple[Column, Column]:
    """(input_ids, attention_mask) of exactly ``max_length``."""
    kept = F.slice(ids, 1, max_length)
    pad = F.greatest(F.lit(max_length) - F.size(kept), F.lit(0))
    input_ids = F.concat(kept, F.array_repeat(F.lit(pad_id).cast("bigint"), pad))
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), F.size(kept)), F.array_repeat(F.lit(0).cast("bigint"), pad))
    return input_ids, mask


def pack_sequences(docs: DataFrame, max_len: int, order_key: str = "doc_id", ids: str = "ids",
                   val_fraction_div: int = 10, n_tokens: Column | None = None,
                   encode_fn=None) -> DataFrame:
    """Pack a token stream (documents concatenated in ``order_key`` order)
    into ``n = (total - 1) // max_len`` windows; ``labels`` are the inputs
    shifted by one.  Last ``max(1, n // 10)`` windows are validation.

    Distributed: global offsets come from a bucketed prefix sum, every
    document emits only the fragments overlapping each window it touches,
    and a window is regrouped from at most ``max_len + 1`` tokens."""
    L = int(max_len)
    if n_tokens is None:
        docs = docs.select(order_key, F.col(ids).alias("ids"))
    d = docs.withColumn("n", F.size("ids").cast("long") if n_tokens is None else n_tokens.cast("long")).where(F.col("n") > 0)
    n_total = d.agg(F.sum("n")).first()[0] or 0
    enough_windows((n_total - 1) // L)
    total = F.lit(n_total)  # one count, reused by several expressions
    # only keys and lengths are sorted; the documents themselves move once, to meet their offsets
    d = offsets_by_key(d, [order_key], "n", out="o")
    if n_tokens is not None:
        d = encode_fn(d) if encode_fn is not None else d
        d = d.select(order_key, F.col(ids).alias("ids"), "n", "o")
    n_seqs = F.floor((total - 1) / F.lit(L)).cast("long")
    first_k = F.floor(F.greatest(F.col("o") - 1, F.lit(0)) / L).cast("long")
    last_k = F.floor((F.col("o") + F.col("n") - 1) / L).cast("long")
    o, n = F.col("o"), F.col("n")

    def piece(k):
        lo = F.greatest(k * L, o)
        hi = F.least(k * L + L, o + n - 1)
        return F.struct(k.alias("k"), o.alias("o"), F.slice(F.col("ids"), (lo - o + 1).cast("int"),
                                                              (hi - lo + 1).cast("int")).alias("piece"))
    # pieces are cut inside one array expression; only pieces are exploded,
    # so a long document is not copied once per window it touches
    frag = d.select(F.inline(F.transform(F.sequence(first_k, last_k), piece))).where(F.col("k") < n_seqs)
    win = frag.groupBy("k").agg(F.flatten(F.sort_array(F.collect_list(F.struct("o", "piece")))["piece"]).alias("w"))
    n_val = F.greatest(F.lit(1), F.floor(n_seqs / val_fraction_div)).cast("long")
    return win.select(F.col("k").alias("seq_id"), F.slice("w", 1, L).alias("input_ids"),
                      F.slice("w", 2, L).alias("labels"),
                      F.when(F.col("k") >= n_seqs - n_val, "validation").otherwise("train").alias("split"))


def enough_windows(packed_count: int) -> None:
    if packed_count < 2:
        raise ValueError(f"Not enough data: only {packed_count} sequence(s)")


# --------------------------------------------------------------------------- chat

# Public chat formats, per role (``*``: any other role; ``{role}`` is the role itself).
CHAT_TEMPLATES = {
    "chatml": {"*": "<|im_start|>{role}\n{content}<|im_end|>\n"},
    "llama-3": {"*": "<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>"},
    "mistral": {"user": "[INST] {content} [/INST]", "assistant": " {content}</s>", "*": "{content}\n\n"},
    "gemma": {"assistant": "<start_of_turn>model\n{content}<end_of_turn>\n", "*": "<start_of_turn>user\n{content}<end_of_turn>\n"},
    "phi-3": {"*": "<|{role}|>\n{content}<|end|>\n"},
    "qwen-2.5": {"*": "<|im_start|>{role}\n{content}<|im_end|>\n"},
    "alpaca": {"user": "### Instruction:\n{content}\n\n", "assistant": "### Response:\n{content}\n\n", "*": "{content}\n\n"},
    "vicuna": {"user": "USER: {content} ", "assistant": "ASSISTANT: {content}</s>", "*": "{content} "},
    "zephyr": {"*": "<|{role}|>\n{content}</s>\n"},
    "unsloth": {"user": ">>> User: {content}\n", "assistant": ">>> Assistant: {content}</s>\n", "*": "{content}\n"},
}


def _pieces(pattern: str, role: Column, content: Column) -> Column:
    import re
    parts = [p for p in re.split(r"(\{role\}|\{content\})", pattern) if p]
    return F.concat(*[role if p == "{role}" else content if p == "{content}" else F.lit(p) for p in parts])


def render_turn(role: Column, content: Column, template: str = "chatml") -> Column:
    if template not in CHAT_TEMPLATES:
        raise ValueError(f"unknown chat template {template!r}")
    by_role = CHAT_TEMPLATES[template]
    out = _pieces(by_role["*"], role, content)
    for name, pattern in by_role.items():
        if name != "*":
            out = F.when(role == name, _pieces(pattern, role, content)).otherwise(out)
    return out


def render_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", template: str = "chatml") -> DataFrame:
    """conv_id, n_turns, text: one training string per conversation (turns
    rendered JVM-side, then concatenated in turn order)."""
    r = turns.select(conv, turn, render_turn(F.col(role), F.col(text), template).alias("seg"))
    g = r.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "seg"))).alias("s"))
    return g.select(conv, F.size("s").cast("bigint").alias("n_turns"), F.array_join(F.col("s.seg"), "").alias("text"))


def response_mask(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text",
                  template: str = "chatml") -> DataFrame:
    """Per conversation: rendered length, characters that train (assistant
    contents only) and their share (4 dp).  Pure aggregate, no regrouping."""
    seg = render_turn(F.col(role), F.col(text), template)
    r = turns.select(conv, F.length(seg).alias("seg_len"),
                     F.when(F.col(role) == "assistant", F.length(F.col(text))).otherwise(0).alias("train_len"))
    g = r.groupBy(conv).agg(F.sum("seg_len").alias("total_chars"), F.sum("train_len").alias("trained_chars"))
    return g.select(conv, F.col("total_chars").cast("bigint").alias("total_chars"),
                    F.col("trained_chars").cast("bigint").alias("trained_chars"),
                    fround(F.col("trained_chars") / F.col("total_chars"), 4).alias("trained_share"))


# --------------------------------------------------------------------------- BPE

SYM_SEP = "\u0001"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(textfn.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def _symbols_string(word: Column) -> Column:
    # \u0001 s1 \u0001 s2 \u0001 ... \u0001 : merges become plain string replaces
    return F.concat(F.lit(SYM_SEP), F.array_join(chars(word), SYM_SEP), F.lit(SYM_SEP))


def pair_counts(wc: DataFrame, min_frequency: int | None = 2) -> DataFrame:
    """left, right, count: adjacent symbol pairs weighted by word count."""
    syms = F.filter(F.split(F.col("syms"), SYM_SEP, -1), lambda s: s != F.lit(""))
    w = wc.select(syms.alias("s"), "count")
    pairs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1),
                                           lambda i: F.struct(F.get(F.col("s"), i - 1).alias("left"),
                                                              F.get(F.col("s"), i).alias("right")))).alias("p"),
                     "count").where(F.size("s") > 1)
    counts = pairs.groupBy("p.left", "p.right").agg(F.sum("count").cast("bigint").alias("count"))
    return counts if min_frequency is None else counts.where(F.col("count") >= min_frequency)


def _re_quote(s: str) -> str:
    return "".join("\\" + ch if ch in "\\.[]{}()*+?^$|-&~#" else ch for ch in s)


def _repl_quote(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def bpe_pair_counts(df: DataFrame, text: str = "text", min_frequency: int = 2) -> DataFrame:
    wc = word_counts(df, text).select(_symbols_string(F.col("word")).alias("syms"), "count")
    return pair_counts(wc, min_frequency)


def bpe_merges(df: DataFrame, text: str = "text", n_merges: int = 30, min_frequency: int = 2,
               checkpoint_every: int = 10, counted: DataFrame | None = None) -> DataFrame:
    """rank, left, right, count: greedy best-pair merges over the distinct
    word table (count desc, then pair lexicographic); ``counted``: the table,
    if it is at hand.

    Pairs are counted once over all words; a merge then only recounts the
    words that hold the merged pair, and adds the difference to the counts.
    The counts are checkpointed at every merge (each is read twice by the
    next), the words every ``checkpoint_every`` merges."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    counted = word_counts(df, text) if counted is None else counted
    words = counted.select(_symbols_string(F.col("word")).alias("syms"), "count").checkpoint()
    counts = pair_counts(words, 1).checkpoint()
    merges = []
    for r in range(int(n_merges)):
        top = (counts.where(F.col("count") >= min_frequency).orderBy(F.col("count").desc(), "left", "right").limit(1).collect())
        if not top:
            break
        a, b, c = top[0]["left"], top[0]["right"], top[0]["count"]
        merges.append((r, a, b, int(c)))
        # the lookahead leaves the closing separator for the next match, so
        # a a a a a -> aa aa a (leftmost, non-overlapping, like BPE)
        pat = _re_quote(SYM_SEP + a + SYM_SEP + b) + "(?=" + SYM_SEP + ")"
        rep = _repl_quote(SYM_SEP + a + b)
        holds = F.col("syms").contains(SYM_SEP + a + SYM_SEP + b + SYM_SEP)
        merged = F.regexp_replace(F.col("syms"), pat, rep)  # names syms once: unmaterialised merges nest
        changed = words.where(holds).select(F.explode(F.array(F.struct("syms", (-F.col("count")).alias("count")),
                                                              F.struct(merged.alias("syms"), "count"))).alias("w")).select("w.*")
        counts = (counts.unionByName(pair_counts(changed, None)).groupBy("left", "right")
                  .agg(F.sum("count").cast("bigint").alias("count")).where("count > 0")).checkpoint()
        words = words.withColumn("syms", merged)
        if (r + 1) % checkpoint_every == 0:
            words = words.checkpoint()
    return spark.createDataFrame(merges, "rank int, left string, right string, count bigint")
