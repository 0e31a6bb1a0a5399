"""Subword tokenisers: WordPiece merges over the distinct words, vocabularies,
and encoding by merge rank (BPE) or by longest match (WordPiece).

Training works on the distinct-word table: pair and symbol counts are kept up
to date by the words that a merge changes.  Encoding never shuffles tokens: a
task encodes each distinct word of an Arrow batch once, with the merge ranks
or a trie of the pieces that are broadcast to it (a vocabulary, whose size is
checked), and remembers the words it has seen."""

from __future__ import annotations

import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tokens import (MAP_VOCAB_LIMIT, SPECIAL_TOKENS, SYM_SEP, UNK_ID, _re_quote, _repl_quote, _specials,
                                      _split_words, _symbols_string, chars, decode_ids, in_slices, word_counts)
from tessera.session import checkpoint_dir

# Fixed value: the mark of a piece that does not begin a word.
CONTINUES = "##"
#: Words whose pieces a task remembers.
_CACHE = 200_000


def _symbols(column: str) -> Column:
    return F.filter(F.split(F.col(column), SYM_SEP, -1), lambda s: s != F.lit(""))


def wordpiece_symbols(word: Column) -> Column:
    """The first character, then the others with the mark, framed by separators."""
    letters = chars(word)
    marked = F.transform(letters, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(CONTINUES), c)))
    return F.concat(F.lit(SYM_SEP), F.array_join(marked, SYM_SEP), F.lit(SYM_SEP))


def _tallies(words: DataFrame) -> DataFrame:
    """left, right, count: adjacent pairs, and single symbols with a null right."""
    w = words.select(_symbols("syms").alias("s"), "count")
    none = F.lit(None).cast("string")
    single = F.transform("s", lambda x: F.struct(x.alias("left"), none.alias("right")))
    pairs = F.when(F.size("s") > 1, F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(
        F.get(F.col("s"), i - 1).alias("left"), F.get(F.col("s"), i).alias("right")))).otherwise(F.slice(F.transform(
            "s", lambda x: F.struct(x.alias("left"), x.alias("right"))), 1, 0))
    return (w.select(F.explode(F.concat(single, pairs)).alias("p"), "count").groupBy("p.left", "p.right")
            .agg(F.sum("count").cast("bigint").alias("count")))


def wordpiece_merges(df: DataFrame, text: str = "text", n_merges: int = 30, min_frequency: int = 2,
                     checkpoint_every: int = 10, counted: DataFrame | None = None) -> DataFrame:
    """rank, left, right, token, count: greedy merges of the adjacent pair
    with the greatest count(left right) / (count(left) * count(right)), ties
    to the greater count, then to the lesser left and right; ``counted``: the
    table of ``word_counts``, if it is at hand."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    counted = word_counts(df, text) if counted is None else counted
    words = counted.select(wordpiece_symbols(F.col("word")).alias("syms"), "count").checkpoint()
    tallies = _tallies(words).checkpoint()
    merges = []
    for r in range(int(n_merges)):
        one = tallies.where(F.col("right").isNull())
        scored = (tallies.where(F.col("right").isNotNull() & (F.col("count") >= min_frequency)).alias("p")
                  .join(one.select(F.col("left").alias("l"), F.col("count").alias("n_l")), F.col("p.left") == F.col("l"))
                  .join(one.select(F.col("left").alias("r"), F.col("count").alias("n_r")), F.col("p.right") == F.col("r"))
                  .select("p.*", (F.col("count").cast("double") / (F.col("n_l").cast("double") * F.col("n_r").cast("double"))).alias("score")))
        top = scored.orderBy(F.desc("score"), F.desc("count"), "left", "right").limit(1).collect()
        if not top:
            break
        a, b = top[0]["left"], top[0]["right"]
        token = a + b[len(CONTINUES):]
        merges.append((r, a, b, token, int(top[0]["count"])))
        found = F.col("syms").contains(SYM_SEP + a + SYM_SEP + b + SYM_SEP)
        merged = F.regexp_replace("syms", _re_quote(SYM_SEP + a + SYM_SEP + b) + "(?=" + SYM_SEP + ")",
                                  _repl_quote(SYM_SEP + token))  # names syms once: unmaterialised merges nest
        changed = words.where(found).select(F.inline(F.array(F.struct("syms", (-F.col("count")).alias("count")),
                                                             F.struct(merged.alias("syms"), "count"))))
        tallies = (tallies.unionByName(_tallies(changed)).groupBy("left", "right")
                   .agg(F.sum("count").cast("bigint").alias("count")).where("count > 0")).checkpoint()
        words = words.withColumn("syms", merged)
        if (r + 1) % checkpoint_every == 0:
            words = words.checkpoint()
    return spark.createDataFrame(merges, "rank int, left string, right string, token string, count bigint")


def subword_vocab(df: DataFrame, merges: DataFrame, text: str = "text", wordpiece: bool = False, min_count: int = 1,
                  counted: DataFrame | None = None) -> DataFrame:
    """token, id: the special tokens, the single symbols that occur ``min_count``
    times or more in order, then the merged tokens by rank.  Its rows are the
    characters there are and the merges."""
    symbols = wordpiece_symbols(F.col("word")) if wordpiece else _symbols_string(F.col("word"))
    counted = word_counts(df, text) if counted is None else counted
    base = (counted.select(symbols.alias("syms"), "count").select(F.explode(_symbols("syms")).alias("token"), "count")
            .groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= min_count).select("token", F.lit(-1).alias("rank")))
    token = F.col("token") if wordpiece else F.concat("left", "right")
    tokens = base.unionByName(merges.select(token.alias("token"), "rank")).groupBy("token").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.orderBy("rank", "token")) - 1 + len(SPECIAL_TOKENS)
    return _specials(df.sparkSession).unionByName(tokens.select("token", place.cast("bigint").alias("id")))


# --------------------------------------------------------------------- encoding

def bpe_pieces(word: str, ranks: dict) -> list[str]:
    """The word's pieces: of all adjacent pairs the one of least rank merges
    first, of equals the leftmost.  A heap of pairs over a linked list, so a
    word of n characters takes n log n steps."""
    parts, n = list(word), len(word)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (rank := ranks.get((parts[i], parts[after[i]]))) is not None:
            heapq.heappush(heap, (rank, i))
    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or ranks.get((parts[i], parts[j])) != rank:
            continue  # the pair is gone
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


def piece_trie(ids: dict[str, int]) -> dict:
    """Nested dictionaries by letter, ``""`` for an id; pieces that continue a
    word start below the key of their mark."""
    root: dict = {CONTINUES: {}}
    for token, i in ids.items():
        continues = token.startswith(CONTINUES) and len(token) > len(CONTINUES)
        node = root[CONTINUES] if continues else root
        for c in token[len(CONTINUES):] if continues else token:
            node = node.setdefault(c, {})
        node[""] = i
    return root


def wordpiece_ids(word: str, trie: dict) -> list[int]:
    """Longest match from the left; a word with a rest that no piece begins is
    one unknown token."""
    out, at = [], 0
    while at < len(word):
        node, found, end, i = trie[CONTINUES] if at else trie, None, at, at
        while i < len(word) and (node := node.get(word[i])) is not None:
            i += 1
            if "" in node:
                found, end = node[""], i
        if found is None:
            return [UNK_ID]
        out.append(found)
        at = end
    return out


def _bounded(rows: DataFrame, what: str) -> list:
    found = rows.limit(MAP_VOCAB_LIMIT + 1).collect()
    if len(found) > MAP_VOCAB_LIMIT:
        raise ValueError(f"more than {MAP_VOCAB_LIMIT} {what}")
    return found


def _encode(df: DataFrame, shared, prepare, text: str, keys) -> DataFrame:
    """keys..., ids: every word of a text by ``prepare(shared value)``."""
    bc = df.sparkSession.sparkContext.broadcast(shared)
    src = df.select(*keys, text)
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("ids", T.ArrayType(T.LongType()))])

    def per_batch(batches):
        encode, known = prepare(bc.value), {}
        for rb in in_slices(batches, len(keys)):
            t = rb.column(len(keys))
            offsets, flat = _split_words(t)
            words = flat.dictionary_encode() if not isinstance(flat, pa.DictionaryArray) else flat
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            if len(known) > _CACHE:
                known.clear()
            pieces = []
            for w in words.dictionary.to_pylist():
                if w not in known:
                    known[w] = encode(w)
                pieces.append(known[w])
            per_word = pc.take(pa.array(pieces, pa.list_(pa.int64())), words.indices)
            ends = per_word.offsets.to_numpy().astype("int64")
            ends = pa.array((ends - ends[0])[offsets.to_numpy()], pa.int32())
            lists = pa.ListArray.from_arrays(ends, per_word.flatten(), mask=t.is_null())
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(len(keys))] + [lists], names=[*keys, "ids"])
    return src.mapInArrow(per_batch, schema)


def encode_bpe(df: DataFrame, merges: DataFrame, vocab: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """keys..., ids ARRAY<BIGINT>: whitespace words merged by rank; a piece
    that the vocabulary lacks is unknown (1).  A null text gives null ids."""
    ranks = {(r["left"], r["right"]): r["rank"] for r in _bounded(merges.select("left", "right", "rank"), "merges")}
    ids = {r.token: r.id for r in _bounded(vocab.select("token", "id"), "tokens")}

    def prepare(shared):
        ranks, ids = shared
        return lambda word: [ids.get(p, UNK_ID) for p in bpe_pieces(word, ranks)]
    return _encode(df, (ranks, ids), prepare, text, keys)


def encode_wordpiece(df: DataFrame, vocab: DataFrame, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """keys..., ids ARRAY<BIGINT>: whitespace words by longest match from the
    left; a word that cannot be put together is unknown (1).  A null text gives
    null ids."""
    ids = {r.token: r.id for r in _bounded(vocab.select("token", "id"), "tokens") if r.token not in SPECIAL_TOKENS}

    def prepare(ids):
        trie = piece_trie(ids)
        return lambda word: wordpiece_ids(word, trie)
    return _encode(df, ids, prepare, text, keys)


def decode_wordpiece(df: DataFrame, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """Adds ``text``: tokens joined by blanks, pieces that continue a word
    joined to the one before; an unknown id is ``?``."""
    return decode_ids(df, vocab, ids).withColumn("text", F.regexp_replace("text", " " + CONTINUES + r"(?=\S)", ""))
