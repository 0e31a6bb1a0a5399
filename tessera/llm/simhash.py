"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints are computed row by row next to the text (no text is shuffled).
From then on only distinct 64-bit fingerprints move.  A fingerprint is cut in
two 32-bit segments; two fingerprints within ``max_distance`` bits differ in
at most half of that in one segment.  Each fingerprint is filed under every
key of a small Hamming ball around each segment, so that two near segments
share a key; a key's members are compared in full, and each bucket gives a
spanning forest of its links (never all pairs).  Components are found by
min-label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, packed, row_hash, unpacked

SEED = 42
#: Members of a bucket that one task compares; a larger bucket is dealt into
#: blocks, and every pair of blocks is compared by its own task.
BLOCK = 2048
_HASHES_AT_ONCE = 1 << 16


def _simhash(text: bytes | None, shingle: int) -> int:
    words = (text or b"").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[len(words) - n:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _HASHES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + _HASHES_AT_ONCE].tolist(), ends[at:at + _HASHES_AT_ONCE].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def simhash_column(text, shingle: int = 4):
    """The SimHash of a text column as a BIGINT (the 64 bits, signed).

    Lower-cased A-Z, words between ASCII white space, shingles of ``shingle``
    consecutive words joined by a space (a shorter text is one shingle); a bit
    is set when it is set in over half of the shingles' XXH64 values.  Null or
    blank text: 0."""
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([_simhash(x, shingle) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())
    return fingerprint(text)


def ball(bits: int, radius: int) -> list[int]:
    """The masks of up to ``radius`` set bits among ``bits``, zero first."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _forest(members: np.ndarray, distance: int, out: list) -> None:
    """Links of a spanning forest of the graph 'within ``distance`` bits'."""
    left = members
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(found.size, x), found]))
                queue.extend(found)
                left = left[~near]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (probe, first, second) to links; a group that goes on
    in the next batch is carried over."""
    carry = None

    def columns(batch):
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]

    def links(cols):
        key = np.stack(cols[:3])
        fps = cols[3].view(np.uint64)
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [fps.size]))
        size, out = last - first, []
        two = first[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
        out.append(np.stack([fps[two][near], fps[two + 1][near]]))
        for a, b in zip(first[size > 2], last[size > 2]):
            _forest(fps[a:b], distance, out)
        both = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        key = np.stack(cols[:3])
        same = (key == key[:, -1:]).all(0)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        carry = [c[cut:] for c in cols]
        if cut:
            yield links([c[:cut] for c in cols])
    if carry is not None:
        yield links(carry)


def near_links(fingerprints: DataFrame, max_distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``fp``: as a graph
    they connect exactly the fingerprints that a chain of steps of at most
    ``max_distance`` bits connects."""
    radius = (max_distance // 2 + 1) // 2  # on both sides: segments up to 2 * radius apart share a key
    masks = ball(32, radius)
    probes = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(m).cast("long").alias("mask"))
                                 for s in (0, 1) for m in masks]))
    half = F.when(F.col("p.segment") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) \
        .otherwise(F.shiftrightunsigned("fp", 32))
    filed = (fingerprints.select("fp", probes.alias("p"))
             .select("fp", F.col("p.mask").alias("mask"),
                     half.bitwiseXOR(F.col("p.mask")).bitwiseOR(F.shiftleft(F.col("p.segment").cast("long"), 33)).alias("probe")))
    # fingerprints with the same segment share all keys of its ball: they need only meet at the segment itself
    shared = (filed.groupBy("probe").agg(F.count("*").alias("n"), F.min("mask").alias("lo"), F.max("mask").alias("hi"))
              .filter((F.col("n") > 1) & ((F.col("lo") < F.col("hi")) | (F.col("hi") == 0)))
              .select("probe", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Spark sizes the exploded rows as if they were not: without the hint it would send all of them to the driver
    dealt = (filed.join(shared.hint("merge"), "probe").withColumn("own", own)
             .select("probe", "fp", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
             .select("probe", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "fp"))
    pairs = (dealt.repartition("probe", "first", "second").sortWithinPartitions("probe", "first", "second", "fp")
             .mapInArrow(lambda it: _links(it, max_distance), "a long, b long"))
    return pairs.distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``; the label is
    one node of the component.  Min-label propagation: every round takes the
    least label among the neighbours, hooks it to the tree of the old label,
    and jumps pointers; each round's labels are a written table."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")),
                         "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), "label")
        least = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(least, "node")
        proposals = (step.select(F.explode(F.array(
            F.struct("node", F.least("label", "least").alias("label")),
            F.struct(F.col("label").alias("node"), F.least("label", "least").alias("label")))).alias("p")).select("p.*"))
        hooked = proposals.groupBy("node").agg(F.min("label").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(hooked.join(jump, "label", "left")
                          .select("node", F.coalesce("next", "label").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def _groups(prints: DataFrame, max_distance: int, first: Column) -> DataFrame:
    """``fp, least`` for the distinct ``fp`` of ``prints``; ``least`` is the
    least value of ``first`` over the component."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    labels = components(near_links(nodes.select("fp"), max_distance))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("label", F.coalesce("label", "fp"))
    return named.join(named.groupBy("label").agg(F.min("first").alias("least")), "label").select("fp", "least")


def simhash_dedup(docs: DataFrame, shingle: int = 4, max_distance: int = 4,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the least id reachable over links.

    Null or empty text has fingerprint zero and links like any other; a null
    id gets a row, but names a group only if no other id does (then the
    component_id is null); repeated rows come back as often as they came in;
    an empty table gives no rows; further columns of ``docs`` are not read."""
    prints = materialise(docs.select(F.col(id_col), simhash_column(F.col(text_col), shingle).alias("fp")), "simhash")
    groups = _groups(prints, max_distance, F.col(id_col)).withColumnRenamed("least", "component_id")
    return prints.join(groups, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with
    the least id (a null id comes last), then the least text hash; of rows
    that repeat it exactly, one.  All columns stay as they are."""
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    prints = materialise(docs.select(F.col(id_col).alias("id"), text_key.alias("text_key"),
                                     simhash_column(F.col(text_col), shingle).alias("fp")), "simhash")
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("text_key"))
    # one 64-bit key finds a row, its parts confirm it: a broadcast of long keys stays small
    key = F.xxhash64(F.col("id").isNull(), F.col("id"), F.col("text_key"))
    keep = _groups(prints, max_distance, first).select("least.id", "least.text_key").distinct() \
        .select(key.alias("key"), F.col("id").alias("keep_id"), F.col("text_key").alias("keep_text"))
    rows = docs.select(packed(docs), F.col(id_col).alias("id"), text_key.alias("text_key"), row_hash(docs, SEED).alias("row_key"))
    kept = (rows.withColumn("key", key).join(keep, "key")
            .filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_text"))))
    same = Window.partitionBy("key", "id", "text_key").orderBy("row_key")
    return unpacked(kept.withColumn("copy", F.row_number().over(same)).filter("copy = 1"), docs.schema)
