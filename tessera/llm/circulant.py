"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A set of word shingles is a set of points of a circle of 2 ** 32 places.  A
first permutation of the circle scatters the points; a second one gives each
place its rank.  Coordinate k of the signature is the least rank after the
second permutation was shifted by k places: two permutations make all
``COORDINATES``.  Each band of ``ROWS`` coordinates is a bucket.  Members of a
bucket whose signatures agree often enough are loosely linked, and all links
that there can be lie within the components of loose links.

Only distinct sets are nodes, so exact copies of any number cost one row.  The
texts of a loose component meet in one task, or block by block if it is large,
where one product of incidence matrices counts the shared shingles of all
pairs; what leaves the task is a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.simhash import components

#: A pair of similarity 0.8 shares no bucket with probability
#: (1 - 0.8 ** ROWS) ** (COORDINATES / ROWS) = 1.3e-7; at 0.82 it is 9e-9.
ROWS, COORDINATES = 5, 200
#: Bands that are looked through first; the others' buckets only matter where
#: they still join different components.
FIRST_BANDS = 8
#: Coordinates whose last byte travels with a set, to tell whether two sets of
#: a bucket may be similar: if they agree in no less than the similarity's
#: share by so many standard deviations of the binomial law.
SHORT, DEVIATIONS = 128, 6
#: Sets, and shingles in them, that a block holds at most.  A bucket or loose
#: component beyond that is dealt into blocks, compared by tasks of their own.
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: Ways in which a large component is dealt into blocks, each compared within
#: itself, before what is still apart is compared across blocks.
DEALS = 2
#: Rows of a table of two longs that may be broadcast.
BROADCAST_ROWS = 200_000

_U = np.uint64
_CACHE = 200_000


class _Words(dict):
    """Word to 64-bit hash, filled as words come, emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: bytes | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words
    (A-Z lower-cased, ASCII white space); a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    z = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        x = h[i:len(words) - size + 1 + i]
        z = (z ^ (z >> _U(31))) * _U(0x9E3779B97F4A7C15) + (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    z ^= z >> _U(29)
    z *= _U(0xFF51AFD7ED558CCD)
    z ^= z >> _U(32)
    return np.unique(z)


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the numbers below 2 ** 32, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(first)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(second)
    return x


_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, step: int = 512) -> np.ndarray:
    """``COORDINATES`` circulant minima of a non-empty set, a block of
    shingles at a time."""
    places = _permute((shingles >> _U(32)).astype(np.uint32), 0x21F0AAAD, 0x735A2D97)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, places.size, step):
        ranks = _permute(places[None, at:at + step] + _SHIFTS, 0x7FEB352D, 0x846CA68B)
        np.minimum(least, ranks.min(1), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of signatures."""
    rows = signatures.reshape(-1, COORDINATES // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, COORDINATES // ROWS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ (key >> _U(31)) ^ rows[:, :, i]) * _U(0x9E3779B97F4A7C15)
    return (key ^ (key >> _U(29))).view(np.int64)


_SUMMARY = pa.struct([("n", pa.int64()), ("set_key", pa.binary()), ("short", pa.binary()), ("bands", pa.list_(pa.int64()))])


def agree_at_least(percent: int) -> int:
    """Coordinates in which sets of that similarity agree: 75 of 128 for 80 %."""
    p = percent / 100
    return math.floor(SHORT * p - DEVIATIONS * math.sqrt(SHORT * p * (1 - p)))


def summary_column(text, size: int, percent: int):
    """Struct of the set's size, its 128-bit key, its short signature and its
    band keys (null where the set is so small that one shingle more or less is
    below ``percent``, so no different set can be linked)."""
    least = percent / (100 - percent) if percent < 100 else math.inf

    @F.arrow_udf("n long, set_key binary, short binary, bands array<long>")
    def summary(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.cast(pa.binary()).to_pylist():
            s = shingle_set(x, size)
            sig = signature(s) if s.size >= least else None
            out.append({"n": s.size, "set_key": xxhash.xxh3_128_digest(s.tobytes()) if s.size else None,
                        "short": None if sig is None else sig[:SHORT].astype(np.uint8).tobytes(),
                        "bands": None if sig is None else band_keys(sig)[0]})
        return pa.array(out, _SUMMARY)
    return summary(text)


def _compress(text):
    @F.arrow_udf("binary")
    def compress(texts: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=1)
        return pa.array([z.compress(x or b"") for x in texts.cast(pa.binary()).to_pylist()], pa.binary())
    return compress(text)


# ------------------------------------------------------------ sorted groups

def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Columns of the rows of whole groups (equal first ``keys`` columns), a
    batch's at a time; a group that goes on in the next batch is carried over."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) else np.array(c.to_pylist(), object)
                for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        key = np.stack(cols[:keys])
        same = (key == key[:, -1:]).all(0)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        carry = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if carry is not None:
        yield carry


def _bounds(cols: list, keys: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.stack(cols[:keys])
    first = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
    return first, np.diff(np.concatenate((first, [key.shape[1]])))


def _forest(size: int, near, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest; ``near(i, rest)`` tells which of the places
    ``rest`` are linked with i.  Places of one label count as linked."""
    links, rest = [], np.arange(size)
    while rest.size:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and rest.size:
            i = queue.pop()
            hit = near(i, rest)
            if label is not None:
                same = label[rest] == label[i]
                queue.extend(rest[same].tolist())
                rest, hit = rest[~same], hit[~same]
            links += [(i, j) for j in rest[hit].tolist()]
            queue.extend(rest[hit].tolist())
            rest = rest[~hit]
    return links


def _batch(links: list) -> pa.RecordBatch:
    both = np.unique(np.sort(np.concatenate(links, axis=1), axis=0), axis=1) if links else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(np.int64))], names=["a", "b"])


def _loose(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Bucket rows (key, first, second, node, label, n, short) to loose links
    between different labels."""
    least = agree_at_least(percent)
    for cols in _groups(batches, 3):
        first, size = _bounds(cols, 3)
        node, label, n = cols[3:6]
        short = np.frombuffer(b"".join(cols[6]), np.uint8).reshape(-1, SHORT)

        def near(i, j):
            alike = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            return alike & (np.count_nonzero(short[i] == short[j], axis=1) >= least)
        two = first[size == 2]
        two = two[(label[two] != label[two + 1]) & near(two, two + 1)]
        links = [np.stack([node[two], node[two + 1]])]
        for a, m in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            found = _forest(m, lambda i, rest, a=a: near(a + i, a + rest), label[a:a + m])
            if found:
                links.append(node[a + np.array(found).T])
        yield _batch(links)


# ------------------------------------------------------------- exact similarity

def shared_counts(sets: list[np.ndarray], rare: int = 16, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs (the diagonal is not one):
    shingles of few sets by their pairs, the others by products of 0/1
    matrices, ``columns`` at a time (exact in float32)."""
    m = len(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), [s.size for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([0], np.flatnonzero(flat[1:] != flat[:-1]) + 1)) if flat.size else np.empty(0, int)
    df = np.diff(np.concatenate((first, [flat.size])))
    count = np.zeros((m, m), np.float32)
    often = np.flatnonzero(df > rare)
    for at in range(0, often.size, columns):
        some = often[at:at + columns]
        rows = np.repeat(first[some] - np.cumsum(df[some]) + df[some], df[some]) + np.arange(df[some].sum())
        has = np.zeros((m, some.size), np.float32)
        has[owner[rows], np.repeat(np.arange(some.size), df[some])] = 1
        count += has @ has.T
    for gap in range(1, rare):  # members of one shingle that stand so far apart in its row
        at = first[(df > gap) & (df <= rare)]
        width = df[(df > gap) & (df <= rare)] - gap
        left = np.repeat(at - np.cumsum(width) + width, width) + np.arange(width.sum())
        np.add.at(count, (owner[left], owner[left + gap]), 1)
        np.add.at(count, (owner[left + gap], owner[left]), 1)
    return count.astype(np.int32)


def _exact(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (comp, first, second, node, label, text) to links on full sets."""
    z = zstandard.ZstdDecompressor()
    for cols in _groups(batches, 3):
        links: list = []
        for a, m in zip(*(x.tolist() for x in _bounds(cols, 3))):
            node, place = np.unique(cols[3][a:a + m], return_index=True)
            if node.size < 2:
                continue
            label = cols[4][a:a + m][place]
            sets = [shingle_set(z.decompress(t), size) for t in cols[5][a:a + m][place]]
            n = np.array([s.size for s in sets])
            if node.size == 2:
                both = np.full((2, 2), np.intersect1d(*sets, assume_unique=True).size)
            else:
                both = shared_counts(sets)
            # 100 * shared >= percent * (a + b - shared)
            linked = both * (100 + percent) >= percent * (n[:, None] + n[None, :])
            found = _forest(node.size, lambda i, rest: linked[i, rest], label)
            if found:
                links.append(node[np.array(found).T])
        yield _batch(links)


class _Sets:
    """The distinct sets of a table and the links between them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.size, self.percent = size, percent
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.texts_of = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        self.rows = materialise(self.texts_of.select("id", "text_key", summary_column(F.col("text"), size, percent).alias("s"))
                                .select("id", "text_key", "s.*"), "shingle-sets")
        first = F.struct(F.col("id").isNull().alias("last"), "id", "text_key", "n", "short", "bands")
        self.nodes = materialise(
            self.rows.filter("n > 0").groupBy("set_key").agg(F.min(first).alias("f"))
            .select("set_key", "f.*").withColumn("node", F.monotonically_increasing_id()), "set-nodes")

    def loose_links(self, bands, labels: DataFrame | None) -> DataFrame:
        """Links ``a, b`` in the buckets of some bands, between sets of
        different ``labels`` (None: all are different)."""
        nodes = self.nodes.filter("short IS NOT NULL")
        filed = nodes.select("node", F.explode(bands).alias("key"))
        if labels is None:
            filed = filed.withColumn("label", F.col("node"))
            shared = filed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        else:
            filed = filed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            shared = filed.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")) \
                .filter("lo < hi")
        shared = shared.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = (filed.join(shared, "key").withColumn("own", own)
                 .select("key", "node", "label", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
                 .select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "node", "label")
                 .join(nodes.select("node", "n", "short"), "node").select("key", "first", "second", "node", "label", "n", "short"))
        links = (dealt.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "node")
                 .mapInArrow(lambda it, p=self.percent: _loose(it, p), "a long, b long").distinct())
        return materialise(links, "loose-links")

    def loose_components(self) -> DataFrame:
        """``node, comp`` of the sets that may be linked with a different one."""
        labels = components(self.loose_links(F.slice("bands", 1, FIRST_BANDS), None))
        links = self.loose_links(F.slice("bands", FIRST_BANDS + 1, COORDINATES // ROWS), labels)
        more = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti") \
            .withColumn("label", F.col("node"))
        labels = labels.union(more)
        of = [labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
        between = links.join(of[0], "a").join(of[1], "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
        top = components(between).select(F.col("node").alias("label"), F.col("label").alias("comp"))
        return labels.join(top, "label", "left").select("node", F.coalesce("comp", "label").alias("comp"))

    def texts(self, comps: DataFrame) -> DataFrame:
        """``node, comp, n, text``: the compressed text of each of the nodes,
        found by id and text hash."""
        key = F.xxhash64(F.col("id").isNull(), F.col("id"), F.col("text_key"))
        wanted = materialise(comps.join(self.nodes.select("node", "id", "text_key", "n"), "node")
                             .select("node", "comp", "n", key.alias("key"), F.col("id").alias("want_id"),
                                     F.col("text_key").alias("want_text")), "wanted")
        rows = self.texts_of.withColumn("key", key)
        if wanted.count() <= BROADCAST_ROWS:
            found = rows.join(F.broadcast(wanted), "key")
        else:  # the join moves every text once, compressed
            found = rows.withColumn("text", _compress(F.col("text"))).join(wanted, "key")
        found = found.filter(F.col("id").eqNullSafe(F.col("want_id")) & (F.col("text_key") == F.col("want_text")))
        if dict(found.dtypes)["text"] == "string":
            found = found.withColumn("text", _compress(F.col("text")))
        return materialise(found.groupBy("node", "comp", "n").agg(F.min("text").alias("text")), "set-texts")

    def links(self, dealt: DataFrame) -> DataFrame:
        """Links within each (comp, first, second) of the rows."""
        rows = dealt.select("comp", "first", "second", "node", "label", "text")
        return materialise(rows.repartition("comp", "first", "second").sortWithinPartitions("comp", "first", "second", "node")
                           .mapInArrow(lambda it, k=self.size, p=self.percent: _exact(it, k, p), "a long, b long").distinct(),
                           "set-links")

    def linked(self) -> DataFrame:
        """``node, label`` of every set that is linked with a different one."""
        texts = self.texts(self.loose_components())
        size = texts.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).select("comp", F.greatest(
            F.ceil(F.col("m") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        size = materialise(size, "comp-sizes")
        none = F.lit(0)
        at_once = texts.join(size.filter("blocks = 1"), "comp").withColumns({"first": none, "second": none, "label": F.col("node")})
        links = self.links(at_once)
        if size.filter("blocks > 1").limit(1).count():
            large = texts.join(size.filter("blocks > 1"), "comp")
            labels, found = large.select("node", F.col("node").alias("label")), None
            for turn in range(DEALS):
                block = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")
                new = self.links(large.join(labels, "node").withColumns({"first": block, "second": block}))
                found = new if found is None else found.union(new)
                labels = self.labelled(large, found)
            links = links.union(found).union(self.links(self.across(large, labels)))
        return components(links)

    @staticmethod
    def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
        return materialise(nodes.select("node").join(components(links), "node", "left")
                           .withColumn("label", F.coalesce("label", "node")), "set-labels")

    @staticmethod
    def across(large: DataFrame, labels: DataFrame) -> DataFrame:
        """Every pair of sets of a large component that are still apart: those
        outside its most frequent label, a block at a time, meet every block."""
        rows = large.join(labels, "node")
        sizes = rows.groupBy("comp", "label").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
        main = sizes.groupBy("comp").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.sum("m").alias("all"),
                                         F.sum("shingles").alias("all_shingles"))
        rest = sizes.join(main, "comp").filter("label <> main").groupBy("comp", "main").agg(
            F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("rest_blocks"))
        rows = rows.join(rest, "comp")
        turn = F.xxhash64("node", F.lit(DEALS))
        outside = rows.filter("label <> main").withColumn("first", F.pmod(turn, F.col("rest_blocks")).cast("int"))             .withColumn("second", F.explode(F.expr("sequence(0, blocks - 1)")))
        all_of = rows.withColumn("second", F.pmod(turn, F.col("blocks")).cast("int"))             .withColumn("first", F.explode(F.expr("sequence(0, rest_blocks - 1)")))
        return outside.select(*all_of.columns).union(all_of)


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_shingles`` (size of its set of
    ``shingle``-word shingles; a shorter text is one), ``component_id`` (the
    least id reachable over links of Jaccard similarity ``percent`` / 100 or
    more) and ``kept`` (whether it is that id itself).

    Null, empty and blank texts have no shingles and are linked with nothing;
    texts are read whole at any length.  Repeated rows come back each; equal
    sets are linked.  A null id gets a row but names a component only if no
    other id does (then component_id is null and it is kept).  An empty table
    gives no rows; further columns of ``docs`` are not read.  The bands are
    made for a ``percent`` of 80 or more; a lower one is refused."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    sets = _Sets(docs, id_col, text_col, shingle, percent)
    named = sets.nodes.select("set_key", "node", "id").join(sets.linked(), "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))  # min leaves nulls out
    of = named.join(least, "label").select("set_key", "component_id")
    full = sets.rows.filter("n > 0").select("id", "n", "set_key").join(of, "set_key").select("id", "n", "component_id")
    blank = sets.rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(blank).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
