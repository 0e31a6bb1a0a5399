"""I-Match document fingerprints with randomised lexicons.

Terms whose inverse document frequency lies in a band make the lexicon.  Each
of ``KNOWN`` fixed random subsets of it gives one part of a fingerprint: the
hash of the document's sorted distinct terms in that subset.  The subsets
halve in size from one to the next, as a part survives an edit if the subset
holds about one of the document's terms, and documents differ in length; there
are ``EACH`` of every size.  For texts with hardly a term in the band there are
subsets of the rarer words.  The number of parts that agree tells how many
terms two documents do not share, the number that neither has, how many they
have together; likeness is the shared part of these."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: The band: terms in at least one of ``RARE`` documents and at most one of
#: ``COMMON``.  The lexicon has at most ``RARE`` times a document's mean number
#: of distinct terms, whatever the corpus size.
RARE, COMMON = 1_000, 20
#: Subsets of the lexicon: ``EACH`` that hold one term in 1, 2, 4, ... 1,024;
#: of the rarer words: ``EACH_OTHER`` that hold one in 1, 2, ... 64.
EACH, HALVINGS = 9, 11
EACH_OTHER, HALVINGS_OTHER = 6, 7
#: What a word below the band counts beside one inside.
OUTSIDE = 0.25
KNOWN, OTHER = EACH * HALVINGS, EACH_OTHER * HALVINGS_OTHER
LEXICONS = KNOWN + OTHER
_FACTORS = np.random.Generator(np.random.PCG64(29)).integers(1, 1 << 31, LEXICONS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
#: A term is in a subset if half of its hash times the subset's factor is at most this.
_BOUNDS = np.array([(1 << 32 >> k) - 1 for k in np.repeat(np.arange(HALVINGS), EACH).tolist()
                    + np.repeat(np.arange(HALVINGS_OTHER), EACH_OTHER).tolist()], np.uint32)[:, None]
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 2_000_000
_AT_ONCE = 4096


def _within(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted array ``some``."""
    if not some.size:
        return np.zeros(h.size, bool)
    return some[np.minimum(np.searchsorted(some, h), some.size - 1)] == h


class Terms:
    """A text's terms as 64-bit hashes, whose last bit says whether the lexicon has them."""

    def __init__(self, lexicon: np.ndarray | None = None, common: np.ndarray | None = None):
        self.lexicon, self.common = (np.empty(0, np.uint64) if x is None else np.sort(x) for x in (lexicon, common))

    def of(self, text: bytes | str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's words (A-Z lower-cased, ASCII
        white space).  Words too common for the band are no terms, unless the
        text has no others."""
        raw = text.encode() if isinstance(text, str) else text or b""
        words = set(raw.lower().split())
        h = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & ~np.uint64(1))
        rest = h[~_within(h, self.common)]
        h = rest if rest.size else h
        return h | _within(h, self.lexicon)


def _parts(terms: np.ndarray, lexicons: slice) -> np.ndarray:
    """The hash of the sorted terms in each of the subsets; zero where a
    subset holds none.  A very long text in pieces: hashes of terms add up."""
    parts = np.zeros(LEXICONS, np.uint64)[lexicons]
    for at in range(0, terms.size, _AT_ONCE):
        t = terms[at:at + _AT_ONCE]
        inside = (t >> np.uint64(32)).astype(np.uint32) * _FACTORS[lexicons] <= _BOUNDS[lexicons]
        hashed = (t ^ (t >> np.uint64(29))) * _SCRAMBLE
        parts += np.where(inside, hashed, np.uint64(0)).sum(1, dtype=np.uint64)
    return parts


def fingerprint(text: bytes | str | None, terms: Terms) -> np.ndarray:
    """``LEXICONS`` 16-bit parts, zero where the text has no term in a subset."""
    t = terms.of(text)
    known = (t & np.uint64(1)).astype(bool)
    parts = np.concatenate([_parts(t[known], slice(0, KNOWN)), _parts(t[~known], slice(KNOWN, LEXICONS))])
    some = parts != 0
    short = (parts ^ (parts >> np.uint64(32))) * _SCRAMBLE >> np.uint64(48)
    return np.where(some, np.maximum(short, np.uint64(1)), np.uint64(0)).astype(np.uint16)


def _terms_by_misses(each: int, halvings: int) -> np.ndarray:
    """Number of terms by the number of subsets that hold none of them: k
    terms miss a subset of one in 2 ** h with probability (1 - 2 ** -h) ** k."""
    terms = np.concatenate(([0.0], np.geomspace(1e-3, 1e6, 4000)))
    misses = each * (1 - 0.5 ** np.arange(halvings)[:, None]) ** terms
    return np.interp(np.arange(each * halvings + 1), misses.sum(0)[::-1], terms[::-1])


_GROUPS = ((slice(0, KNOWN), _terms_by_misses(EACH, HALVINGS), 1.0),
           (slice(KNOWN, LEXICONS), _terms_by_misses(EACH_OTHER, HALVINGS_OTHER), OUTSIDE))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of shared terms among those of either (Jaccard): a part
    agrees if its subset misses all terms that are not shared, and neither
    has it if its subset misses all.  Two texts without words are alike."""
    same, none = a == b, (a | b) == 0
    apart = together = 0.0
    for group, terms, weight in _GROUPS:
        apart += weight * terms[np.count_nonzero(same[group])]
        together += weight * terms[np.count_nonzero(none[group])]
    return float(1 - apart / together) if together else 1.0


def as_bytes(parts: np.ndarray) -> bytes:
    return parts.astype(">u2").tobytes()


# --------------------------------------------------------------------- lexicon

def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, waiting, size = Terms(), [], 0

    def rows():
        found, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            waiting.append(terms.of(text))
            size += waiting[-1].size
            if size > _FLUSH:
                yield rows()
                waiting, size = [], 0
    if size:
        yield rows()


def term_bands(docs: DataFrame, text_col: str = "text", rare: int = RARE, common: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms in the band and of those too common for it,
    counted over all documents."""
    n = docs.count()
    counts = (docs.select(text_col).mapInArrow(_document_counts, "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).filter((F.col("n") * rare >= n) & (F.col("n") > 1))
              .select("term", (F.col("n") * common > n).alias("common")))
    found = [(r.term, r.common) for r in counts.toLocalIterator()]
    return tuple(np.sort(np.array([t for t, c in found if c == much], np.int64).view(np.uint64)) for much in (False, True))


def lexicon(docs: DataFrame, text_col: str = "text", rare: int = RARE, common: int = COMMON) -> np.ndarray:
    return term_bands(docs, text_col, rare, common)[0]


# ------------------------------------------------------- a document and its next

def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _report(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray, terms: Terms) -> tuple:
    new = edited(text, following).encode()
    changed = fingerprint(new, terms)
    return (doc_id, len(text), hashlib.sha256(new).hexdigest(), as_bytes(own), as_bytes(changed),
            likeness(own, changed), likeness(own, other))


_REPORT = "n_chars long, edited_sha256 string, own binary, changed binary, near_edited double, near_next double"


def compressed(text):
    """A text column, zstd-compressed for the sort."""
    @F.arrow_udf("binary")
    def compress(texts: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=3)
        return pa.array([z.compress(x) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())
    return compress(text)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bands: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is
    replaced by the start of the next document's (descending id, null ids
    last, ties by text hash; after the last comes the first).

    One range sort puts neighbours together; a task pairs its sorted rows as
    they stream by, and only the first and last row of each task meet their
    neighbours in a second, small step.  Null text: empty; repeated rows are
    documents of their own; an empty table gives no rows; a single row is its
    own next."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(term_bands(docs, text_col) if bands is None else bands)
    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    rows = (docs.select(F.col(id_col).alias("id"), compressed(text).alias("text"), F.xxhash64(text).alias("tie"))
            .repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text"))
    arrow_id = pa.schema([("id", _arrow_type(id_type))]).field("id").type
    schema = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("id", arrow_id),
                        ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("own", pa.binary()),
                        ("changed", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, first = TaskContext.get().partitionId(), None, None
        terms, z = Terms(*shared.value), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = z.decompress(packed)
                text, own = raw.decode(), fingerprint(raw, terms)
                if before is None:
                    first = text
                else:
                    out.append((part, "done", None) + _report(*before, text, own, terms))
                before = (doc_id, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if before is not None:
            ends = [(part, "first", first) + (None,) * 7, (part, "last", before[1], before[0]) + (None,) * 6]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in ends], schema)

    id_ddl = f"id {id_type.simpleString()}, "
    found = materialise(rows.mapInArrow(pair, "part int, kind string, text string, " + id_ddl + _REPORT), "imatch")
    # two rows per task: who is next to whom
    parts = found.filter("kind = 'first'").select("part")
    turn = Window.orderBy("part")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = parts.select("part", F.coalesce(F.lead("part").over(turn), F.min("part").over(whole)).alias("next"))
    ends = (found.filter("kind = 'last'").select("part", "id", "text").join(after, "part")
            .join(found.filter("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
            .select("id", "text", "following"))
    done_schema = pa.schema(list(schema)[3:])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(*shared.value)

        def own(text: str) -> np.ndarray:
            return fingerprint(text, terms)
        for batch in batches:
            rows = [_report(r["id"], r["text"], own(r["text"]), r["following"], own(r["following"]), terms) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(done_schema.names, r)) for r in rows], done_schema)

    done = found.filter("kind = 'done'").drop("part", "kind", "text")
    return done.union(ends.mapInArrow(finish, id_ddl + _REPORT)).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("changed")).alias("edited_fingerprint"), "near_edited", "near_next")


def _arrow_type(t) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)
