"""Spelling variants: words that differ by one letter, by a trie in tables.

The words are a trie whose edges are rows: ``(node, letter, child)``, and for
a replaced letter ``(node, letter, child)`` two steps down, over any letter in
between.  A search state is (word, position, node, edits).  A word's states
without an edit are its own prefixes; from each, an edit edge is taken by an
equi-join on the node and on the letter that has to follow the edit, so that
only states whose next letter fits come out of the join.  The frontier then
goes down level by level, one join with the edge table a level, and a state
that reaches the end of a word names a neighbour.

Each word is filed twice, forwards and backwards, and edits are looked for in
the second half of either: states start deep, where the trie has few branches.
A node with one word below is a leaf that holds it, so the number of levels is
that of shared prefixes, not that of letters.  Deletions stand for insertions
too, with the two words exchanged, and of two replacements only the one to the
later letter is looked for.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: A run is ``[A-Za-zÀ-ÿ]+``.  In UTF-8: ASCII letters and the byte C3
#: with its second byte; all other ASCII becomes a blank, A-Z become a-z.
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_FOREIGN = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
_FLUSH = 400_000
FORWARD, BACKWARD, END = ">", "<", "$"


def runs(text: bytes | None) -> list[bytes]:
    """Lower-cased maximal runs of letters, as UTF-8."""
    folded = (text or b"").translate(_FOLD)
    return _FOREIGN.sub(b" ", folded).split()


def damaged(run: bytes, doc: int, every: int) -> bytes:
    """The run, without one code point if ``every`` divides its draw; ``doc``
    is the CRC-32 of the document's id and a colon."""
    h = zlib.crc32(run, doc)
    if h % every:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _counts(batches: Iterator[pa.RecordBatch], least_letters: int, every: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()),
                                           pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            doc = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
            # bytes are at least as many as letters: shorter runs cannot reach the length
            for run, n in Counter([r for r in runs(text) if len(r) >= least_letters]).items():
                word = damaged(run, doc, every)
                if len(word) - word.count(b"\xc3") >= least_letters:
                    counts[word] += n
            if len(counts) > _FLUSH:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7,
                least_n: int = 2, every: int = 31) -> DataFrame:
    """``word, n`` of the words that ``spelling_variants`` compares."""
    return (docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
            .mapInArrow(lambda it: _counts(it, least_letters, every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n))


# ---------------------------------------------------------------------- the trie

def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts with the longest prefix each has in common with the text
    before or after it; at a task's ends, where a neighbour is not known, all
    of the text."""
    last, before = None, 0

    def out(texts, lengths):
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(lengths, pa.int32())], names=["text", "shared"])

    for batch in batches:
        texts, lengths = [], []
        for text in batch.column(0).to_pylist():
            if last is None:
                before = len(text)
            else:
                common = _common(last, text)
                texts.append(last)
                lengths.append(max(before, common))
                before = common
            last = text
        yield out(texts, lengths)
    if last is not None:
        yield out([last], [len(last)])


def _filed(words: DataFrame) -> DataFrame:
    """``text, shared, half``: each word forwards and backwards between its
    side's mark and the end mark, the prefix it shares with another, and the
    number of leading letters (with the mark) that stay as they are."""
    both = words.select(F.explode(F.array(F.concat(F.lit(FORWARD), "word", F.lit(END)),
                                          F.concat(F.lit(BACKWARD), F.reverse("word"), F.lit(END)))).alias("text"))
    lined = both.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(_shared, "text string, shared int")
    n = F.length("text") - 2
    half = F.when(F.col("text").startswith(FORWARD), F.floor(n / 2)).otherwise(F.ceil(n / 2)).cast("int") + 1
    return lined.withColumn("half", half).filter("shared >= half")


def _letter(text: Column | str, at: Column) -> Column:
    """The letter after the first ``at`` ones."""
    return F.substring(text, at + 1, F.lit(1))


def _edges(filed: DataFrame) -> DataFrame:
    """``node, letter, child, over, leaf``: a step down (``over`` null) or two
    steps over the letter ``over``; ``leaf`` is the only text below the child,
    null where there are several.

    A text's prefixes are needed from beyond its unedited half (that of a
    text one letter longer is no shorter) to one letter past the branch that it
    is alone on, as a step over a letter may jump that far."""
    deepest = F.least(F.length("text"), F.col("shared") + 2)
    depths = filed.select("text", F.explode(F.sequence(F.col("half") + 1, deepest)).alias("depth"))
    nodes = depths.select(F.substring("text", F.lit(1), F.col("depth")).alias("child"), "text") \
        .groupBy("child").agg(F.count("*").alias("n"), F.min("text").alias("leaf"))
    size = F.length("child")
    child = nodes.withColumn("leaf", F.when(F.col("n") == 1, F.col("leaf")))
    step = F.struct(F.substring("child", F.lit(1), size - 1).alias("node"), F.lit(None).cast("string").alias("over"))
    skip = F.struct(F.substring("child", F.lit(1), size - 2).alias("node"), _letter("child", size - 2).alias("over"))
    return (child.filter(size > 1).select("child", "leaf", _letter("child", size - 1).alias("letter"),
                                          F.explode(F.when(size > 2, F.array(step, skip)).otherwise(F.array(step))).alias("e"))
            .select("e.node", "letter", "child", "e.over", "leaf"))


def _arrived(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``text, other`` of the states whose leaf ends like the text, and the
    states with several words below, which go on."""
    rest = F.substring("text", F.col("position") + 1, F.length("text"))
    ends = states.filter(F.col("leaf").isNotNull()) \
        .filter(rest == F.substring("leaf", F.length("child") + 1, F.length("leaf")))
    return (ends.select("text", F.col("leaf").alias("other")),
            states.filter(F.col("leaf").isNull()).select("text", "position", F.col("child").alias("node")))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, other``: every ordered pair of words one letter inserted,
    deleted or replaced apart, once."""
    filed = materialise(_filed(words), "filed")
    edges = materialise(_edges(filed), "edges")
    # states without an edit: the shared prefixes from the middle on; the letter after the edited one must follow
    last = F.least(F.length("text") - 2, F.col("shared"))
    start = filed.filter(last >= F.col("half")).select("text", F.explode(F.sequence(F.col("half"), last)).alias("position"))
    start = start.select("text", "position", F.substring("text", F.lit(1), F.col("position")).alias("node"),
                         _letter("text", F.col("position")).alias("edited"), _letter("text", F.col("position") + 1).alias("letter"))
    edit = start.join(edges, ["node", "letter"]).filter(F.col("over").isNull() | (F.col("over") > F.col("edited"))) \
        .select("text", (F.col("position") + 2).alias("position"), "child", "leaf")
    steps = edges.filter("over IS NULL").drop("over")
    found = []
    frontier = materialise(edit, "frontier")
    while True:
        ended, going = _arrived(frontier)
        found.append(ended)
        if not going.limit(1).count():
            break
        going = going.withColumn("letter", _letter("text", F.col("position")))
        frontier = materialise(going.join(steps, ["node", "letter"])
                               .select("text", (F.col("position") + 1).alias("position"), "child", "leaf"), "frontier")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)

    def plain(text: str) -> Column:
        letters = F.substring(text, F.lit(2), F.length(text) - 2)
        return F.when(F.col(text).startswith(BACKWARD), F.reverse(letters)).otherwise(letters)

    pairs = pairs.select(plain("text").alias("a"), plain("other").alias("b"))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")) \
        .select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the rows ``word, form`` of an acyclic table with one
    row per word: pointer doubling, a join a round."""
    far = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not far.join(onward, "root").limit(1).count():
            return far
        far = materialise(far.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7,
                      least_n: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """One row per word: ``word``, its ``n`` occurrences, ``n_near`` words one
    letter inserted, deleted or replaced away, ``form`` (the most frequent of
    them, of equals the least in code-point order, if it occurs ``times`` as
    often or more, else null), ``form_n`` and ``root`` (the last word over
    forms; the word itself if it has none).

    Words are the lower-cased runs of letters of whole texts of at least
    ``least_letters`` letters and ``least_n`` occurrences; a run whose draw
    (CRC-32 of id, colon and run) ``every`` divides loses one letter first.
    Null and empty texts have no words; a null id is written ``null``; repeated
    rows count each; runs of any length are compared; an empty table gives no
    rows; further columns of ``docs`` are not read."""
    words = materialise(word_counts(docs, id_col, text_col, least_letters, least_n, every), "words")
    of = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the least of (-n, word) is the most frequent, of equals the first
    best = neighbours(words.select("word")).join(of, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("best_n"),
        F.col("best.other").alias("best")), "near")
    enough = F.col("best_n") >= F.col("n") * times
    rows = rows.select("word", F.when(enough, F.col("best")).alias("form"), "n", "n_near",
                       F.when(enough, F.col("best_n")).alias("form_n"))
    named = rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
