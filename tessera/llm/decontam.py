"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of all benchmark items scans every document once; hits are mapped
back to the original text."""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, packed, unpacked

#: Bytes that are no part of a word become a blank, A-Z become a-z, all else
#: stays: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))
#: Pattern characters in one automaton (about 60 bytes of memory each), and
#: automata that a worker holds.  A benchmark beyond one automaton is cut in
#: several, one scan each; beyond all that a worker holds, the documents are
#: gone through once more, so that none is built twice for one batch.
AUTOMATON_CHARS, HELD = 1_500_000, 3
_AUTOMATA: OrderedDict = OrderedDict()

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STATE = "n_words long, spans array<struct<start:int,end:int,from_char:int,to_char:int>>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``text, items``: each distinct window of ``window`` words (a shorter
    item is one), framed by blanks, with the sorted ids of the items that have
    it."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                            F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = rows.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("text"))
    return each.groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(key: str, patterns: dict[bytes, list[str]]):
    """Built once per Python worker, as long as it holds no more than ``HELD``."""
    if key not in _AUTOMATA:
        while len(_AUTOMATA) >= HELD:
            _AUTOMATA.popitem(last=False)
        a = ahocorasick.Automaton()
        for p, items in patterns.items():
            a.add_word(p.decode("latin-1"), (len(p), items))
        if patterns:
            a.make_automaton()
        _AUTOMATA[key] = a
    _AUTOMATA.move_to_end(key)
    return _AUTOMATA[key]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan_text(automaton, text: bytes | None, before: dict | None = None) -> dict:
    """Hit word ranges ``[start, end)`` with their code point offsets in the
    original, and the items that occur, joined with an earlier scan's."""
    folded = (text or b"").translate(_FOLD)
    w = folded.split()
    items = set(before["items"]) if before else set()
    ranges = [(s["start"], s["end"]) for s in before["spans"]] if before else []
    old = len(ranges), len(items)
    if w and len(automaton):
        flat = b" " + b" ".join(w) + b" "
        blanks = None
        for end, (length, of) in automaton.iter(flat.decode("latin-1")):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
            a, b = np.searchsorted(blanks, [end - length + 1, end])
            ranges.append((int(a), int(b)))
            items.update(of)
    if before and (len(ranges), len(items)) == old:
        return before
    spans = []
    if ranges:
        at = [m.span() for m in re.finditer(rb"[^ ]+", folded)]  # same length as the original bytes
        raw, seen, chars = text, 0, 0
        for a, b in _merge(ranges):
            start, end = at[a][0], at[b - 1][1]
            chars += len(raw[seen:start].decode())
            first = chars
            chars += len(raw[start:end].decode())
            seen = end
            spans.append({"start": a, "end": b, "from_char": first, "to_char": chars})
    return {"n_words": len(w), "spans": spans, "items": sorted(items)}


def _scanner(shared, key: str):
    @F.arrow_udf(STATE)
    def first(texts: pa.Array) -> pa.Array:
        a = _automaton(key, shared.value)
        return pa.array([scan_text(a, x) for x in texts.cast(pa.binary()).to_pylist()], _STATE)

    @F.arrow_udf(STATE)
    def again(texts: pa.Array, states: pa.Array) -> pa.Array:
        a = _automaton(key, shared.value)
        return pa.array([scan_text(a, x, s) for x, s in zip(texts.cast(pa.binary()).to_pylist(), states.to_pylist())],
                        _STATE)
    return first, again


_STATE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("from_char", pa.int32()), ("to_char", pa.int32())]))),
    ("items", pa.list_(pa.string()))])


def _blocks(windows) -> list[dict[bytes, list[str]]]:
    blocks, size = [{}], 0
    for text, items in windows:
        p = f" {text} ".encode()
        if size + len(p) > AUTOMATON_CHARS and blocks[-1]:
            blocks.append({})
            size = 0
        blocks[-1][p] = items
        size += len(p)
    return blocks


def _groups(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, text_col: str) -> list[list]:
    """The scanners of the benchmark's automata, as many at a time as a worker
    holds.  Its distinct windows are made by Spark and broadcast block by
    block: the operator's dictionary, which every task needs whole."""
    found = item_windows(benchmark, window, item_col, text_col).orderBy("text").toLocalIterator()
    job, context = uuid.uuid4().hex, docs.sparkSession.sparkContext
    scanners = [_scanner(context.broadcast(b), f"{job}-{i}") for i, b in enumerate(_blocks((r[0], r[1]) for r in found))]
    return [scanners[i:i + HELD] for i in range(0, len(scanners), HELD)]


def _chain(group: list, text: Column, state: Column | None = None) -> Column:
    for first, again in group:
        state = first(text) if state is None else again(text, state)
    return state


def _scanned(docs: DataFrame, columns: list[str], groups: list[list], text: Column) -> DataFrame:
    """``row`` (the columns packed) and ``scan``; a pass and a written table
    for each further group of automata."""
    rows = docs.select(packed(docs.select(*[F.col(f"`{c}`") for c in columns])), text.alias("text")) \
        .withColumn("scan", _chain(groups[0], F.col("text")))
    for group in groups[1:]:
        rows = materialise(rows, "scan").withColumn("scan", _chain(group, F.col("text"), F.col("scan")))
    return rows.select("row", "scan")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: the id, ``n_words``, ``n_hit`` (words inside any window),
    ``items`` (ids of items with a window in the text, as sorted strings) and
    ``spans`` (word ranges and code point offsets in the original text).

    Null or blank text has no words and no hits; an item without words matches
    nothing; a null item id is written ``null``; repeated items count once;
    repeated rows come back each; no benchmark rows: nothing is hit."""
    rows = _scanned(docs, [id_col], _groups(docs, benchmark, window, item_col, item_text_col), F.col(f"`{text_col}`"))
    hit = F.aggregate("scan.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rows.select(F.col("row").getField(id_col).alias(id_col), F.col("scan.n_words").alias("n_words"), hit.alias("n_hit"),
                       F.col("scan.items").alias("items"), F.col("scan.spans").alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; a null or
    empty text holds none, and an empty table stays empty.  All columns stay
    as they are."""
    groups, text = _groups(docs, benchmark, window, item_col, item_text_col), F.col(f"`{text_col}`")
    if len(groups) == 1:
        return docs.filter(F.size(_chain(groups[0], text).getField("items")) == 0)
    return unpacked(_scanned(docs, docs.columns, groups, text).filter(F.size("scan.items") == 0), docs.schema)
