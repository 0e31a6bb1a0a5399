"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle order, offered
again pass by pass.  A document's virtual finish time is its source's
cumulative words up to its end, divided by the source's target; the mix is the
global order of finish times, cut where the total budget is reached.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise, packed, row_hash, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_PASSES = 2
#: Rows that one task orders: the shuffle order and the finish times are cut
#: in ranges this small (1,024 at least).  The result is the same for any number.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(key: Column, seed: int) -> Column:
    """A seeded 64-bit draw as 16 hex digits (md5, so that SQL engines agree)."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 16)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size, target, quota`` from rows ``(source, size)``.

    Sources by code point (null last) weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``max_passes`` times its
    source's words and the excess goes to the others by weight.  Solved at
    once: if the first sources in the order of limit / weight stop at their
    limits, the others get a level per weight, and that level is greatest at
    just the right number of stopped sources.  ``quota``
    is the target in whole words; the quotas sum to the budget.  The windows
    run over one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = (per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
           .withColumn("cap", (F.col("source_size") * max_passes).cast("double")))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * share - filled) / open_weight)
    per = per.withColumn("target", F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight")))
    upto = F.floor(F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) + 1e-6)
    return (per.withColumn("upto", upto)
            .withColumn("quota", (F.col("upto") - F.coalesce(F.lag("upto").over(by_name), F.lit(0))).cast("long"))
            .select("source", "source_size", "target", "quota"))


def fair_queue(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """Packets of the mix of ``rows`` (``source``, ``size`` and ``draw``, the
    hex digits of a shuffle order; other columns are carried).

    One row per document and packet: ``source_size``, ``target``, ``place``
    (with ``source`` and ``draw`` it names the row), ``pass``, ``finish``,
    ``position`` (words before it in the mix) and ``taken`` (its words).  A
    document across its source's quota is cut there.  Quotas sum to the
    budget, so exactly the packets that finish after time 1 lie beyond it;
    they are cut before the sort, and a document without any packet left has
    one row with a null pass and nothing taken."""
    rows = materialise(rows, "mix-rows")
    n, ranges = rows.count(), 1024
    while ranges * RANGE_ROWS < n:
        ranges *= 2
    digits = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("range", F.floor(digits * ranges / float(1 << 32)).cast("long"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
               .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("o")
               .join(source_targets(rows, weights, share, max_passes).alias("t"),
                     F.col("o.source").eqNullSafe(F.col("t.source")))
               .select(F.col("o.source").alias("of"), F.col("range").alias("in"), "before", "source_size", "target", "quota"))
    offsets = materialise(offsets, "mix-offsets")
    in_range = Window.partitionBy("source", "range").orderBy("draw", "size")
    queue = (rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in"))).drop("of", "in")
             .withColumn("place", F.row_number().over(in_range))
             .withColumn("start", F.col("before") + F.coalesce(
                 F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    packets = F.array(*[F.struct(F.lit(p).alias("pass"), (F.lit(p) * F.col("source_size") + F.col("start")).alias("from"))
                        for p in range(max_passes)])
    packets = F.filter(F.transform(packets, lambda x: F.struct(
        x["pass"].alias("pass"), x["from"].alias("from"),
        F.least(F.col("size"), F.col("quota") - x["from"]).alias("words"))), lambda x: x["words"] > 0)
    packets = (queue.withColumn("packet", F.explode_outer(packets))
               .withColumn("pass", F.col("packet.pass"))
               .withColumn("taken", F.coalesce("packet.words", F.lit(0).cast("long")))
               .withColumn("finish", (F.col("packet.from") + F.col("packet.words")) / F.col("quota"))
               # rows without packets are spread over ranges below zero
               .withColumn("time_range", F.coalesce(F.floor(F.col("finish") * ranges), -1 - F.col("range")).cast("long"))
               .drop("packet", "range", "before", "start", "quota"))
    packets = materialise(packets, "mix-packets")
    begun = (packets.groupBy("time_range").agg(F.sum("taken").alias("words"))
             .select(F.col("time_range").alias("in"), F.coalesce(F.sum("words").over(
                 Window.orderBy("time_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    in_time = (Window.partitionBy("time_range").orderBy("finish", "source", "pass", "draw", "place")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (packets.join(begun, F.col("time_range") == F.col("in"))
            .withColumn("position", F.when(F.col("pass").isNotNull(), F.col("before") + F.coalesce(
                F.sum("taken").over(in_time), F.lit(0))))
            .drop("in", "before", "time_range"))


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES, seed: int = 11,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: the id, ``size`` (words), ``source``, ``source_size``,
    ``target``, ``taken`` (words the mix takes, passes added up), ``passes``
    and ``first_position`` (where the mix first has it; null: never).

    Null or blank text has no words and is never taken; a null source is a
    source, the last; repeated rows are documents of their own; an empty table
    gives no rows.  Deterministic in the rows and the seed."""
    rows = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"),
                       F.col(source_col).alias("source"), shuffle_key(F.col(id_col), seed).alias("draw"))
    return (fair_queue(rows, weights, share, max_passes)
            .groupBy("source", "draw", "place", "id", "size", "source_size", "target")
            .agg(F.sum("taken").alias("taken"), F.count("pass").alias("passes"), F.min("position").alias("first_position"))
            .select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target",
                    "taken", "passes", "first_position"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES, seed: int = 11,
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix has it,
    globally sorted by position.  Texts are not cut: a pass counts if the
    quota reaches at least half of the document's words.

    Rows equal in all columns share their passes evenly."""
    key = F.lower(F.lpad(F.hex(row_hash(docs, seed)), 16, "0"))
    rows = docs.select(key.alias("draw"), word_count(F.col(f"`{text_col}`")).alias("size"),
                       F.col(f"`{source_col}`").alias("source"))
    passes = (fair_queue(rows, weights, share, max_passes).filter(F.col("taken") * 2 >= F.col("size"))
              .filter(F.col("pass").isNotNull())
              .groupBy("draw").agg(F.sort_array(F.collect_list("position")).alias("positions")))
    keyed = docs.select(packed(docs), key.alias("draw")).join(passes, "draw")
    same = Window.partitionBy("draw")
    copy = (F.row_number().over(same.orderBy("draw")) - 1).alias("copy")
    dealt = keyed.select("row", "positions", copy, F.count("*").over(same).alias("copies"))
    placed = dealt.select("row", F.explode(F.filter(
        F.transform("positions", lambda p, i: F.when(i % F.col("copies") == F.col("copy"), p)),
        lambda p: p.isNotNull())).alias("position"))
    return unpacked(placed.repartitionByRange("position").sortWithinPartitions("position"), docs.schema)
