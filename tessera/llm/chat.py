"""Chat formatting of reply trees.

Messages form trees.  Iterative self-joins (pointer doubling) give every
message its distance and score to the root and then enumerate the root-to-leaf
paths; branches are ranked by score, and each chosen path is formatted as one
conversation.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: ``<``, n backslashes and ``|`` get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break becomes a control string, as the role ends at one."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def _ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(conv, node, jump, score, depth)`` with the sums up to the root, and
    the tables that lead 1, 2, 4, ... messages up.  One self-join a round,
    log2 of the deepest tree rounds; a message that never reaches a root (its
    parents form a circle) keeps a jump."""
    links = nodes.select("conv", "node", F.col("parent").alias("jump"), "score", F.lit(1).cast("long").alias("depth"))
    known = links.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    state = materialise(links.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("jump") == F.col("n")), "left")
                        .select("conv", "node", F.col("n").alias("jump"), "score", "depth"), "chat-links")
    limit, steps = state.count().bit_length(), []
    while True:
        steps.append(state.filter("jump is not null").select("conv", "node", "jump"))
        if len(steps) > limit or not steps[-1].limit(1).count():
            return state, steps
        up = state.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("jump").alias("j"),
                          F.col("score").alias("s"), F.col("depth").alias("d"))
        # messages whose jump has reached the root are done
        higher = (state.filter("jump is not null").join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("jump") == F.col("n")))
                  .select("conv", "node", F.col("j").alias("jump"), (F.col("score") + F.col("s")).alias("score"),
                          (F.col("depth") + F.col("d")).alias("depth")))
        state = materialise(state.filter("jump is null").union(higher), "chat-links")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path of the messages ``(conv, node, parent, role,
    text, score)``: ``conv``, ``leaf``, ``branch_score`` (mean score of its
    messages), ``branch_rank``, ``n_turns``, ``formatted`` and ``loss_spans``
    (code point ranges of the assistant texts, as formatted).

    A parent that does not exist makes a root; the best ``branches`` leaves of
    each conversation are chosen by score, then by node.  Null role or text:
    empty; a null conversation id is one conversation.  ``node`` must be
    unique in a conversation; messages on or below a circle have no path.
    A formatted conversation is one row; nothing else gathers a group."""
    nodes = materialise(nodes.select("conv", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                                     F.coalesce("text", F.lit("")).alias("text"),
                                     F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    state, steps = _ancestors(nodes)
    parents = steps[0].select(F.col("conv").alias("c"), F.col("jump").alias("n")).distinct()
    leaves = (state.filter("jump is null").join(
        parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
        .withColumn("branch_score", F.col("score") / F.col("depth")))
    best = Window.partitionBy("conv").orderBy(F.desc("branch_score"), "node")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(best)).filter(F.col("branch_rank") <= branches)
    paths = leaves.select("conv", F.col("node").alias("leaf"), "branch_score", "branch_rank", "node",
                          F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(steps):
        if k and not step.limit(1).count():
            break
        higher = (paths.join(step.select(F.col("conv").alias("c"), F.col("node").alias("n"), "jump"),
                             F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
                  .select("conv", "leaf", "branch_score", "branch_rank", F.col("jump").alias("node"),
                          (F.col("up") + (1 << k)).alias("up")))
        paths = materialise(paths.union(higher), "chat-paths")
    said = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role",
                        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
                        escape(F.col("text")).alias("body"))
    by = Window.partitionBy("conv", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = (paths.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
             .withColumn("part", F.concat("head", "body", F.lit(END + "\n")))
             .withColumn("at", F.coalesce(F.sum(F.length("part")).over(by), F.lit(0)) + F.length("head")))
    span = F.when(F.col("role") == "assistant", F.struct(
        F.col("at").cast("long").alias("start"), (F.col("at") + F.length("body")).cast("long").alias("end")))
    turn = F.struct((-F.col("up")).alias("order"), F.col("part"), span.alias("span"))
    return (turns.groupBy("conv", "leaf", "branch_score", "branch_rank")
            .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv", "leaf", "branch_score", "branch_rank", F.size("turns").cast("long").alias("n_turns"),
                    F.array_join("turns.part", "").alias("formatted"),
                    F.filter("turns.span", lambda x: x.isNotNull()).alias("loss_spans")))


def read_back(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring(F.substring_index(p, "\n", 1), len(START) + 1, 1 << 30)).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_nodes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of a table of turns as trees that do not branch: each row
    replies to the one before it by turn (null first; ties by role, then
    text).  The score is the length of an assistant's text."""
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                                F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    score = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)
    return rows.select("conv", node.alias("node"), "role", "text", score.alias("score")) \
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
