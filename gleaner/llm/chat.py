"""Reply trees as formatted conversations, with DataFrame functions only.

Messages point to the message they answer. Self-joins that double their reach
with every turn find, for each message, how long its path to the root is and
what it scores; branches are ranked by that; then the chosen paths alone are
spelled out, each message found from its leaf by one join for each bit of its
distance. So a conversation of ``n`` turns takes ``log2(n)`` joins, and nothing
grows with the square of its depth.

Template, one turn after the other::

    <|im_start|>role
    text<|im_end|>

In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``; in roles a
line feed gets a backslash before it. So no control string and no end of a role
can arise from them, and dropping each backslash that starts a pair restores
them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.store import stored

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations (``conv_id, turn, role, text``): each answers the one before it.

    Equal turn numbers are ordered by role and text, nulls first; repeated rows
    stay. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.where("conv_id is not null").withColumn("_at", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", F.col("_at").alias("msg_id"), F.when(F.col("_at") > 1, F.col("_at") - 1).alias("parent_id"),
                           "role", "text", F.lit(0.0).alias("score"))


def formatted(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best branches of each reply tree, each as one conversation.

    ``messages`` has ``conv_id, msg_id, parent_id, role, text, score``; other
    columns are ignored. Returns ``conv_id, branch, leaf_id, branch_score,
    n_turns, formatted, loss_spans``: branches from 1 by the mean score of their
    messages (a null score counts 0), ties to the smaller leaf id; spans are the
    code points of the texts of ``assistant``, without their end marks.
    ``branches=None`` formats all.

    Null roles and texts are empty. Rows without ``conv_id`` or ``msg_id`` are
    left out; of rows that share both, the first by parent, role, text and score
    counts. A message whose parent is missing is a root, and a tree may have
    several. Messages on a circle of answers, or below one, lead to no root and
    are left out.
    """
    rows = (messages.where("conv_id is not null and msg_id is not null").groupBy("conv_id", "msg_id")
            .agg(F.min(F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                                F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")))
    rows = stored(rows.select("conv_id", F.col("msg_id").alias("node"), "m.*"))
    reach, levels = _reach(rows)
    turns = _turns(rows, _branches(rows, reach, branches), levels)
    return _joined(turns)


def _reach(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Turns and score from each message to its root; ancestors 1, 2, 4... steps up."""
    here = rows.select("conv_id", F.col("node").alias("parent_id"), F.lit(True).alias("_there"))
    now = rows.select("conv_id", "node", "parent_id", "score").join(here, ["conv_id", "parent_id"], "left").select(
        "conv_id", "node", F.when(F.col("_there"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"))
    now = stored(now)
    largest = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    levels: list[DataFrame] = []
    while 2 ** len(levels) <= largest:
        levels.append(now.where("up is not null").select("conv_id", "node", "up"))
        if levels[-1].isEmpty():
            levels.pop()
            break
        # Messages whose path is complete are looked up, but not joined any more.
        above = now.select("conv_id", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"), F.col("total").alias("_total"))
        longer = now.where("up is not null").join(above, ["conv_id", "up"]).select(
            "conv_id", "node", F.col("_up").alias("up"), (F.col("n") + F.col("_n")).alias("n"), (F.col("total") + F.col("_total")).alias("total"))
        now = stored(longer.unionByName(now.where("up is null")))
    return now.where("up is null"), levels


def _branches(rows: DataFrame, reach: DataFrame, branches: int | None) -> DataFrame:
    """``conv_id, leaf_id, n, branch, branch_score`` of the chosen leaves."""
    answered = rows.select("conv_id", F.col("parent_id").alias("node")).where("node is not null").distinct()
    leaves = reach.join(answered, ["conv_id", "node"], "left_anti")
    best_first = Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), F.asc("leaf_id"))
    ranked = leaves.select("conv_id", F.col("node").alias("leaf_id"), "n", (F.col("total") / F.col("n")).alias("branch_score"))
    ranked = ranked.withColumn("branch", F.row_number().over(best_first).cast("long"))
    return ranked if branches is None else ranked.where(F.col("branch") <= branches)


def _turns(rows: DataFrame, chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The messages of the chosen paths, ``at`` 0 for the root.

    A message ``d`` steps from its leaf takes the steps of ``d``'s bits, the
    largest first; it enters where its largest bit is taken, so that a long path
    doesn't send the short ones through its joins.
    """
    chosen = stored(chosen)

    def entering(low: int, end: int) -> DataFrame:
        there = chosen.where(F.col("n") > low)
        back = F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(end), F.col("n")) - 1))
        return there.withColumn("_back", back).withColumn("node", F.col("leaf_id"))

    steps = None
    for k in reversed(range(len(levels))):
        fresh = entering(1 << k, 1 << (k + 1))
        steps = fresh if steps is None else steps.unionByName(fresh)
        moves = F.col("_back").bitwiseAND(F.lit(1 << k)) != 0
        steps = (steps.join(levels[k].withColumnRenamed("up", "_up"), ["conv_id", "node"], "left")
                 .withColumn("node", F.when(moves, F.col("_up")).otherwise(F.col("node"))).drop("_up"))
    steps = entering(0, 1) if steps is None else steps.unionByName(entering(0, 1))
    return (steps.withColumn("at", F.col("n") - 1 - F.col("_back"))
            .join(rows.select("conv_id", "node", "role", "text"), ["conv_id", "node"]))


def _joined(turns: DataFrame) -> DataFrame:
    keys = ["conv_id", "branch", "leaf_id", "branch_score"]
    role = F.replace(_escaped("role"), F.lit("\n"), F.lit("\\\n"))
    parts = turns.select(*keys, "at", F.concat(F.lit(START), role, F.lit("\n")).alias("_head"), _escaped("text").alias("_body"),
                         (F.col("role") == LEARNED).alias("_learned"))
    parts = parts.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    before = F.sum(F.length("_piece")).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_start", (F.coalesce(before, F.lit(0)) + F.length("_head")).cast("long"))
    parts = parts.withColumn("_end", (F.col("_start") + F.length("_body")).cast("long"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "_piece", "_start", "_end", "_learned"))).alias("_t"))
    return whole.select(
        *keys, F.size("_t").cast("long").alias("n_turns"), F.array_join(F.transform("_t", lambda t: t["_piece"]), "").alias("formatted"),
        F.transform(F.filter("_t", lambda t: t["_learned"]), lambda t: F.struct(t["_start"].alias("start"), t["_end"].alias("end"))).alias("loss_spans"))


def _escaped(column: str) -> Column:
    doubled = F.replace(F.col(column), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def plain(escaped: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(escaped, r"(?s)\\(.)", "$1")


def read_turns(text: Column) -> Column:
    """Roles and texts of a formatted conversation, as an array of structs."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    pattern = (r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$")
    return F.transform(pieces, lambda p: F.struct(
        plain(F.regexp_extract(p, pattern, 1)).alias("role"), plain(F.regexp_extract(p, pattern, 2)).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: plain(F.substr(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
