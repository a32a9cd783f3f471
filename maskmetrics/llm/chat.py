"""Reply trees to training conversations.

Messages form trees by their parents.  Iterative self-joins with doubled jumps find every
message's root, depth and path score, then every ancestor of the leaves that were chosen:
after ``k`` joins, paths of ``2 ** k`` messages are done.  Each join is an equi-join on (tree,
message), whose keys are unique, so the joins spread a long conversation over all tasks.  The output is one value
per conversation, so numbering the turns of a conversation (:func:`linear_trees`) and putting its texts together (:func:`format_paths`) are each done by one task, which holds that conversation.

The template marks a turn as ``<|im_start|>role`` line feed ``text<|im_end|>`` line feed.  Inside roles
and texts every ``<``, backslashes, ``|`` gets one more backslash, so no control string is left and
the escape is undone by taking one away.  The line feed of a role is written ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_files, materialise

START, END = "<|im_start|>", "<|im_end|>\n"
SPANS = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(text: Column) -> Column:
    return escape(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(text: Column) -> Column:
    halves = F.split(unescape(text), r"\\\\", -1)  # pairs of backslashes
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def linear_trees(turns: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as trees of one branch: ``tree, node, parent, score, role, text``.

    Turns are numbered from 0 in the order of turn (nulls first), role and text, so that ties and repeated rows each keep a place;
    each answers the one before it.  Null roles and texts count as empty; rows with a null ``conv_id`` are one conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = (F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")) - 1).cast("long")
    rows = rows.withColumn("node", node)
    return rows.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def best_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """The messages of the chosen root-to-leaf paths: ``tree, leaf, branch, depth, role, text``.

    ``messages(tree, node, parent, score, role, text)``: ``parent`` is null at a root; a message whose parent is missing is a root too.
    Leaves are ranked within their tree by the mean score of their path, then by leaf id; ``branch`` is that rank from 0, and
    ``branches`` keeps so many per tree (all if None).  A message on a cycle of parents has no root and is not on any path.
    """
    own = messages.select(F.col("tree"), F.col("node"), F.col("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"))
    roots = own.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = own.join(roots, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    # sum and length cover the messages from the node up to, not including, up
    jump = materialise(jump.select("tree", "node", F.col("n").alias("up"), "sum", F.lit(1).cast("long").alias("length")), "jump")
    limit = messages.count().bit_length() + 1
    done, active = jump.where("up is null"), [jump.where("up is not null")]
    while not active[-1].isEmpty() and len(active) <= limit:
        # only messages that have not come to their root are joined again
        last = active[-1]
        above = done.unionByName(last).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("length").alias("length2"))
        far = last.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        far = materialise(far.select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("length") + F.col("length2")).alias("length")), "jump")
        done, last = done.unionByName(far.where("up is null")), far.where("up is not null")
        active.append(last)
    parents = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("length")), "node")) - 1
    leaves = leaves.withColumn("branch", rank)
    if branches is not None:
        leaves = leaves.where(F.col("branch") < branches)
    paths = materialise(leaves.select("tree", F.col("node").alias("leaf"), "branch", "node", (F.col("length") - 1).alias("depth")), "paths")
    for k in reversed(range(len(active) - 1)):
        # whoever is on a path brings in the message 2 ** k steps above
        step = active[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = paths.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        more = more.select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        old, paths = paths, materialise(paths.unionByName(more), "paths")
        drop_files(old)
    words = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = paths.join(words, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    return found.select("tree", "leaf", "branch", "depth", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One conversation per path: ``tree, branch, formatted, loss`` (code-point spans of the assistant's texts)."""
    turns = F.array_sort(F.collect_list(F.struct("depth", "head", "body", "loss")))
    parts = paths.select(
        "tree", "branch", "depth", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss")
    )
    rows = parts.groupBy("tree", "branch").agg(turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(t["head"])
        span = F.array(F.struct(first.alias("start"), F.length(t["body"]).cast("long").alias("length")))
        return F.struct((first + F.length(t["body"]) + len(END)).alias("at"), F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return rows.select("tree", "branch", formatted.alias("formatted"), F.aggregate("turns", empty, add)["spans"].alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Parse ``formatted`` and ``loss`` again: adds ``turns`` (role, text) and ``loss_text``."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing follows the last mark
    body = F.transform(pieces, lambda p: F.substring(p, len(START) + 1, 2_147_483_647))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(_unrole(role).alias("role"), unescape(F.substr(p, F.length(role) + 2)).alias("text"))

    spoken = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return conversations.withColumn("turns", F.transform(body, turn)).withColumn("loss_text", F.array_join(spoken, ""))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, as counts and checksums."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(conversations).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format every conversation of ``turns(conv_id, turn, role, text)`` and write them; returns ``tree, branch, formatted, loss`` read back.

    An empty table gives no rows; further columns are ignored.
    """
    trees = materialise(linear_trees(turns), "messages")
    return materialise(format_paths(best_paths(trees, 1)), "conversations")
