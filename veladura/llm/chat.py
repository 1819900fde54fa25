"""Chat formatting: reply trees to conversations of one marked-up text each.

A message replies to its parent.  Pointer doubling by self-joins gives every message's
ancestor 1, 2, 4, ... replies up; from the leaves these tables enumerate all
root-to-leaf paths in as many joins as the longest path has binary digits.  Branches
are ranked by the mean score of their messages, and each chosen path is rendered.

Template, one turn after another::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings (of this template and of other common ones) inside texts get a
backslash after their first character, one more than they had; reading removes one.
So ``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``: nothing is lost and
no text can close its turn.  Roles are percent-encoded where they hold ``%``, ``<`` or
a line break.

The joins are on message ids, so a long tree is spread over all tasks; only one path's
messages meet in one row, which is the output.  Depth tables are written to the shared
folder, so a lost executor costs no recomputing.

Edge cases: null texts and roles are empty; a parent that does not exist makes a root;
messages on or below a cycle have no root and are left out; messages without a tree id
are one tree, whose id is null; a message without an id is one that nothing replies to; an
empty table gives an empty result; other columns are ignored.  Of messages with the same id in a tree the
caller must make one (``chains`` numbers repeated turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: What follows the first character of a control string, ``<`` or ``[``.
_REST = r"(\|[A-Za-z0-9_]+\|>|/?INST\]|/?s>|</?SYS>>)"
ESCAPE = r"([<\[])(\\*)" + _REST
_UNESCAPE = r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role_out(role: Column) -> Column:
    for char, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for char, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def chains(messages: DataFrame, tree: str, order: str) -> DataFrame:
    """A reply tree for each conversation without branches: every turn answers the one before.

    Equal turn numbers are ordered by role and text, so that the result is the same
    however the rows arrive.
    """
    turn = Window.partitionBy(tree).orderBy(order, "role", "text")
    number = F.row_number().over(turn).cast("bigint")
    return messages.select(
        F.col(tree).alias("tree_id"),
        number.alias("node_id"),
        F.when(number > 1, number - 1).alias("parent_id"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``tree_id, node_id, up`` of the message 1, 2, 4, ... replies up, while there is one."""
    ids = nodes.select("tree_id", F.col("node_id").alias("up"))
    links = nodes.filter("parent_id is not null").select(
        "tree_id", "node_id", F.col("parent_id").alias("up")
    )
    tables, most = [], nodes.count()
    known = links.join(ids, ["tree_id", "up"], "left_semi").select(links.columns)
    step = cut(known, "chat-up", most)
    while not step.isEmpty():
        tables.append(step)
        if 1 << len(tables) > most:
            break  # only cycles are left
        further = step.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("upper"))
        step = cut(
            step.join(further, ["tree_id", "up"]).select(
                "tree_id", "node_id", F.col("upper").alias("up")
            ),
            "chat-up",
            most,
        )
    return tables


def _keyed(nodes: DataFrame) -> DataFrame:
    """Ids in structs, which are never null, so that joins keep null ids; a null parent stays null."""
    parent = F.when(F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("id")))
    keys = {
        "tree_id": F.struct(F.col("tree_id").alias("id")),
        "node_id": F.struct(F.col("node_id").alias("id")),
        "parent_id": parent,
    }
    return nodes.select(*[keys.get(c, F.col(c)).alias(c) for c in nodes.columns])


def paths(nodes: DataFrame) -> DataFrame:
    """``tree_id, leaf, node_id, hops``: each leaf's path, by replies below the node."""
    found = _paths(_keyed(nodes.select("tree_id", "node_id", "parent_id")))
    return found.select(*[F.col(f"{c}.id").alias(c) for c in ("tree_id", "leaf", "node_id")], "hops")


def _paths(nodes: DataFrame) -> DataFrame:
    up, n = _ancestors(nodes), nodes.count()
    ids = nodes.select("tree_id", "node_id")
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id"))
    leaves = ids.join(parents, ["tree_id", "node_id"], "left_anti")
    found = leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).alias("hops"))
    for k in reversed(range(len(up))):
        found = cut(found, "chat-found", n)  # it is read twice in every round
        further = found.join(up[k], ["tree_id", "node_id"]).select(
            "tree_id", "leaf", F.col("up").alias("node_id"), (F.col("hops") + (1 << k)).alias("hops")
        )
        found = found.unionByName(further)
    if up and 1 << len(up) > n:  # a cycle may hang above
        roots = ids.join(up[0].select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
        whole = found.join(roots, ["tree_id", "node_id"]).select("tree_id", "leaf").distinct()
        found = found.join(whole, ["tree_id", "leaf"], "left_semi")
    return found


def format_reply_trees(nodes: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree_id, leaf, rank, n_messages, formatted, loss_spans``.

    ``nodes`` has ``tree_id, node_id, parent_id, role, text, score``.  ``branches``
    keeps that many best paths of each tree (None: all).  ``loss_spans`` are code point
    ranges of ``formatted``, end exclusive, that hold the texts of ``loss_role``.
    """
    nodes = _keyed(nodes.select("tree_id", "node_id", "parent_id", "role", "text", "score"))
    links = cut(nodes.select("tree_id", "node_id", "parent_id", "score"), "chat-nodes")
    member = cut(_paths(links), "chat-paths")
    if branches is not None:
        scored = member.join(links.select("tree_id", "node_id", "score"), ["tree_id", "node_id"])
        mean = scored.groupBy("tree_id", "leaf").agg(F.avg("score").alias("mean"))
        order = Window.partitionBy("tree_id").orderBy(F.desc("mean"), "leaf")
        rank = mean.select("tree_id", "leaf", F.row_number().over(order).alias("rank"))
        chosen = rank.filter(F.col("rank") <= branches)
    else:
        chosen = member.filter("hops = 0").select("tree_id", "leaf", F.lit(1).alias("rank"))
    role = F.coalesce("role", F.lit(""))
    turns = nodes.select(
        "tree_id",
        "node_id",
        F.concat(F.lit(OPEN), _role_out(role), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        (role == loss_role).alias("loss"),
    )
    if branches is not None:
        member = member.join(chosen, ["tree_id", "leaf"])
    else:
        member = member.withColumn("rank", F.lit(1))
    gathered = (
        member.join(turns, ["tree_id", "node_id"])
        .groupBy("tree_id", "leaf", "rank")
        .agg(F.collect_list(F.struct((-F.col("hops")).alias("place"), "head", "body", "loss")).alias("t"))
        .withColumn("t", F.array_sort("t"))
    )
    tail = len(CLOSE) + 1
    text = F.array_join(
        F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))), ""
    )
    spans = F.aggregate(
        "t",
        F.struct(
            F.lit(0).cast("bigint").alias("at"),
            F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        ),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + tail).alias("at"),
            F.when(
                x["loss"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["head"])).alias("start"),
                            (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return gathered.select(
        F.col("tree_id.id").alias("tree_id"),
        F.col("leaf.id").alias("leaf"),
        "rank",
        F.size("t").cast("bigint").alias("n_messages"),
        text.alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role,text>>``."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            _role_in(
                F.substring_index(t.substr(F.lit(len(OPEN) + 1), F.length(t)), "\n", 1)
            ).alias("role"),
            unescape(t.substr(F.locate("\n", t) + 1, F.length(t))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )
