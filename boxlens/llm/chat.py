"""Chat formatting over a prefix tree (operator 4).

Conversations that share their first turns share the nodes of a tree, so a shared turn is
written once. Nodes are laid out depth-first in one stream; a node has its place in the
stream, the position id of its first token (tokens here are code points of the formatted
text), and the stream intervals of its ancestors, which it may attend to besides itself.

Distinct conversations sorted by their path of node names are the leaves in depth-first
order; each brings the nodes that the one before it does not have. So the layout is a
range sort and a running sum over blocks, with no walk of the tree in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.blocks import range_blocks, running_totals
from boxlens.session import materialize

OPEN, SHUT = "<turn:", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    """No < is left (in a role, no > either): each becomes a backslash and a letter, as does a backslash."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit(">"), F.lit("\\g")) if role else text


def unescape(text: Column) -> Column:
    """Inverse of ``escape``; backslashes come last, since they end as the only ones left."""
    for code, plain in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, role=True), F.lit(">"), escape(text), F.lit(SHUT))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    turns = F.split(formatted, SHUT)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def one(turn: Column) -> Column:
        role = F.substring_index(turn, ">", 1)
        return F.struct(
            unescape(F.substring(role, len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(turn, F.length(role) + F.lit(2), F.lit(1 << 30))).alias("text"))

    return F.transform(turns, one)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds path: the name of turn i is a digest of the turns up to i, so equal names mean equal beginnings."""
    for batch in batches:
        paths = []
        for turns in batch.column("turns").to_pylist():
            name, path = b"", []
            for t in turns:
                name = hashlib.blake2b(name + hashlib.blake2b(t["formatted"].encode(), digest_size=16).digest(), digest_size=16).digest()
                path.append(name.hex())
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], names=[*batch.schema.names, "path"])


def _conversations(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation: conv, turns in order, path, leaf."""
    clean = rows.select(
        rows[conv].alias("conv"), rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    part = F.struct("turn", "role", format_turn(F.col("role"), F.col("text")).alias("formatted"))
    grouped = clean.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("turns"))
    kind = grouped.dtypes[1][1]
    schema = f"conv {grouped.dtypes[0][1]}, turns {kind}, path array<string>"
    return grouped.mapInArrow(_chain, schema).withColumn("leaf", F.element_at("path", -1))


def prefix_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of all conversations.

    nodes: node, parent, depth (from 0), role, formatted, loss (role is the assistant's), start
    and length in the stream, position (id of the first token, the length of all ancestors),
    ancestors (start, end) from the root down. members: conv and the node of its last turn.

    Turns are ordered by turn, null first, then role and formatted text; null texts and roles
    are empty; rows with a null conversation form one conversation. Equal conversations share
    all nodes, also if there are very many. Empty tables give empty results; other columns are
    not read. The turns of one conversation meet in one task, as its format is one text.
    """
    convs = materialize(_conversations(rows, conv, turn, role, text), "conversations")
    length = F.transform("turns", lambda t: F.length(t["formatted"]).cast("bigint"))
    # equal conversations go first, so that no key of the range sort repeats
    leaves = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first(length).alias("sizes"))
    leaves = leaves.withColumn("key", F.array_join("path", ""))
    blocks = range_blocks(leaves, [("key", True)], "leaves")
    # the path before each leaf: within its block, else the last of the block before
    inside = Window.partitionBy("block").orderBy("key")
    ends = blocks.groupBy("block").agg(F.max_by("path", "key").alias("path"))  # one row per block
    carried = ends.select("block", F.lag("path").over(Window.orderBy("block")).alias("carried"))
    previous = F.coalesce(F.lag("path").over(inside), F.col("carried"), F.array().cast("array<string>"))
    placed = (
        blocks.join(F.broadcast(carried), "block").withColumn("shared", F.size(F.array_intersect("path", previous)))
        .withColumn("brought", F.aggregate(F.slice("sizes", F.col("shared") + 1, F.size("sizes")), F.lit(0).cast("bigint"), lambda s, x: s + x)))
    # the running sum reads a written table, in the blocks made above
    placed = running_totals(materialize(placed.drop("carried"), "layout"), [], [("key", True)], {"end": F.col("brought")})
    before = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x)
    steps = F.sequence(F.col("shared"), F.size("path") - 1)
    brought = placed.select(
        "leaf", F.explode(F.transform(steps, lambda i: F.struct(
            i.alias("depth"), F.get("path", i).alias("node"), F.get("path", i - 1).alias("parent"), F.get("sizes", i).alias("length"),
            before(i).alias("position"), (F.col("end") - F.col("brought") + before(i) - before(F.col("shared"))).alias("start")))).alias("x"))
    order = materialize(brought.select("leaf", "x.*"), "node-order")
    # places of all nodes on the path that brought a node
    paths = blocks.select("leaf", F.posexplode("path").alias("depth", "node"))
    places = paths.join(order.select("node", "start", "length"), "node").groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("depth", "start", (F.col("start") + F.col("length")).alias("end")))).alias("places"))
    interval = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))
    above = order.join(places, "leaf").withColumn("ancestors", F.transform(F.slice("places", 1, F.col("depth")), interval)).drop("leaf", "places")
    texts = convs.select(F.explode(F.arrays_zip("path", "turns")).alias("x")).select(F.col("x.path").alias("node"), "x.turns.role", "x.turns.formatted")
    nodes = above.join(texts.dropDuplicates(["node"]), "node").withColumn("loss", F.col("role") == LOSS_ROLE)
    return nodes, convs.select("conv", F.col("leaf").alias("node"))


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv, formatted) of every conversation, put together from the stream intervals of its last node."""
    nodes = materialize(nodes, "chat-nodes")
    last = members.select("node").distinct().join(nodes.select("node", "ancestors", "start"), "node")
    spans = last.select("node", F.explode(F.concat(F.transform("ancestors", lambda a: a["start"]), F.array("start"))).alias("start"))
    whole = spans.join(nodes.select("start", "formatted"), "start").groupBy("node").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "formatted"))), lambda x: x["formatted"]), "").alias("formatted"))
    return members.join(whole, "node").select("conv", "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from its formatted text alone."""
    turns = formatted.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
