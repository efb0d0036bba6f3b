"""SimHash near-duplicates found with BK-trees (operator 10).

One 64-bit fingerprint per text. Distinct fingerprints are dealt to shards by the
pigeonhole rule: two that differ in at most ``radius`` bits agree on one of
``radius + 1`` bit blocks, so each shard is a (block, value). A shard holds a
BK-tree (children keyed by Hamming distance to the parent); a search follows only
edges within the radius. A shard with more than ``tree_nodes`` fingerprints is split
into several trees and its queries go to each of them, so no tree outgrows a task
and no link is lost. Trees travel to the tasks that query them, as all trees together
grow with the corpus and have no bound for a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import partitions, per_text, texts
from boxlens.llm.components import components
from boxlens.session import materialize

SHINGLE = 3
RADIUS = 3
TREE_NODES = 1 << 15
MANY = 10_000
SLICE = 1 << 17  # shingles hashed at a time within one text
FRONTIER = 1 << 20  # (query, node) pairs looked at together
BATCH = 1 << 16  # shard rows gathered before trees are built


def fingerprint(data: bytes) -> int:
    """SimHash of UTF-8 text over word shingles, as an unsigned 64-bit number."""
    words = data.lower().split()  # on bytes: A-Z only, and white space \x20 \x09-\x0D only
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for lo in range(0, total, SLICE):
        part = words[lo : lo + SLICE + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _signed(data: bytes) -> tuple[int]:
    value = fingerprint(data)
    return (value - (1 << 64) if value >> 63 else value,)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; fp is a signed long with the bits of the fingerprint. Null and empty texts give 0."""
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_text(lambda: _signed, [("fp", pa.int64())]), f"id {kind}, fp bigint")


class Forest:
    """BK-trees of several shards at once, built level by level.

    ``fp`` are distinct within a group, ``group`` is ascending. Node i holds fp[i].
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        n = len(fp)
        self.fp = fp
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.groups, self.roots = group[first], first
        placed = np.full(n, -1, np.int64)  # parent * 65 + distance
        here = np.repeat(first, np.diff(np.r_[first, n]))
        active = np.flatnonzero(here != np.arange(n))
        here = here[active]
        while active.size:
            slot = here * 65 + np.bitwise_count(fp[active] ^ fp[here])
            _, at, which = np.unique(slot, return_index=True, return_inverse=True)
            child = active[at]
            placed[child] = slot[at]
            rest = np.ones(len(active), bool)
            rest[at] = False
            here, active = child[which[rest]], active[rest]
        order = np.argsort(placed, kind="stable")
        self.node = order[np.searchsorted(placed[order], 0) :]
        self.slot = placed[self.node]

    def links(self, fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node) within the radius, in pieces of bounded size."""
        tree = np.searchsorted(self.groups, group)
        has = (tree < len(self.groups)) & (self.groups[np.minimum(tree, len(self.groups) - 1)] == group)
        stack = [(np.flatnonzero(has), self.roots[tree[has]])]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            near = far <= radius
            yield query[near], node[near]
            lo = np.searchsorted(self.slot, node * 65 + np.maximum(far - radius, 0))
            hi = np.searchsorted(self.slot, node * 65 + np.minimum(far + radius, 64), side="right")
            count = hi - lo
            if total := int(count.sum()):
                # a node has at most 64 children, so a piece grows by 2 * radius + 1 at most
                at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
                stack.append((np.repeat(query, count), self.node[at]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of every pair (a, b) in place; labels are least members."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (label != label[label]).any():
            label[:] = label[label]


def _spanning(fp: np.ndarray, group: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row that has a link in its shard: (its fingerprint, that of the row it joins)."""
    label, ids = np.arange(len(fp)), np.flatnonzero(member)
    if len(ids):
        for query, node in Forest(fp[ids], group[ids]).links(fp, group, radius):
            _merge(label, query, ids[node])
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return fp[joined], fp[label[joined]]


def _link_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            shard = np.stack([table[c].to_numpy().astype(np.int64) for c in ("shard", "tree")])
            new = np.r_[True, (shard[:, 1:] != shard[:, :-1]).any(0)] if shard.shape[1] else np.zeros(0, bool)
            end = len(new) if last else int(np.flatnonzero(new)[-1])  # the last shard may go on in the next batch
            if end < len(new):
                held.extend(table.slice(end).to_batches())
            if end:
                fp = table["fp"].to_numpy()[:end].view(np.uint64)
                a, b = _spanning(fp, np.cumsum(new[:end]), table["member"].to_numpy()[:end], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        due = BATCH
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if (rows := sum(x.num_rows for x in held)) >= due:
                yield from flush(False)
                due = max(BATCH, 2 * sum(x.num_rows for x in held))  # a shard longer than the batch is not tried at every step
        if held:
            yield from flush(True)

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b) links that join all distinct fingerprints (column fp) within the radius: a spanning forest per shard.

    Links inside a shard that another path of the same shard already implies are left
    out, so a large group of near copies gives one link per member, not all pairs.
    """
    width = 64 // (radius + 1)
    mask = lambda b: (1 << (64 - width * radius if b == radius else width)) - 1
    block = lambda b: F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit(mask(b)))
    # one number per (block, value): the block index sits in the low bits
    shards = fps.select("fp", F.explode(F.array(*[block(b) * (radius + 1) + b for b in range(radius + 1)])).alias("shard"))
    sizes = shards.groupBy("shard").count().filter("count > 1")
    trees = F.ceil(F.col("count") / tree_nodes).cast("int")
    rows = (
        shards.join(sizes, "shard")
        .withColumn("own", F.pmod(F.xxhash64("fp"), trees).cast("int"))
        .select("shard", "fp", "own", F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree"))
        .select("shard", "tree", "fp", (F.col("own") == F.col("tree")).alias("member"))
    )
    n = partitions(fps.sparkSession)
    dealt = rows.repartition(n, "shard", "tree").sortWithinPartitions("shard", "tree", "fp")
    return dealt.mapInArrow(_link_shards(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per input row: id, fp, component (least id reachable through links of at most ``radius`` bits).

    Nulls: a null text counts as empty; a null id is never a component's name unless the
    component has no other. Empty texts have fingerprint 0 and link like any other.
    Ties and repeated rows: equal fingerprints link, each row comes back once per
    occurrence. An empty table gives an empty result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    roots = components(fingerprint_links(nodes.select("fp"), radius, tree_nodes), "simhash-links")
    # one component per fingerprint: its own least id, or the least of all linked ones
    linked = nodes.join(roots, nodes["fp"] == roots["node"])
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    joined = roots.join(named, "root").select(F.col("node").alias("fp"), "component")
    per_fp = materialize(nodes.join(joined, "fp", "left").select("fp", "copies", F.coalesce("component", "least").alias("component")), "simhash-named")
    # a fingerprint with more than 1 / MANY of all rows is one of at most MANY: those are broadcast, so no task gathers their rows
    total = per_fp.agg(F.sum("copies")).first()[0] or 0
    often = per_fp.filter(F.col("copies") * MANY > total).select("fp", "component", F.lit(True).alias("often"))
    marked = rows.join(F.broadcast(often), "fp", "left")
    rest = marked.filter("often is null").select("id", "fp").join(per_fp.select("fp", "component"), "fp")
    return marked.filter("often").select("id", "fp", "component").unionByName(rest.select("id", "fp", "component"))
