"""Ranked lexical search by dense blocked matrix products (operator 12).

Every search text (item) is a row of weights over the vocabulary of all items, every
document a column of impacts, and a score their product. Both are integers held in float64:
a tile has at most ``TERMS`` terms, an impact is below ``IMPACT`` and a weight below ``CAP``
(a greater one is split into two digits), so every partial sum stays below 2^53, is exact
whatever order BLAS adds in, and tiles add up in 64-bit integers.

Documents are tokenised once per block of items; only the counts of the block's terms are
written. A task keeps the best ``k`` of each item over its tiles, and ranks are given in two
grouped steps over these lists. Items go through the driver in blocks of ``BLOCK_BYTES``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.llm.common import partitions, rows_of, texts
from boxlens.session import materialize

BEST = 20
BLOCK_BYTES = 2_000_000  # of item texts that are ranked, and whose vocabulary is sent to every task, together
BLOCK_ITEMS = 8192
ITEMS, TERMS, DOCS = 256, 4096, 512  # of a tile
IMPACT = 10**6
CAP = 2**53 // (TERMS * IMPACT)
PIECE = 1 << 20  # bytes of a text that are split into terms together

#: every byte that is not part of a term becomes a blank, A-Z become a-z
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased terms of UTF-8 text (runs of 0-9, a-z and all beyond ASCII), in lists of bounded size."""
    folded, lo = data.translate(_FOLD), 0
    while lo < len(folded):
        hi = folded.find(b" ", lo + PIECE)
        hi = len(folded) if hi < 0 else hi
        yield folded[lo:hi].split()
        lo = hi


@dataclass(frozen=True)
class Block:
    """Items of a block: ids, vocabulary (term -> column), and for every (item, term) the number of repeats."""

    ids: list
    vocabulary: dict[bytes, int]
    item: np.ndarray
    column: np.ndarray
    repeats: np.ndarray


def _blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of the rows (id, text), streamed; a text longer than a block is a block of its own."""

    def made(rows: list[tuple]) -> Block:
        vocabulary: dict[bytes, int] = {}
        entries = []
        for i, (_, text) in enumerate(rows):
            counts: Counter[bytes] = Counter()
            for part in terms(text.encode()):
                counts.update(part)
            entries += [(i, vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counts.items()]
        item, column, repeats = np.array(entries, np.int64).reshape(-1, 3).T
        return Block([name for name, _ in rows], vocabulary, item, column, repeats)

    rows, held = [], 0
    for r in items.toLocalIterator():
        size = len(r.text)
        if rows and (held + size > BLOCK_BYTES or len(rows) == BLOCK_ITEMS):
            yield made(rows)
            rows, held = [], 0
        rows.append((r.id, r.text))
        held += size
    if rows:
        yield made(rows)


def _count_terms(vocabulary):
    """(id, n terms with repeats, columns and counts of the vocabulary's terms) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        keys = known.keys()
        for batch in batches:
            total, column, count = [], [], []
            for data in rows_of(batch):
                counts: Counter[bytes] = Counter()
                for part in terms(data):
                    counts.update(part)
                found = counts.keys() & keys
                total.append(counts.total())
                column.append(np.fromiter((known[t] for t in found), "<i4", len(found)).tobytes())
                count.append(np.fromiter((counts[t] for t in found), "<i8", len(found)).tobytes())
            arrays = [batch.column("id"), pa.array(total, pa.int64()), pa.array(column, pa.binary()), pa.array(count, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "columns", "counts"])

    return run


def _document_frequencies(size: int):
    """One row per column that occurs: documents of this task that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(x.as_py() for x in batch.column("columns"))
            held += np.bincount(np.frombuffer(data, "<i4"), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["column", "df"])

    return run


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _exact_product(weights: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Product of integer matrices as 64-bit integers; see the module's text for the bound."""
    high, low = np.divmod(weights, CAP)
    out = (low.astype(np.float64) @ impacts).astype(np.int64)
    if high.any():
        if high.max() >= CAP:
            raise OverflowError("an item's weight of one term has no 64-bit score")
        out += (high.astype(np.float64) @ impacts).astype(np.int64) * CAP
    return out


class _Best:
    """The best (score, id) of every item so far; equal scores by ascending id, nulls last."""

    def __init__(self, items: int, k: int, kind: pa.DataType):
        self.k, self.rows = k, [pa.table({"score": pa.array([], pa.int64()), "id": pa.array([], kind)})] * items
        self.least = np.ones(items, np.int64)  # a score below cannot enter; an equal one may, by its id

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of items from ``first`` on (rows) for the documents of a tile (columns)."""
        for row in np.flatnonzero((scores >= self.least[first : first + len(scores), None]).any(1)):
            i = first + int(row)
            bound = self.least[i]
            if len(ids) > self.k:  # at most the k best of this tile and their ties
                bound = max(bound, np.partition(scores[row], len(ids) - self.k)[len(ids) - self.k])
            at = np.flatnonzero(scores[row] >= bound)
            both = pa.concat_tables([self.rows[i], pa.table({"score": scores[row][at], "id": ids.take(pa.array(at))})])
            order = pc.sort_indices(both, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")
            self.rows[i] = both.take(order[: self.k])
            if self.rows[i].num_rows == self.k:
                self.least[i] = self.rows[i]["score"][-1].as_py()


def _score(block, weights, documents: int, length: int, k: int):
    """Best documents of every item over the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, column, count = block.value
        weight = weights.value
        tiles = -(-int(column.max(initial=-1) + 1) // TERMS)
        # entries by vocabulary tile, so that a tile's items are found at once
        order = np.argsort(column // TERMS, kind="stable")
        ends = np.searchsorted((column // TERMS)[order], np.arange(tiles + 1))
        best = None
        for batch in batches:
            best = best or _Best(count, k, batch.schema.field("id").type)
            for lo in range(0, batch.num_rows, DOCS):
                part = batch.slice(lo, DOCS)
                columns = [np.frombuffer(x.as_py(), "<i4") for x in part.column("columns")]
                counts = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in part.column("counts")])
                doc = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
                columns = np.concatenate(columns).astype(np.int64)
                m = 75 + 25 * part.column("n").to_numpy() * documents // max(length, 1)
                impact = 1_000_000_000 * counts // (1000 * counts + 12 * m[doc])
                scores = np.zeros((count, part.num_rows), np.int64)
                for tile in range(tiles):
                    here = columns // TERMS == tile
                    if not here.any():
                        continue
                    impacts = np.zeros((TERMS, part.num_rows))
                    impacts[columns[here] % TERMS, doc[here]] = impact[here]
                    own = order[ends[tile] : ends[tile + 1]]
                    rows, which = np.unique(item[own], return_inverse=True)  # only items with a term in this tile
                    for at in range(0, len(rows), ITEMS):
                        inside = (which >= at) & (which < at + ITEMS)
                        tall = np.zeros((min(ITEMS, len(rows) - at), TERMS), np.int64)
                        tall[which[inside] - at, column[own][inside] % TERMS] = weight[own][inside]
                        scores[rows[at : at + ITEMS]] += _exact_product(tall, impacts)
                best.add(0, scores, part.column("id"))
        for i, rows in enumerate(best.rows if best else []):
            if rows.num_rows:
                rows = rows.combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * rows.num_rows, pa.int32()), rows["id"].chunk(0), rows["score"].chunk(0)], names=["item", "id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", k: int = BEST) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank (from 1), id, score.

    A term's weight is its rarity over all documents, its impact in a document grows with
    its count and falls with the document's length; weight, impact and score are integers.

    Nulls: null texts have no terms, so such documents count for nothing and such items have
    no rows. A null item id is an item like any other; null document ids rank last among
    equal scores. Ties: equal scores by ascending id, across tiles and tasks. Repeated rows:
    each row is a document, or an item, of its own. Very long texts are read whole, in
    pieces. Without documents or items the result is empty; other columns are not read.
    """
    spark = docs.sparkSession
    rows, named = texts(docs, id_col, text_col), texts(items, item_col, item_text_col)
    kind, item_kind = rows.schema["id"].dataType.simpleString(), named.schema["id"].dataType
    out = None
    for number, block in enumerate(_blocks(named)):
        shared = spark.sparkContext.broadcast(block.vocabulary)
        counted = materialize(rows.mapInArrow(_count_terms(shared), f"id {kind}, n bigint, columns binary, counts binary"), "term-counts")
        documents, length = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        size = len(block.vocabulary)
        frequencies = counted.select("columns").mapInArrow(_document_frequencies(size), "column bigint, df bigint")
        df = np.zeros(size, np.int64)
        found = frequencies.groupBy("column").agg(F.sum("df").alias("df")).toArrow()  # the block's vocabulary at most
        df[found["column"].to_numpy()] = found["df"].to_numpy()
        weight = block.repeats * np.array([term_weight(documents, int(n)) for n in df], np.int64)[block.column]
        entries = spark.sparkContext.broadcast((block.item, block.column, len(block.ids)))
        step = _score(entries, spark.sparkContext.broadcast(weight), documents, length, k)
        each = counted.mapInArrow(step, f"item int, id {kind}, score bigint").withColumn("part", F.spark_partition_id() % partitions(spark))
        # lists of many tasks meet in two steps, so that an item's last task reads at most k rows per part
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
        top = each.withColumn("rank", place("item", "part")).filter(F.col("rank") <= k)
        top = top.withColumn("rank", place("item")).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_kind.simpleString()}")
        ranked = top.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")
        out = out.union(ranked) if out else ranked
    return out if out is not None else spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, id {kind}, score bigint")
