"""Benchmark decontamination with a positional inverted index (operator 2).

``build_index`` writes shards: each holds the posting lists (term -> positions) of
some whole documents, so no posting is ever shuffled. ``search`` reads the document
frequencies first (two small columns), orders the terms of every test window from the
rarest, and intersects offset-adjusted lists in that order, shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import rows_of, texts
from boxlens.session import materialize

WINDOW = 10
SLOP = 10  # further words that a proximity match may spread over
SHARD_WORDS = 1 << 20
QUERY_BYTES = 2_000_000  # of test texts that are searched, and sent to every task, together
PIECE = 1 << 20  # candidates looked at together

#: every byte that is not part of a word becomes a blank, A-Z become a-z
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of 0-9, a-z and everything beyond ASCII."""
    return data.translate(_FOLD).split()


INDEX_SCHEMA = "shard string, terms array<string>, counts array<bigint>, gaps binary, ids array<{id}>, starts array<bigint>, sizes array<bigint>"


def _index_shards(terms: dict[bytes, int] | None, id_type: pa.DataType, reach: int):
    """Arrow step: documents -> shards. Positions of one shard count on over its documents, ``reach`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(terms) if terms is not None else {}
        find = (lambda ws: map(known.get, ws, repeat(-1))) if terms is not None else (lambda ws: (known.setdefault(w, len(known)) for w in ws))
        ids, starts, sizes, lists, at, made = [], [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            names = list(known)
            number = np.concatenate([x for x, _ in lists]) if lists else np.zeros(0, np.int64)
            where = np.concatenate([x for _, x in lists]) if lists else np.zeros(0, np.int64)
            order = np.argsort(number.astype(np.uint16) if len(names) < 1 << 16 else number, kind="stable")
            number, where = number[order], where[order]
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
            gaps = np.diff(where, prepend=0)
            gaps[first] = where[first]
            out = [
                [f"{TaskContext.get().partitionId()}-{made}"], [[names[i].decode() for i in number[first]]], [np.diff(np.r_[first, len(number)])], [gaps.astype("<u4").tobytes()], [ids], [starts], [sizes]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["shard", "terms", "counts", "gaps", "ids", "starts", "sizes"])

        for batch in batches:
            for name, data in zip(batch.column("id").to_pylist(), rows_of(batch), strict=True):
                ws = words(data)
                number = np.fromiter(find(ws), np.int64, len(ws))
                kept = np.flatnonzero(number >= 0)
                lists.append((number[kept].astype(np.int32), kept + at))
                ids.append(name)
                starts.append(at)
                sizes.append(len(ws))
                at += len(ws) + reach
                if at >= SHARD_WORDS:
                    yield shard()
                    ids, starts, sizes, lists, at, made = [], [], [], [], 0, made + 1
                    if terms is None:
                        known.clear()
        if ids:
            yield shard()

    return run


def build_index(docs: DataFrame, terms: Iterable[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text",
                reach: int = 2 * (WINDOW + SLOP)) -> DataFrame:
    """Written index of whole texts, one row per shard of about ``SHARD_WORDS`` words.

    ``terms`` restricts the posting lists to terms that can be looked up (those of a
    test set); None keeps every term. Columns: terms and the length of each list,
    all lists as 32-bit gaps, and the id, first position and word count of each row.
    """
    rows = texts(docs, id_col, text_col)
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind := rows.schema["id"].dataType.simpleString()]
    known = None if terms is None else {t: i for i, t in enumerate(sorted(set(terms)))}
    return materialize(rows.mapInArrow(_index_shards(known, id_type, reach), INDEX_SCHEMA.format(id=kind)), "postings")


@dataclass(frozen=True)
class Windows:
    """Test windows, rarest term first: ``term[w, k]`` stands ``offset[w, k]`` words into window w; -1 beyond its end."""

    terms: dict[str, int]
    term: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    items: list[list]  # ids of the items that have the window


def test_windows(items: list[tuple], window: int) -> dict[tuple[bytes, ...], list]:
    """Each window of each (item id, text): ``window`` words, or the whole of a shorter item."""
    found: dict[tuple[bytes, ...], list] = {}
    for name, text in items:
        ws = words((text or "").encode())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            owners = found.setdefault(tuple(ws[i : i + window]), [])
            if name not in owners[-1:]:
                owners.append(name)
    return found


def _rarest_first(found: dict[tuple[bytes, ...], list], frequency: dict[bytes, int], window: int) -> Windows:
    """Windows whose every term occurs somewhere, their terms ordered by corpus frequency."""
    alive = [w for w in found if all(t in frequency for t in w)]
    terms = {t: i for i, t in enumerate(sorted({t for w in alive for t in w}))}
    term, offset = np.full((len(alive), window), -1), np.zeros((len(alive), window), np.int64)
    for i, w in enumerate(alive):
        for k, j in enumerate(sorted(range(len(w)), key=lambda j: (frequency[w[j]], j))):
            term[i, k], offset[i, k] = terms[w[j]], j
    return Windows({t.decode(): i for t, i in terms.items()}, term, offset, np.array([len(w) for w in alive], np.int64), [found[w] for w in alive])


def _postings(row: dict, terms: dict[str, int]) -> np.ndarray:
    """Sorted (term << 32 | position) of one shard, for the terms asked for."""
    counts = np.asarray(row["counts"], np.int64)
    gaps = np.frombuffer(row["gaps"], "<u4").astype(np.int64)
    if not len(gaps):
        return gaps
    first = np.r_[0, np.cumsum(counts)[:-1]]
    total = np.cumsum(gaps)
    where = total - np.repeat(total[first] - gaps[first], counts)
    number = np.fromiter((terms.get(t, -1) for t in row["terms"]), np.int64, len(counts))
    keys = (np.repeat(number, counts) << 32) | where
    keys = keys[keys >= 0]
    return keys if (np.diff(number[number >= 0]) > 0).all() else np.sort(keys)


def _at_or_after(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Least key >= each wanted one, or a key beyond all."""
    at = np.searchsorted(keys, wanted)
    return np.append(keys, np.iinfo(np.int64).max)[at]


def intersect(keys: np.ndarray, plan: Windows, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position) matches in one shard, in pieces.

    ``slop`` None: the words of the window in place, position is its first word.
    Else: every word of the window within length - 1 + slop words of its rarest word,
    whose position is given.
    """
    n = len(plan.length)
    lo = np.searchsorted(keys, plan.term[:, 0] << 32)
    count = np.searchsorted(keys, (plan.term[:, 0] + 1) << 32) - lo if n else np.zeros(0, np.int64)
    ends = np.cumsum(count)
    for piece in range(0, int(ends[-1]) if n else 0, PIECE):
        seq = np.arange(piece, min(piece + PIECE, int(ends[-1])))
        w = np.searchsorted(ends, seq, side="right")
        pos = (keys[lo[w] + seq - (ends[w] - count[w])] & 0xFFFFFFFF) - (plan.offset[w, 0] if slop is None else 0)
        for k in range(1, plan.term.shape[1]):
            term = plan.term[w, k]
            if slop is None:
                wanted = (term << 32) + pos + plan.offset[w, k]
                keep = (_at_or_after(keys, wanted) == wanted) | (term < 0)
            else:
                span = plan.length[w] - 1 + slop
                keep = (_at_or_after(keys, (term << 32) + np.maximum(pos - span, 0)) <= (term << 32) + pos + span) | (term < 0)
            w, pos = w[keep], pos[keep]
        # a list that starts before its window can't: its first word is missing there
        yield w[pos >= 0], pos[pos >= 0]


def _merged(item: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of one item and document become one; input by (item, start)."""
    if not len(item):
        return item, start, length
    end = start + length
    # intervals of the next item start beyond every end so far, once shifted by item
    shift = item * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, (start + shift)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(item)] - 1
    return item[first], start[first], reach[last] - shift[first] - start[first]


def _search_shards(plan: Windows, item_ids: list, slop: int | None, id_arrow: pa.DataType, item_arrow: pa.DataType):
    number = {x: i for i, x in enumerate(item_ids)}
    owners = [[number[x] for x in items] for items in plan.items]
    many = np.array([len(x) for x in owners], np.int64)
    flat = np.array([y for x in owners for y in x], np.int64)
    base = np.r_[0, np.cumsum(many)[:-1]] if len(many) else many

    def matches(keys: np.ndarray, starts: np.ndarray, slop: int | None):
        for w, pos in intersect(keys, plan, slop):
            row = np.searchsorted(starts, pos, side="right") - 1
            n = many[w]
            at = np.repeat(base[w] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(w) else w
            yield np.repeat(row, n), flat[at], np.repeat(pos - starts[row], n), np.repeat(plan.length[w] if slop is None else np.ones_like(w), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts = _postings(row, plan.terms), np.asarray(row["starts"], np.int64)
                exact = [np.concatenate(x) for x in zip(*matches(keys, starts, None), strict=True)] or [np.zeros(0, np.int64)] * 4
                near = [np.concatenate(x) for x in zip(*matches(keys, starts, slop), strict=True)][:2] if slop is not None else []
                near = near or [np.zeros(0, np.int64)] * 2
                hits: list[list] = [[] for _ in starts]
                order = np.lexsort((exact[2], exact[1], exact[0]))
                doc, item, start, length = (x[order] for x in exact)
                for i in np.unique(doc):
                    lo, hi = np.searchsorted(doc, [i, i + 1])
                    spans = zip(*_merged(item[lo:hi], start[lo:hi], length[lo:hi]), strict=True)
                    hits[i] = [{"item": item_ids[a], "start": int(b), "length": int(c)} for a, b, c in spans]
                close: list[list] = [[] for _ in starts]
                for i, a in np.unique(np.stack(near), axis=1).T if len(near[0]) else ():
                    close[i].append(item_ids[a])
                kind = pa.list_(pa.struct([("item", item_arrow), ("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(starts)), pa.array(range(len(starts)), pa.int64()), pa.array(row["ids"], id_arrow), pa.array(row["sizes"], pa.int64()), pa.array(hits, kind), pa.array(close, pa.list_(item_arrow))],
                    names=["shard", "row", "id", "n_words", "hits", "near"])

    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def search(index: DataFrame, found: dict, item_type: str, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """One row per indexed row: shard and row number, id, n_words, hits (item, start word, length in words), near (items matched by proximity).

    ``found`` are the windows of ``test_windows`` for one block of test texts.
    """
    vocabulary = {t for w in found for t in w}
    # at most one row per term of the query block comes to the driver
    asked = index.sparkSession.createDataFrame([(t.decode(),) for t in sorted(vocabulary)], "term string")
    totals = (
        index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
        .join(F.broadcast(asked), "term", "left_semi"))
    frequency = {r.term.encode(): r.n for r in totals.collect()}
    plan = _rarest_first(found, frequency, window)
    items = sorted({x for owners in plan.items for x in owners}, key=lambda x: (x is None, x))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"shard string, row bigint, id {kind}, n_words bigint, hits array<struct<item:{item_type},start:bigint,length:bigint>>, near array<{item_type}>"
    return index.mapInArrow(_search_shards(plan, items, slop, _ARROW[kind], _ARROW[item_type]), schema)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The stated test set in blocks of about ``limit`` bytes; one block is on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null").distinct().toLocalIterator():
        block.append((r["item"], r["text"]))
        size += len(r["text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """One row per document row: id, n_words, hits, near as in ``search``.

    A test window is ``window`` consecutive words of an item, or all of a shorter item;
    items without words have none. Null texts have no words; null item ids are an item of
    their own. Repeated rows and items come back once per row and once per item. An empty
    test set gives no hits, an empty table no rows; other columns are not read. A test
    set beyond ``QUERY_BYTES`` is searched block by block in one index of all terms.
    """
    item_type = benchmark.schema[item_col].dataType.simpleString()
    reach = 2 * (window + (slop or 0))
    queue = blocks(benchmark, item_col, item_text_col, QUERY_BYTES)
    found, more = test_windows(next(queue, []), window), next(queue, None)
    if more is None:
        return search(build_index(docs, {t for w in found for t in w}, id_col, text_col, reach), found, item_type, window, slop)
    index = build_index(docs, None, id_col, text_col, reach)
    parts = [search(index, found, item_type, window, slop)]
    while more is not None:
        parts.append(search(index, test_windows(more, window), item_type, window, slop))
        more = next(queue, None)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "near")]  # one list per query block
    return reduce(DataFrame.union, parts).groupBy("shard", "row", "id", "n_words").agg(*lists)


def summary(found: DataFrame) -> DataFrame:
    """Per row: n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, n_near (items matched by proximity)."""
    covered = F.aggregate(
        F.array_sort("hits", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), h["start"] + h["length"] - F.greatest(s["end"], h["start"]))).alias("n"),
            F.greatest(s["end"], h["start"] + h["length"]).alias("end")),
        lambda s: s["n"])
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"].cast("string"))))
    return found.select(
        "id", "n_words", covered.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), F.size(F.array_distinct("near")).cast("bigint").alias("n_near"))
