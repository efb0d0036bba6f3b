"""Substring deduplication by content-defined chunking (operator 3).

A gear rolling hash over the bytes of a text sets the cuts: the least hash of every window of
``WINDOW`` bytes. So chunks depend on what they hold, not on where they stand, an insertion moves
the cuts near it only, and every passage of ``SHORTEST`` bytes holds a whole chunk, the same
wherever it stands. Chunks meet by digest, and those that another document has too are the seeds.
Around each run of seeds, as far as its passage can reach, the windows of ``min_words`` words meet
by digest in turn; the passages are the words of all windows that another document has too. Each
passage stays in the document with the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import rows_of, texts
from boxlens.session import materialize

CONTEXT = 16  # bytes that a gear hash depends on
WINDOW = 64  # positions of which the least hash is a cut: chunks of about 32 bytes
LONGEST = 256  # bytes of a chunk, give or take a character; longer ones (periodic texts) are cut evenly from their start
SLICE = 1 << 22  # bytes hashed at a time
#: A passage this long holds two windows side by side, so two cuts and the chunk between them.
SHORTEST = CONTEXT + 2 * WINDOW
#: Bytes of a passage before its first cut, and after its last, at most.
REACH = CONTEXT + WINDOW
#: Words of a passage; a character of a script without blanks counts as a word.
MIN_WORDS = 50

_GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_NEVER = np.uint32(0xFFFFFFFF)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash of the CONTEXT bytes up to each offset: the sum of gear[b[i - k]] << k, by doubling."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[width:] += h[:-width] << np.uint32(width)
        h = shifted
    return h


def _least(keys: np.ndarray) -> np.ndarray:
    """Least key of the WINDOW keys from each offset on, by doubling."""
    for width in (1, 2, 4, 8, 16, 32):
        keys = np.minimum(keys[:-width], keys[width:])
    return keys


def cuts(text: bytes) -> np.ndarray:
    """Ascending chunk ends of UTF-8 text, the last its length; never inside a character.

    Of equal hashes in a window the first counts; a cut with the hash of the cut before it,
    as in periodic texts, is left out.
    """
    data, found = np.frombuffer(text, np.uint8), []
    for lo in range(0, len(data) - WINDOW + 1, SLICE):
        start, stop = max(0, lo - CONTEXT + 1), min(len(data), lo + SLICE + WINDOW - 1)
        h = _hashes(data[start:stop])
        # a cut after this byte would be inside a character, or the hash lacks context
        h[: stop - start - 1][(data[start + 1 : stop] & 0xC0) == 0x80] = _NEVER
        if stop < len(data) and data[stop] & 0xC0 == 0x80:
            h[-1] = _NEVER
        if start == 0:
            h[: CONTEXT - 1] = _NEVER
        keys = (h.astype(np.uint64) << np.uint64(32)) | np.arange(start, stop, dtype=np.uint64)
        least = _least(keys[lo - start :])
        found.append(least[np.diff(least, prepend=~least[:1]) != 0])
    least = np.concatenate(found) if found else np.zeros(0, np.uint64)
    least = least[np.diff(least, prepend=~least[:1]) != 0]
    hashed, at = least >> np.uint64(32), (least & np.uint64(_NEVER)).astype(np.int64) + 1
    new = np.r_[True, (hashed[1:] != hashed[:-1]) | (np.diff(at) > WINDOW)] if len(at) else np.zeros(0, bool)
    at = at[new & (hashed != _NEVER) & (at < len(data))]
    ends = np.r_[at, len(data)] if len(data) else at
    size = np.diff(ends, prepend=0)
    if len(size) and size.max() > LONGEST:
        pieces = -(-size // LONGEST)
        first = np.repeat(ends - size, pieces)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        even = np.minimum(first + (k + 1) * LONGEST, np.repeat(ends, pieces))
        for _ in range(3):
            inside = even < len(data)
            even[inside] -= (data[even[inside]] & 0xC0) == 0x80
        ends = np.unique(even)
    return ends


def chunk_table(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(end, digest) of the chunks of a text."""
    ends = cuts(text)
    starts = np.r_[0, ends][:-1].tolist()
    return ends, np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)), np.uint64, len(ends)).view(np.int64)


def word_table(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words: runs between blanks, or single characters of scripts written without blanks.

    Those are Thai to Khmer (U+0E00 to U+17FF), Chinese and Japanese (U+3000 to U+9FFF, from
    U+20000 on).
    """
    data = np.frombuffer(text, np.uint8)
    if not text.strip(b" \t\n\r\x0b\x0c"):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    then = np.r_[data[1:], np.uint8(0)]
    alone = ((data == 0xE0) & (then >= 0xB8)) | ((data == 0xE1) & (then < 0xA0)) | ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xF0) & (then >= 0xA0))
    inside = alone.copy()
    for k in (1, 2, 3):
        inside[k:] |= alone[:-k] if k < 3 else alone[:-k] & (data[:-k] == 0xF0)
    blank = _BLANK[data]
    plain = ~blank & ~inside
    starts = np.flatnonzero(alone | (plain & ~np.r_[False, plain[:-1]]))
    solid = np.flatnonzero(~blank)
    last = np.searchsorted(solid, np.r_[starts[1:], len(data)]) - 1
    return starts, solid[last] + 1


def regions(ends: np.ndarray, shared: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that hold every passage around runs of shared chunks: a flag for each chunk end."""
    edges = np.diff(np.r_[0, shared.astype(np.int8), 0])
    bound = np.r_[0, ends]
    out: list[tuple[int, int]] = []
    for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True):
        lo = min(bound[a] - REACH, bound[max(0, a - 1)] - CONTEXT)
        hi = max(bound[b] + REACH, bound[min(len(ends), b + 1)] + CONTEXT)
        out.append((max(0, int(lo)), min(int(ends[-1]), int(hi))))
    return out


def window_digests(text: bytes, spans: list[tuple[int, int]] | None, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest) of every window of ``min_words`` words that lies in one of the ascending spans."""
    starts, ends = word_table(text)
    at, done = [], 0
    for lo, hi in [(0, len(text))] if spans is None else spans:
        first = max(done, int(np.searchsorted(starts, lo)))
        stop = int(np.searchsorted(ends, hi, "right")) - min_words + 1
        if stop > first:
            at.append(np.arange(first, stop))
            done = stop
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    a, b = starts[at], ends[at + min_words - 1] if len(at) else at
    digest = np.fromiter((xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(at))
    return a, b, digest.view(np.int64)


def _united(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union of byte spans whose starts and ends both ascend; spans that overlap become one."""
    if not len(a):
        return []
    new = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[new].tolist(), b[np.r_[new[1:], True]].tolist(), strict=True))


def _digest_rows(ids: pa.Array, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(id, digest) batches of one digest array per row."""
    which = np.repeat(np.arange(len(found)), [len(x) for x in found])
    digest = np.concatenate(found) if found else np.zeros(0, np.int64)
    for lo in range(0, len(digest), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(which[part])), pa.array(digest[part])], names=["id", "digest"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _digest_rows(batch.column("id"), [np.unique(chunk_table(text)[1]) for text in rows_of(batch)])


def _listed(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """int64 arrays of a list column; null is empty."""
    for value in batch.column(column):
        yield value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64)


def _held_by_two(rows: DataFrame) -> DataFrame:
    """(digest, least) of digests that more than one id has; folded in every task before the exchange."""
    known = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    return known.filter("least < most").select("digest", "least")


def shared_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, shared, later): digests of each id's windows that another id has too, and of those that a lesser id has."""
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.filter("id is not null")
    chunks = named.mapInArrow(_chunk_rows, f"id {kind}, digest bigint")
    seeds = chunks.join(_held_by_two(chunks).select("digest"), "digest").groupBy(F.col("id").alias("with")).agg(F.collect_set("digest").alias("seeds"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, seed in zip(rows_of(batch), _listed(batch, "seeds"), strict=True):
                ends, digest = chunk_table(text)
                found.append(np.unique(window_digests(text, regions(ends, np.isin(digest, seed)), min_words)[2]))
            yield from _digest_rows(batch.column("id"), found)

    seeded = named.join(seeds, F.col("id") == F.col("with")).select("id", "text", "seeds")
    table = materialize(seeded.mapInArrow(windows, f"id {kind}, digest bigint"), "windows")
    return table.join(_held_by_two(table), "digest").groupBy(F.col("id").alias("with")).agg(
        F.collect_set("digest").alias("shared"), F.collect_set(F.when(F.col("id") > F.col("least"), F.col("digest"))).alias("later"))


def _char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte spans as code points."""
    out, at, chars = [], 0, 0
    for a, b in spans:
        start = chars + len(text[at:a].decode())
        chars, at = start + len(text[a:b].decode()), b
        out.append({"start": start, "end": chars})
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document row: id, text without the passages that a document of lesser id has, shared and removed spans.

    ``shared``: all words of windows of ``min_words`` words that another document has too,
    blanks between them included; ``removed``: those that a document of lesser id has. Spans
    are (start, end) in code points. Windows of fewer than ``SHORTEST`` bytes, words of two
    letters or less, are found only if they hold a whole chunk; so are windows that are
    periodic throughout. Digests are 64 bits wide.

    Rows of one id count as one document, so copies under one id, and repeats inside a text,
    stay; rows without id are left as they are. Null texts count as empty and come back empty,
    empty tables give empty results, other columns are not read. A very long text is read
    whole, in one task, with about 40 bytes of memory per word. Of equal texts the one of
    least id stays.
    """
    rows = texts(docs, id_col, text_col)
    joined = rows.join(shared_windows(rows, min_words), F.col("id") == F.col("with"), "left").select("id", "text", "shared", "later")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, shared, removed = [], [], []
            for text, both, lesser in zip(rows_of(batch), _listed(batch, "shared"), _listed(batch, "later"), strict=True):
                every, gone = [], []
                if len(both):
                    a, b, digest = window_digests(text, None, min_words)
                    every, gone = (_united(a[hit], b[hit]) for hit in (np.isin(digest, both), np.isin(digest, lesser)))
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                out.append(b"".join([*kept, text[at:]]).decode())
                shared.append(_char_spans(text, every))
                removed.append(_char_spans(text, gone))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string()), pa.array(shared, span), pa.array(removed, span)], names=["id", "text", "shared", "removed"])

    kind = rows.schema["id"].dataType.simpleString()
    spans = "array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(run, f"id {kind}, text string, shared {spans}, removed {spans}")
