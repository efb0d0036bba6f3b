"""Secrets in texts by rules and by token efficiency (operator 11).

Rules find the base spans: assignments to names such as ``password``, access keys and long
runs of hexadecimal digits. The method adds random strings: a byte-level vocabulary covers
words and names with long tokens, but falls back to one or two characters a token on random
characters. So every run of ``LEAST`` or more characters of the base64 and URL alphabets with
fewer than ``RATIO`` characters per token is a span, unless it is a known digest, an identifier
or touches a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.bpe import read_ranks
from boxlens.llm.common import rows_of, texts

KINDS = ("assign", "access", "hex", "random")
LEAST = 16  # characters of a string that is tested
RATIO = 1.8  # characters per token below which a string counts as random
PIECE = 4096  # characters encoded together; of a longer string all pieces count
KNOWN = 100_000  # known digests that are sent to every task at most

#: The rules, on UTF-8 bytes: their classes hold ASCII characters only, and letters fold within ASCII.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}+")
_HEX = re.compile(rb"[0-9a-f]{24,}+")
_STRING = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}+" % LEAST)
#: Not random: numbers, UUIDs, and names made of words and short numbers.
_NUMBER = re.compile(rb"[0-9+/_=-]+")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NAME = re.compile(rb"[/_=+-]*(?:(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|(?<![A-Za-z0-9])[A-Za-z])(?:[0-9]{1,4}+(?![a-z0-9]))?|(?<![A-Za-z0-9])[0-9]{1,4}+(?![A-Za-z0-9]))[/_=+-]*+)+")
#: What stands before a digest that says what it is, or before an encoded file.
_LABEL = re.compile(rb"(?:md5|sha-?[0-9]{1,3}|blake[23][bs]?|crc32|digest|checksum|fingerprint|commit|etag|integrity|base64,)[\"']?[\x20:=-]*[\"']?$", re.IGNORECASE)
#: Digests of the empty input, which occur as placeholders everywhere.
EMPTY = frozenset(hashlib.new(name, b"").hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in bytes of what the rules find."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]


def is_identifier(string: bytes) -> bool:
    """Numbers, UUIDs and names (snake, kebab or camel case, paths) of words with two letters or more, each with up to four digits after it; letters alone are always a name."""
    return bool(_NUMBER.fullmatch(string) or _UUID.fullmatch(string) or _NAME.fullmatch(string))


def per_token(string: bytes, encode: Callable[[str], list[int]]) -> float:
    """Characters per token of an ASCII string."""
    return len(string) / sum(len(encode(string[i : i + PIECE].decode())) for i in range(0, len(string), PIECE))


def random_spans(data: bytes, base: list[tuple[int, int, int]], encode: Callable[[str], list[int]],
                 known: frozenset[str] = frozenset(), ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in bytes of random strings that touch no base span."""
    taken, at, found = sorted((a, b) for a, _, b in base), 0, []
    reach = 0  # greatest end of the base spans that start before the string's end
    for m in _STRING.finditer(data):
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][1]), at + 1
        string = m[0]
        if reach > m.start() or is_identifier(string) or string.decode().lower() in known or _LABEL.search(data, max(0, m.start() - 24), m.start()):
            continue
        if per_token(string, encode) < ratio:
            found.append((m.start(), 3, m.end()))
    return found


def in_characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans sorted by start, then kind, with byte places turned into code points."""
    if data.isascii():
        return sorted(spans)
    places = sorted({p for a, _, b in spans for p in (a, b)})
    count, last, at = {}, 0, 0
    for p in places:
        at += len(data[last:p].decode())
        last, count[p] = p, at
    return sorted((count[a], k, count[b]) for a, k, b in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_coders: dict[tuple[str, str], tiktoken.Encoding] = {}


def _coder(name: str, pattern: str) -> tiktoken.Encoding:
    """Made once in a Python worker from a rank file that Spark ships."""
    if (name, pattern) not in _coders:
        ranks = {token: i for i, token in enumerate(read_ranks(SparkFiles.get(name)))}
        _coders[name, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[name, pattern]


def find(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         known: Iterable[str] = (), ratio: float = RATIO) -> DataFrame:
    """One row per document row: id, base and added spans (kind, start, end in code points, end exclusive).

    ``known`` are lower-case hexadecimal digests, at most ``KNOWN``, that are never added.
    Nulls and empty texts have no spans, a null id stays null. Very long texts are read
    whole; strings of any length are tested in pieces. Spans are sorted by start, then kind
    as in ``KINDS``; rows are independent, so repeated rows come back as often and ties do
    not arise. An empty table gives an empty result; other columns are not read.
    """
    names = EMPTY | frozenset(known)
    if len(names) > KNOWN:
        raise ValueError(f"more than {KNOWN} known digests: anti-join the added spans with a table instead")
    docs.sparkSession.sparkContext.addFile(rank_path)
    file, rows = rank_path.rpartition("/")[2], texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(file, pattern).encode_ordinary
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for data in rows_of(batch):
                base = base_spans(data)
                for spans, to in zip((base, random_spans(data, base, encode, names, ratio)), columns, strict=True):
                    to.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in in_characters(data, spans)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, _SPAN) for c in columns]], names=["id", "base", "added"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {span}, added {span}")


def summary(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text, by start, then kind."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    return found.select(
        "id", *[count(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"), F.size("added").cast("bigint").alias("n_random"))
