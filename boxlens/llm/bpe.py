"""Byte-level BPE through a sentencepiece model written straight from a rank file (operator 7).

The model file is built here, field by field: one piece per rank whose bytes are mapped
to printable characters, scored by the negative rank, with the identity normaliser. As
the merge with the best score is the one with the lowest rank, sentencepiece then makes
the merges of the rank file. Pre-tokens are encoded one by one; decoding maps ids back
to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from boxlens.llm.common import per_text, texts

CACHE = 1 << 18  # pre-tokens remembered by a worker; longer or later ones are encoded anew
LONGEST = 64  # characters of a remembered pre-token


def byte_letters() -> list[str]:
    """A printable character for every byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 bytes and rank; ranks are 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must count on from 0")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, 32-bit float or varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """Serialised sentencepiece model: piece i is token i, and the unknown piece comes last.

    Fixed field numbers of the public model format: pieces 1 (piece 1, score 2, type 3),
    trainer 2 (model type 3, vocabulary size 4, unknown id 40), normaliser 3 (name 1,
    dummy prefix 3, extra white space 4, escaped white space 5).
    """
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        back = {letter: byte for byte, letter in enumerate(self.letters)}
        self.bytes_of = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(len(tokens))]
        # a pre-token that is a token is that token, also where merges do not lead to it
        self.unreached = {t: i for i, (t, ids) in enumerate(zip(tokens, self.model.encode([self.lettered(t) for t in tokens]), strict=True)) if ids != [i]}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def lettered(self, data: bytes) -> str:
        return "".join([self.letters[b] for b in data])

    def piece(self, text: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit numbers."""
        if (ids := self.known.get(text)) is None:
            data = text.encode()
            found = [self.unreached[data]] if data in self.unreached else self.model.encode(self.lettered(data))
            ids = np.asarray(found, "<u4").tobytes()
            if len(self.known) < CACHE and len(text) <= LONGEST:
                self.known[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(rank_file: str, pattern: str) -> Callable[[], Codec]:
    """Codec made once in a Python worker from a file that Spark ships (``addFile``)."""

    def make() -> Codec:
        if (codec := _codecs.get((rank_file, pattern))) is None:
            codec = _codecs[rank_file, pattern] = Codec(read_ranks(SparkFiles.get(rank_file)), pattern)
        return codec

    return make


_codecs: dict[tuple[str, str], Codec] = {}


def _ship(docs: DataFrame, path: str) -> str:
    docs.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def _encoder(codec: Callable[[], Codec]) -> Callable[[], Callable[[bytes], tuple]]:
    def make():
        encode = codec().encode
        return lambda data: (encode(data.decode()),)

    return make


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row; ids are little-endian unsigned 32-bit numbers. Null and empty texts give no ids.

    Rows are independent: order, repeated rows and ties do not matter, an empty table
    gives an empty result, and other columns are not read. ``rank_path`` is a local file
    of the driver.
    """
    rows = texts(docs, id_col, text_col)
    step = per_text(_encoder(load(_ship(docs, rank_path), pattern)), [("ids", pa.binary())])
    return rows.mapInArrow(step, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(id, data) of (id, ids): the bytes that the ids stand for. Null ids give no bytes; an id beyond the ranks fails."""
    name = _ship(encoded, rank_path)
    make = load(name, pattern)

    def step(batches: Iterable[pa.RecordBatch]):
        codec = make()
        for batch in batches:
            data = pa.array([codec.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), data], names=["id", "data"])

    return encoded.select("id", "ids").mapInArrow(step, f"id {encoded.schema['id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids, and digests of the ids and of the bytes decoded from them, in one pass over the texts.

    Null and empty texts have no tokens and the digests of nothing; a very long text is
    encoded whole, in one task; repeated rows and ids come back as often; an empty table
    gives an empty result; other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    codec = load(_ship(docs, rank_path), pattern)

    def make():
        own = codec()

        def one(data: bytes) -> tuple:
            ids = own.encode(data.decode())
            return len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

        return one

    names = [("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_text(make, names), f"id {kind}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")
