"""Personal data by a skip-chain conditional random field (operator 6).

Rules find the base spans. The field is over the tokens that hold a digit or an ``@``
(no other token can be personal data of these kinds). Potentials: the shape of a token,
the shape of the candidate just before it, the label of an adjacent candidate, and, along
skip edges, the label of the previous candidate with the same digits or letters. They are
learned piecewise: each factor's table is a smoothed log frequency over the whole corpus,
with the base spans as labels. Tokens of base spans are observed; loopy sum-product
message passing labels the others, so a token that the rules miss can take the label of
its like elsewhere in the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import rows_of, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
SHAPES = 4096  # buckets of the shape tables
ROUNDS = 12  # of message passing
DAMPING = 0.3
CERTAIN = 0.9  # marginal from which a span is added
SMOOTH = 0.5
CANDIDATES = 1 << 16  # that are labelled together
EDGE = ".,;:!?|*#$%&\"'`<>{}[]=~^_\\/"  # not part of a token at its ends

#: The rules. Possessive runs and the look-behinds keep them linear and change no match:
#: a run of digits is always taken whole.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORTH = re.compile(rb"[0-9@]")


def luhn(digits: str) -> bool:
    """Check digit of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run before it, from the last match on, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) in code points, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 2 * 19 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def shape(token: str) -> str:
    """Letters as one a, runs of digits by length, other characters as they are; checks of a number are part of it."""
    out = re.sub(r"[^\W\d_]+", "a", token[:80])
    out = re.sub(r"[0-9]+", lambda m: f"d{len(m[0]) if len(m[0]) < 20 else 20}", out)
    digits = _digits(token[:80])
    if re.fullmatch(r"d[0-9]+(\.d[0-9]+){3}", out):
        out += " in" if all(len(x) < 4 and int(x) <= 255 for x in token.split(".")) else " out"
    elif 13 <= len(digits) <= 19:
        out += " luhn" if luhn(digits) else " no"
    return out


def _bucket(name: str) -> int:
    """Stable bucket of a shape (FNV-1a)."""
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % SHAPES


@dataclass
class Candidates:
    """Tokens of one or more texts: span, label (-1: hidden), shape buckets, and the two kinds of edges."""

    spans: list[tuple[int, int, int]]  # row, start, end
    label: list[int]
    shape: list[int]
    before: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def add_candidates(to: Candidates, row: int, text: str, base: list[tuple[int, int, int]], hide: bool) -> None:
    """Candidates of a text in order. ``hide``: tokens outside base spans are hidden, else their label is 0.

    Skip edges join a candidate to the one before it with the same key only, so a token
    that recurs n times adds n - 1 edges.
    """
    spans = sorted((a, b, k + 1) for k, a, b in base)
    last: dict[str, int] = {}
    end_before, shape_before, at = -1, "", 0
    for m in re.finditer(r"\S+", text):
        token = m[0]
        if not _has(token):
            continue
        start = m.start() + len(token) - len(token.lstrip(EDGE))
        end = max(start, m.end() - (len(token) - len(token.rstrip(EDGE))))
        token = text[start:end]
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        label = min((k for a, b, k in spans[at : at + LABELS] if a < end and b > start), default=-1 if hide else 0)
        i = len(to.spans)
        touches = end_before >= 0 and not text[end_before : m.start()].strip()
        form = shape(token)
        to.spans.append((row, start, end))
        to.label.append(label)
        to.shape.append(_bucket(form))
        to.before.append(_bucket(f"{shape_before if touches else ''} > {form}"))
        if touches:
            to.chain.append((i - 1, i))
        key = _digits(token) if "@" not in token else token.casefold()
        if key in last:
            to.skip.append((last[key], i))
        last[key] = i
        end_before, shape_before = m.end(), form


def _has(token: str) -> bool:
    return "@" in token or any("0" <= c <= "9" for c in token)


def _empty() -> Candidates:
    return Candidates([], [], [], [], [], [])


@dataclass(frozen=True)
class Field:
    """Log potentials: per shape, per (previous shape, shape), per adjacent pair, per skip pair."""

    shape: np.ndarray
    before: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def count_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (factor, bucket, label) over the texts of a task; a row per value that occurs."""
    total: Counter[tuple[int, int, int]] = Counter()
    for batch in batches:
        for data in rows_of(batch):
            if not _WORTH.search(data):
                continue
            text, c = data.decode(), _empty()
            add_candidates(c, 0, text, base_spans(text), hide=False)
            total.update((0, s, y) for s, y in zip(c.shape, c.label, strict=True))
            total.update((1, s, y) for s, y in zip(c.before, c.label, strict=True))
            total.update((2, c.label[a], c.label[b]) for a, b in c.chain)
            total.update((3, c.label[a], c.label[b]) for a, b in c.skip)
    f, b, y = zip(*total, strict=True) if total else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(f, pa.int32()), pa.array(b, pa.int32()), pa.array(y, pa.int32()), pa.array(total.values(), pa.int64())], names=["f", "b", "y", "n"])


def learn(docs: DataFrame, text_col: str = "text") -> Field:
    """Piecewise estimates from all texts. The driver gets at most (2 ``SHAPES`` + 2 labels) x labels counts."""
    rows = texts(docs, text_col, text_col).select("text").mapInArrow(count_factors, "f int, b int, y int, n bigint")
    counts = rows.groupBy("f", "b", "y").agg(F.sum("n").alias("n")).collect()
    tables = [np.zeros((SHAPES, LABELS)), np.zeros((SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    for r in counts:
        tables[r.f][r.b, r.y] += r.n
    prior = tables[0].sum(0) + SMOOTH
    prior /= prior.sum()
    unary = [np.log((t + SMOOTH * prior * LABELS) / (t.sum(1, keepdims=True) + SMOOTH * LABELS)) for t in tables[:2]]
    # both shape factors carry the prior; it counts once
    pair = [t + t.T + SMOOTH * np.outer(prior, prior) * LABELS + 1e-9 for t in tables[2:]]
    lift = [np.log(p / p.sum()) - np.log(p.sum(1, keepdims=True) / p.sum()) - np.log(p.sum(0, keepdims=True) / p.sum()) for p in pair]
    return Field(unary[0], unary[1] - np.log(prior), *(np.clip(x, -6, 6) for x in lift))


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(-1, keepdims=True)))[..., 0]


def marginals(c: Candidates, field: Field) -> np.ndarray:
    """Label probabilities of every candidate after ``ROUNDS`` of damped loopy sum-product."""
    own = field.shape[c.shape] + field.before[c.before]
    label = np.array(c.label)
    seen = label >= 0
    own[seen] = np.where(np.arange(LABELS) == label[seen, None], 0.0, -50.0)
    edges = np.array([*c.chain, *c.skip], np.int64).reshape(-1, 2)
    table = np.concatenate([np.repeat(t[None], n, 0) for t, n in ((field.chain, len(c.chain)), (field.skip, len(c.skip)))])
    # messages both ways: row e goes from a to b, row e + E from b to a
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(a), LABELS))
    for _ in range(ROUNDS if len(a) else 0):
        belief = own.copy()
        np.add.at(belief, b, message)
        new = _log_sum((belief[a] - message[back])[:, None, :] + table.transpose(0, 2, 1))
        new -= _log_sum(new)[:, None]
        message = DAMPING * message + (1 - DAMPING) * new
    np.add.at(own, b, message)
    return np.exp(own - _log_sum(own)[:, None])


def _find(field: Field, data: list[bytes]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base: list[list] = [[] for _ in data]
    added: list[list] = [[] for _ in data]
    c = _empty()

    def label() -> None:
        if not all(y >= 0 for y in c.label):
            p = marginals(c, field)
            for i in np.flatnonzero((np.array(c.label) < 0) & (p[:, 1:].max(1) >= CERTAIN)):
                row, start, end = c.spans[i]
                if end > start:
                    added[row].append((int(p[i, 1:].argmax()), start, end))
        for x in (c.spans, c.label, c.shape, c.before, c.chain, c.skip):
            x.clear()

    for row, raw in enumerate(data):
        if not _WORTH.search(raw):
            continue
        text = raw.decode()
        base[row] = base_spans(text)
        add_candidates(c, row, text, base[row], hide=True)
        if len(c.spans) >= CANDIDATES:  # documents are never split
            label()
    label()
    return list(zip(base, added, strict=True))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _as_spans(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, base and added spans (kind, start, end in code points, end exclusive).

    Spans are sorted by kind as in ``KINDS``, then start. Null and empty texts have none;
    rows are independent but for the learned potentials; an empty table gives an empty
    result; other columns are not read.
    """
    rows = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _find(field, list(rows_of(batch)))
            spans = [pa.array([_as_spans(f[k]) for f in found], _SPAN) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *spans], names=["id", "base", "added"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {span}, added {span}")


def summary(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = lambda s: F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    return found.select(
        "id", *[count(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"))


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and the length column, if any, set anew.

    Overlapping spans become one, named after the first. Rows without spans, and null
    texts, stay as they are; all columns are kept.
    """

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, end, kind in sorted((a, b, k) for k, a, b in spans):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _find(field, list(rows_of(batch, text_col)))
            names, cleaned = batch.schema.names, batch.column(text_col).to_pylist()
            for i, (base, added) in enumerate(found):
                if base or added:
                    cleaned[i] = clean(cleaned[i], base + added)
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(cleaned, batch.schema.field(text_col).type)
            if length_col in names:
                changed = [len(t) if t is not None and (f[0] or f[1]) else n
                           for t, n, f in zip(cleaned, batch.column(length_col).to_pylist(), found, strict=True)]
                columns[names.index(length_col)] = pa.array(changed, batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
