"""Repair of conversation structure by generalised LR parsing (operator 13).

A conversation is right if its role initials read ``(s?(ua)+)?``. The parser reads the rows
of a conversation in order and may keep, rerole or delete each and insert empty turns in
between, all at a cost. It runs every possibility at once on a graph-structured stack: tops
that are equal after the same rows merge, and of merged tops the least (cost, audit) stays,
audit being the letters of the edits so far. That is exact: of two edit lists of equal cost
for the same rows none is the beginning of the other (they would differ by insertions, which
cost), so what is least before a common rest is least after it.

Conversations may be of any size: rows are sorted into range blocks, and a block of at most
``BLOCK`` rows gives, for every stack top that it may start from, the least edits to every
top it may end with. A fold over the blocks of a conversation then picks the edits, and the
blocks apply them, each on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import partitions
from boxlens.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last for a truncated row that is not deleted
BLOCK = 512  # rows of a conversation that are parsed together
TABLES = 256  # rows of a batch of block tables
NAMES = {"u": "user", "a": "assistant"}

#: SLR tables of the role grammar: C -> empty | A;  A -> H u a | A u a;  H -> empty | s.
#: States: 0 start, 1 after s, 2 after H, 3 after H u, 4 after H u a, 5 after A, 6 after A u, 7 after A u a.
SHIFT = {(0, "s"): 1, (2, "u"): 3, (3, "a"): 4, (5, "u"): 6, (6, "a"): 7}
#: state -> (rows popped, symbol pushed) whatever follows, or (with the symbol that follows) only before it
REDUCE = {1: (1, "H"), 4: (3, "A"), 7: (3, "A"), (0, "u"): (0, "H")}
GOTO = {(0, "H"): 2, (0, "A"): 5}
ACCEPT = (0, 5)


def _read(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after the reductions before ``symbol``, its shift, and those that follow whatever comes; None if it cannot be read."""

    def reduced(by: tuple[int, str]) -> tuple[int, ...]:
        rest = stack[: len(stack) - by[0]]
        return (*rest, GOTO[rest[-1], by[1]])

    while (stack[-1], symbol) in REDUCE:
        stack = reduced(REDUCE[stack[-1], symbol])
    if (stack[-1], symbol) not in SHIFT:
        return None
    stack = (*stack, SHIFT[stack[-1], symbol])
    while stack[-1] in REDUCE:
        stack = reduced(REDUCE[stack[-1]])
    return stack


def _reachable() -> dict[int, dict[str, int]]:
    """Top -> symbol -> next top, for every top at rest. Each top lies on one stack only, so a top stands for its stack."""
    stacks, moves = {0: (0,)}, {}
    while left := stacks.keys() - moves.keys():
        for top in left:
            found = {c: s for c in "sua" if (s := _read(stacks[top], c))}
            moves[top] = {c: s[-1] for c, s in found.items()}
            for s in found.values():
                assert stacks.setdefault(s[-1], s) == s
    return moves


MOVES = _reachable()
TOPS = tuple(sorted(MOVES))
Tops = dict[int, tuple[int, str]]


def _enter(tops: Tops, top: int, cost: int, audit: str) -> bool:
    """Merge into an equal top; whether the new edits are the least."""
    if top in tops and tops[top] <= (cost, audit):
        return False
    tops[top] = (cost, audit)
    return True


def _insert(tops: Tops) -> None:
    """Add what insertions reach from any top."""
    todo = list(tops)
    while todo:
        top = todo.pop()
        cost, audit = tops[top]
        todo += [to for symbol, to in MOVES[top].items() if symbol in NAMES and _enter(tops, to, cost + INSERT, audit + "I")]


def parse(rows: list[tuple[str, str, int]], start: int = 0) -> Tops:
    """Tops after (role initial, fault, copies) rows: fault b blank, d duplicate (both must go), t truncated or ``""``.

    All copies but the first must go; insertions between them would only move an I before a D.
    """
    tops: Tops = {start: (0, "")}
    for initial, fault, copies in rows:
        _insert(tops)
        after: Tops = {}
        extra = TRUNCATED if fault == "t" else 0
        for top, (cost, audit) in tops.items():
            _enter(after, top, cost + DELETE, audit + "D")
            if fault in ("b", "d"):
                continue
            for symbol, to in MOVES[top].items():
                if symbol == initial:
                    _enter(after, to, cost + KEEP + extra, audit + "K")
                if symbol in NAMES:
                    _enter(after, to, cost + REROLE + extra, audit + "R")
        more = copies - 1
        tops = {t: (c + DELETE * more, x + "D" * more) for t, (c, x) in after.items()} if more else after
    _insert(tops)
    return tops


def ended(tops: Tops) -> tuple[int, str]:
    """Least (cost, audit) of the tops that may end a conversation."""
    return min(tops[t] for t in ACCEPT if t in tops)


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows (conv, turn, role, text) as one with ``copies``, its fault, and ``again`` (whether role and text came before)."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = rows.groupBy("conv", "role", "text").agg(F.min(at).alias("first"))
    first = first.select(*[F.col(c).alias("first_" + c) for c in ("conv", "role", "text")], F.col("first.turn").alias("first_turn"), F.lit(True).alias("is_first"))
    same = [F.col(c).eqNullSafe(F.col("first_" + c)) for c in ("conv", "turn", "role", "text")]
    marked = rows.join(first, same, "left").select(*rows.columns, F.col("is_first").isNull().alias("again"))
    last = _last_character(F.col("text"))
    fault = F.when(last == "", "b").when(F.col("again"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return marked.withColumn("fault", fault)


_NUMBERED = "conv {0}, turn bigint, role string, text string, copies bigint, fault string, block bigint, i bigint, opens boolean"
_TABLE = "conv {0}, block bigint, first string, last string, illegal bigint, n bigint, table array<struct<start:int,stop:int,cost:bigint,audit:string>>"
_EDITS = "conv {0}, block bigint, edits string, place bigint, odd boolean, cost bigint, illegal bigint"
_EDGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _number(block: int):
    """Sorted rows with their block, their place in it, and whether the block is known to open its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        known, last, at, i, opens = False, (), base - 1, 0, False
        for batch in batches:
            found = []
            for conv in batch.column("conv").to_pylist():
                if last != (conv,):
                    # the first conversation of a task may go on from the task before
                    opens, known, last, at, i = known, True, (conv,), at + 1, 0
                elif i == block:
                    opens, at, i = False, at + 1, 0
                found.append((at, i, opens))
                i += 1
            extra = _batch(found, ["block", "i", "opens"], [pa.int64(), pa.int64(), pa.bool_()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.columns], names=[*batch.schema.names, *extra.schema.names])

    return run


def _block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of sorted rows: role initials at its ends, illegal pairs, rows, and its parse from every top it may start from."""
    key, rows, out, kind = None, [], [], None

    def close() -> tuple:
        conv, block, opens = key
        edges = [{"start": s, "stop": t, "cost": c, "audit": x} for s in (TOPS[:1] if opens else TOPS) for t, (c, x) in parse(rows, s).items()]
        # copies of a row never stand rightly side by side
        pairs = sum(not _legal(x[0] + y[0]) for x, y in zip(rows, rows[1:], strict=False)) + sum(r[2] - 1 for r in rows)
        return conv, block, rows[0][0], rows[-1][0], pairs, sum(r[2] for r in rows), edges

    def flush() -> pa.RecordBatch:
        made = _batch(out, ["conv", "block", "first", "last", "illegal", "n", "table"], [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), _EDGES])
        out.clear()
        return made

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, block, opens, *row in zip(*[batch.column(c).to_pylist() for c in ("conv", "block", "opens", "initial", "fault", "copies")], strict=True):
            if key != (conv, block, opens):
                if rows:
                    out.append(close())
                key, rows = (conv, block, opens), []
            rows.append(tuple(row))
            if len(out) == TABLES:
                yield flush()
    if rows:
        out.append(close())
    if out:
        yield flush()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least edits of every conversation over its blocks in order; a row per block with its edits and where its output begins."""
    conv, tops, last, illegal, blocks, out, kind = (), {}, "", 0, [], [], None

    def close() -> None:
        cost, audit = ended(tops)
        odd = (len(audit) - audit.count("D")) % 2 == 1  # then the first turn left is the system's
        at = place = 0
        for i, (block, n) in enumerate(blocks):
            # insertions before a row go with it, those after the last with the last block
            stop = len(audit) if i == len(blocks) - 1 else re.compile(f"(?:I*[DKR]){{{n}}}").match(audit, at).end()
            edits = audit[at:stop]
            out.append((conv[0], block, edits, place, odd, 0 if i else cost, 0 if i else illegal))
            at, place = stop, place + len(edits) - edits.count("D")

    def flush() -> pa.RecordBatch:
        made = _batch(out, ["conv", "block", "edits", "place", "odd", "cost", "illegal"], [kind, pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()])
        out.clear()
        return made

    for batch in batches:
        kind = batch.schema.field("conv").type
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if conv != (r["conv"],):
                if conv:
                    close()
                conv, tops, last, illegal, blocks = (r["conv"],), {0: (0, "")}, "", 0, []
            elif not _legal(last + r["first"]):
                illegal += 1
            after: Tops = {}
            for e in r["table"]:
                if e["start"] in tops:
                    cost, audit = tops[e["start"]]
                    _enter(after, e["stop"], cost + e["cost"], audit + e["audit"])
            tops, last, illegal = after, r["last"], illegal + r["illegal"]
            blocks.append((r["block"], r["n"]))
            if len(out) >= TABLES:
                yield flush()
    if conv:
        close()
        yield flush()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns; the edits of a block come before its rows."""
    letters, left, place, odd = iter(()), 0, 0, False
    for batch in batches:
        out: list[tuple] = []
        for conv, i, edits, begins, is_odd, role, text, copies in zip(
                *[batch.column(c).to_pylist() for c in ("conv", "i", "edits", "place", "odd", "role", "text", "copies")], strict=True):
            if i < 0:
                letters, left, place, odd = iter(edits), len(edits) - edits.count("I"), begins, is_odd
                continue
            for _ in range(copies):
                for edit in letters:
                    if edit != "D":
                        named = NAMES["ua"[(place - odd) % 2]] if edit != "K" else role
                        out.append((conv, place, named, "" if edit == "I" else text, edit))
                        place += 1
                    if edit != "I":
                        left -= 1
                        break
            if not left:
                for edit in letters:
                    out.append((conv, place, NAMES["ua"[(place - odd) % 2]], "", edit))
                    place += 1
        yield _batch(out, ["conv", "place", "role", "text", "edit"], [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()])


def _report(rows: DataFrame, edits: DataFrame) -> DataFrame:
    many = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("copies")).otherwise(0))
    more = F.sum(F.when(F.col("fault").isin("", "t"), F.col("copies") - 1).otherwise(F.when(F.col("fault") == "d", F.col("copies")).otherwise(0)))
    turns = rows.groupBy("conv", "turn").agg(
        many("b").alias("blank"), more.alias("duplicate"), F.sum((F.col("fault") == "t").cast("bigint")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pieces = F.array_sort(F.collect_list(F.struct("block", "edits")))
    parsed = edits.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["edits"]), "").alias("audit"))
    return counts.join(parsed, counts["conv"].eqNullSafe(parsed["conv"])).select(
        counts["conv"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies_col: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, turns): counts, cost and audit per conversation, and its repaired turns (conv, place, role, text, edit).

    Report: conv, gaps in the turn numbers, rows that are blank, duplicate or truncated (the
    first that holds), illegal neighbours, cost, audit. Rows are read by turn, nulls first.

    Nulls: a null role or text is one space, a null conversation is one like any other, null
    turns come first and do not count for gaps. Ties: rows of one turn are read by role, then
    text. Repeated rows (``copies_col``: how often a row stands there) follow each other and
    all but the first are duplicates. Empty texts are blank. Very long texts stay in their
    rows and are never joined; a conversation's audit is one string. An empty table gives
    empty results; other columns are not read.
    """
    copies = rows[copies_col] if copies_col else F.lit(1)
    rows = rows.select(rows[conv_col].alias("conv"), rows[turn_col].cast("bigint").alias("turn"), F.coalesce(rows[role_col], F.lit(" ")).alias("role"),
                       F.coalesce(rows[text_col], F.lit(" ")).alias("text"), copies.cast("bigint").alias("copies"))
    kind, n = rows.schema["conv"].dataType.simpleString(), partitions(rows.sparkSession)
    order = ["conv", "turn", "role", "text"]
    dealt = with_faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = materialize(dealt.select("conv", "turn", "role", "text", "copies", "fault").mapInArrow(_number(block), _NUMBERED.format(kind)), "repair-rows")
    slim = numbered.select("conv", "block", "i", "opens", F.left("role", F.lit(1)).alias("initial"), "fault", "copies")
    by_block = lambda df: df.repartition(n, "conv", "block").sortWithinPartitions("conv", "block", "i")
    tables = by_block(slim).mapInArrow(_block_tables, _TABLE.format(kind))
    folded = tables.repartition(n, "conv").sortWithinPartitions("conv", "block")
    edits = materialize(folded.mapInArrow(_fold, _EDITS.format(kind)), "repair-edits")
    both = edits.select("conv", "block", F.lit(-1).cast("bigint").alias("i"), "edits", "place", "odd").unionByName(
        numbered.select("conv", "block", "i", "role", "text", "copies"), allowMissingColumns=True)
    turns = by_block(both).mapInArrow(_apply, f"conv {kind}, place bigint, role string, text string, edit string")
    return _report(numbered, edits), turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running, kind = (), None, None
    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        for own, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text")], strict=True):
            line = f"{role}:{text}".encode()
            if conv == (own,):
                running.update(b"\n" + line)
                continue
            if conv:
                out.append((conv[0], running.hexdigest()))
            conv, running = (own,), hashlib.sha256(line)
        yield _batch(out, ["conv", "sha256"], [kind, pa.string()])
    if conv:
        yield _batch([(conv[0], running.hexdigest())], ["conv", "sha256"], [kind, pa.string()])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of every conversation with turns; one line is in memory at a time."""
    dealt = turns.select("conv", "place", "role", "text").repartition(partitions(turns.sparkSession), "conv").sortWithinPartitions("conv", "place")
    return dealt.mapInArrow(_digest, f"conv {turns.schema['conv'].dataType.simpleString()}, sha256 string")
