import hashlib
import itertools
import random
import re
import zlib

import pytest

from boxlens.llm import registry, repair
from boxlens.llm.common import read

SF = "/root/testdata/sf0.001"
WHITE = "\x20\t\n\x0b\x0c\r"


def damaged(rows):
    """Plain version of the damage: rows after it, by turn."""
    out = []
    for r in rows:
        conv, turn = (" " if r[k] is None else str(r[k]) for k in (0, 1))
        role, text = (" " if x is None else x for x in r[2:])
        way = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(r[1], "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def fault_of(rows, i):
    _, role, text = rows[i]
    if not text.strip(WHITE):
        return "b"
    if any((role, text) == r[1:] for r in rows[:i]):
        return "d"
    return "" if text.strip(WHITE)[-1] in ".!?" else "t"


def slow_report(rows):
    """Plain dynamic programme over (rows read, role initials so far mod the grammar), all edits tried, whole strings compared."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(to, key, value):
        if key is not None and (key not in to or value[:2] < to[key][:2]):
            to[key] = value
            return True
        return False

    def insertions(at):
        while any([better(at, step.get((k, n[0])), (c + 5, a + "I", (*o, n + ":"))) for k, (c, a, o) in list(at.items()) for n in ("user", "assistant")]):
            pass

    for (_, role, text), fault in zip(rows, faults, strict=True):
        insertions(best)
        after = {}
        for k, (c, a, o) in best.items():
            better(after, k, (c + 2, a + "D", o))
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                better(after, step.get((k, role[:1])), (c + more, a + "K", (*o, f"{role}:{text}")))
                for n in ("user", "assistant"):
                    better(after, step.get((k, n[0])), (c + 1 + more, a + "R", (*o, f"{n}:{text}")))
        best = after
    insertions(best)
    cost, audit, lines = min(v for k, v in best.items() if k in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def as_rows(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_matches_the_plain_version(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {c: slow_report(damaged(rs)) for c, rs in by.items()}
    assert as_rows(registry.op13_repair(spark, sf)) == want
    assert sum(v[-2] != "K" * len(v[-2]) for v in want.values()) > 0.2 * len(want)


def every_edit(rows, faults):
    """Least (cost, audit) over all edit lists with at most two insertions in a place, for tiny inputs."""
    found = []
    gaps = ["", "I", "II"]
    for acts in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("b", "d") and e != "D" for e, f in zip(acts, faults, strict=True)):
            continue
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit = inserts[0] + "".join(e + g for e, g in zip(acts, inserts[1:], strict=True))
            kept = [(e, i) for e, i in zip(acts, rows, strict=True)]
            options, at = [], 0
            for letter in audit:
                if letter == "I":
                    options.append("ua")
                else:
                    e, initial = kept[at]
                    options += [] if e == "D" else [initial if e == "K" else "ua"]
                    at += 1
            if any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*options)):
                cost = 5 * audit.count("I") + 2 * audit.count("D") + audit.count("R")
                cost += sum(5 for e, f in zip(acts, faults, strict=True) if f == "t" and e != "D")
                found.append((cost, audit))
    return min(found)


def test_parser_against_every_edit_list():
    for n in range(4):
        for rows in itertools.product("suax", repeat=n):
            for faults in itertools.product(["", "t", "d"], repeat=n):
                if n == 3 and zlib.crc32(repr((rows, faults)).encode()) % 29:
                    continue
                assert repair.ended(repair.parse([(r, f, 1) for r, f in zip(rows, faults, strict=True)])) == every_edit(rows, faults), (rows, faults)


def test_blocks_fold_to_the_whole(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(6):
        for turn in range(rng.choice([1, 3, 40])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
            rows.append((conv, turn, role, rng.choice(["Yes.", "no", " ", f"text {turn}!", f"text {turn % 3}?"])))
    rows += [(None, t, r, "Hi." if t else None) for t, r in ((None, "user"), (0, None), (5, "assistant"), (9, "user"))]
    rows += [(9, 1, "user", "Same.")] * 5 + [(9, 2, "assistant", "Good.")]
    rows += [(10, t, "user", "Same.") for t in range(30)]
    data = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    data = data.withColumn("fault", data.text).withColumn("conv", data.role)  # clashing names are not read
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], *(" " if x is None else x for x in r[2:])))
    want = {c: slow_report(sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, rs in by.items()}
    for block in (1, 2, 7, 512):
        report, turns = repair.repair(data, block=block)
        hashed = {r.conv: r.sha256 for r in repair.digests(turns).collect()}
        empty = hashlib.sha256(b"").hexdigest()
        assert {r.conv: (*tuple(r)[1:], hashed.get(r.conv, empty)) for r in report.collect()} == want, block


def test_empty_table_and_long_text(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    report, turns = repair.repair(spark.createDataFrame([], schema))
    assert report.collect() == turns.collect() == repair.digests(turns).collect() == []
    text = "long words " * 300_000 + "end."
    report, turns = repair.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Yes.")], schema))
    assert report.first().audit == "KK" and turns.orderBy("place").first().text == text
