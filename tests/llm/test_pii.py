import hashlib
import random
import re

import numpy as np
import pytest

from boxlens.llm import pii as P
from boxlens.llm.common import read

SCHEMA = "doc_id bigint, text string, spans string, n_chars bigint"


def slow_spans(text):
    """The rules as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in digits(m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def noise():
    rng = random.Random(2)
    parts = ["a@b", "@", ".", "-", " ", "+1 (487) 555-7209", "4111111111111111", "1.2.3.4.5", "256.1.1.1", "007.08.9.255", "x.y-z@mail.example.com", "é@ü.de",
             "4111 1111-1111 1111", "+", "\n", "1", "23", "%_", "@a.b@c.d.e@f", "a@b..c", "4012888888881881 12", "+12345678", "日本"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]


def test_rules_match_the_stated_patterns():
    for text in noise():
        assert P.base_spans(text) == slow_spans(text), text


def test_rules_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000, "." * 200_000 + "@", "+1" + "(" * 200_000):
        P.base_spans(text)


def slow_marginals(c, field):
    """Exact by summing over all labellings; right for trees."""
    from itertools import product

    n, total = len(c.spans), np.zeros((len(c.spans), P.LABELS))
    for y in product(range(P.LABELS), repeat=n):
        if any(o >= 0 and o != v for o, v in zip(c.label, y, strict=True)):
            continue
        e = sum(field.shape[c.shape[i], y[i]] + field.before[c.before[i], y[i]] for i in range(n))
        e += sum(field.chain[y[a], y[b]] for a, b in c.chain) + sum(field.skip[y[a], y[b]] for a, b in c.skip)
        for i in range(n):
            total[i, y[i]] += np.exp(e)
    return total / total.sum(1, keepdims=True)


def test_message_passing_is_exact_on_trees(monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 60)
    rng = np.random.default_rng(0)
    pair = rng.normal(size=(2, P.LABELS, P.LABELS))
    field = P.Field(rng.normal(size=(8, P.LABELS)), rng.normal(size=(8, P.LABELS)), pair[0] + pair[0].T, pair[1] + pair[1].T)
    c = P.Candidates([(0, i, i + 1) for i in range(5)], [-1, 2, -1, -1, -1], [0, 1, 2, 3, 4], [5, 6, 7, 0, 1], [(0, 1), (1, 2)], [(0, 3), (2, 4)])
    assert np.allclose(P.marginals(c, field), slow_marginals(c, field), atol=1e-6)


def test_repeats_take_the_label_of_their_like(spark):
    phone = lambda i: f"+1 ({200 + i}) 555-{1000 + 37 * i}"
    rows = [(i, f"call {phone(i)} now, or 7 of {i}.", "", 0) for i in range(300)] + [(i, f"only {i} and 12 things", "", 0) for i in range(300, 500)]
    rows += [(900, f"call {phone(5)} or just ask for 555-{1000 + 37 * 5} there", "", 0), (901, "", "", 0), (902, None, "", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    field = P.learn(frame)
    found = {r.id: r for r in P.find(frame, field).collect()}
    assert len(found[5].base) == 1 and found[5].added == [] and found[400].added == []
    text = rows[500][1]
    assert [(s.kind, text[s.start : s.end]) for s in found[900].added] == [("phone", f"555-{1000 + 37 * 5}")]
    assert found[901].base == found[902].base == []
    kept = {r.doc_id: r for r in P.redact(frame, field).collect()}
    assert kept[900].text == "call [PHONE] or just ask for [PHONE] there" and kept[900].n_chars == len(kept[900].text)
    assert kept[400].text == rows[400][1] and kept[902].text is None


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    got = {r.id: r for r in P.summary(P.find(docs, P.learn(docs))).collect()}
    clean = 0
    for r in docs.collect():
        base = slow_spans(r.text)
        text = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert not base or set(text.split(",")) <= set(row.spans.split(","))
        clean += not base and row.spans != ""
    assert clean == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, "a@b.cd", "", 6)] * 3])
def test_small_tables(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    field = P.learn(frame)
    assert P.summary(P.find(frame, field)).count() == len(rows) == P.redact(frame, field).count()
