import random

import numpy as np
import pytest

from boxlens.llm import chunks as C

SCHEMA = "doc_id bigint, text string, digest string, n string, shared int"


def slow_cuts(text: bytes):
    """Gear hash byte by byte, and every window looked at whole."""
    h, hashes = 0, []
    for i, b in enumerate(text):
        h = ((h << 1) + int(C._GEAR[b])) & 0xFFFFFFFF
        own = sum(int(C._GEAR[text[i - k]]) << k for k in range(min(i + 1, C.CONTEXT))) & 0xFFFFFFFF
        inside = i + 1 < len(text) and text[i + 1] & 0xC0 == 0x80
        hashes.append(0xFFFFFFFF if inside or i < C.CONTEXT - 1 else own)
    chosen = sorted({min(range(i, i + C.WINDOW), key=lambda j: (hashes[j], j)) for i in range(len(text) - C.WINDOW + 1)})
    ends, last = [], 0
    for k, i in enumerate(chosen):
        again = k and hashes[i] == hashes[chosen[k - 1]] and i - chosen[k - 1] <= C.WINDOW
        if not again and hashes[i] != 0xFFFFFFFF and i + 1 < len(text):
            ends.append(i + 1)
    out = []
    for c in [*ends, len(text)] if text else []:
        while c - last > C.LONGEST:
            last += C.LONGEST
            out.append(last)
        out.append(c)
        last = c
    return out


def words(rng, n):
    vocab = ["The", "of", "été", "well-known"] + [f"w{i}x" for i in range(300)]
    return [rng.choice(vocab) for _ in range(n)]


def test_cuts_match_the_rolling_hash(monkeypatch):
    rng = random.Random(1)
    for text in (b"", b"a", b"ab" * 5, " ".join(words(rng, 800)).encode(), ("日本語 été " * 3 + "x").encode()):
        assert C.cuts(text).tolist() == slow_cuts(text)
    text = " ".join(words(rng, 3000)).encode() + "日本語の文".encode() * 40 + b"abc" * 300
    whole = C.cuts(text).tolist()
    for size in (1000, 64, 77):
        monkeypatch.setattr(C, "SLICE", size)
        assert C.cuts(text).tolist() == whole
    assert 25 < np.diff([0, *whole]).mean() < 45


@pytest.mark.parametrize("text", ["a" * 100_000, "日" * 50_000, "é" * 1000 + "a" * 5000, "\n" * 3000])
def test_dull_texts(text):
    data = text.encode()
    ends = C.cuts(data)
    size = np.diff([0, *ends])
    assert ends[-1] == len(data) and size.min() > 0 and size.max() <= C.LONGEST + 3 and len(ends) < len(data) / 50
    for a, b in zip([0, *ends], ends):
        data[a:b].decode()


def test_insertions_move_near_cuts_only():
    rng = random.Random(2)
    text = " ".join(words(rng, 4000)).encode()
    chunks = lambda t: {t[a:b] for a, b in zip([0, *C.cuts(t)], C.cuts(t))}
    changed = text[:9000] + b"an insertion " + text[9000:]
    assert len(chunks(text) - chunks(changed)) <= 6


def test_every_passage_holds_a_chunk_wherever_it_stands():
    """20,000 passages of SHORTEST bytes in other surroundings: none is without a whole chunk, and none reaches beyond its region."""
    rng = random.Random(3)
    for _ in range(20_000):
        passage = bytes(rng.choices(b"etaoin shrdlu", k=C.SHORTEST))
        sets = []
        for _ in range(2):
            before = bytes(rng.choices(b"etaoin shrdlu", k=rng.randrange(100)))
            text = before + passage + bytes(rng.choices(b"etaoin shrdlu", k=rng.randrange(100)))
            sets.append((text, len(before), C.cuts(text)))
        seen = [{t[a:b] for a, b in zip([0, *e], e)} for t, _, e in sets]
        for text, at, ends in sets:
            flags = np.array([text[a:b] in seen[0] & seen[1] for a, b in zip([0, *ends], ends)])
            assert any(lo <= at and at + len(passage) <= hi for lo, hi in C.regions(ends, flags))


def slow_words(text):
    """Character by character."""
    spans, begin = [], None
    for i, c in enumerate(text + " "):
        alone = "฀" <= c <= "៿" or "　" <= c <= "鿿" or c >= "\U00020000"
        if c in " \t\n\r\x0b\x0c" or alone:
            if begin is not None:
                spans.append((begin, i))
            begin = None
            if alone:
                spans.append((i, i + 1))
        elif begin is None:
            begin = i
    return spans


def test_words():
    rng = random.Random(4)
    for text in ("", " ", "a", "日", "a日b c​d ไทย 한국 말\t𠀀x é—“q”", *("".join(rng.choices("ab é日ไ한—𠀀\n", k=60)) for _ in range(300))):
        a, b = C.word_table(text.encode())
        assert [(len(text.encode()[:i].decode()), len(text.encode()[:j].decode())) for i, j in zip(a, b)] == slow_words(text)


def slow(rows, min_words):
    """Shared and removed spans from all windows of all documents."""
    holders, table = {}, []
    for i, t in rows:
        t = t or ""
        spans = slow_words(t)
        found = [(a, spans[k + min_words - 1][1]) for k, (a, _) in enumerate(spans[: max(0, len(spans) - min_words + 1)])]
        table.append((i, t, found))
        for a, b in found if i is not None else ():
            holders.setdefault(t[a:b], set()).add(i)
    out = []
    for i, t, found in table:
        result = []
        for want in (lambda w: len(holders[w]) > 1, lambda w: min(holders[w]) < i):
            spans = []
            for a, b in found if i is not None else ():
                if want(t[a:b]):
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], b)
                    else:
                        spans.append((a, b))
            result.append(spans)
        kept, at = "", 0
        for a, b in result[1]:
            kept += t[at:a]
            at = b
        out.append((i, kept + t[at:], *result))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    passages = [" ".join(words(rng, n)) for n in (50, 51, 55, 70, 120, 200, 9, 12, 49)]
    passages += ["".join(rng.choices("日本語中文字書体漢", k=600)), "".join(rng.choices("กขคงจฉชซ", k=90))]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "a b " * 400), (5, "x a b a b " + "a b " * 300)]
    for i in range(90):
        parts = [" ".join(words(rng, rng.randrange(5, 120)))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), rng.choice(passages))
        if i % 5 == 0:
            parts.insert(0, passages[6])
        if i % 7 == 0:
            parts.append(rng.choice(passages))
        rows.append((10 + i, rng.choice("\n ").join(parts)))
    return rows + [(200, rows[9][1]), (None, rows[9][1]), (10, "another row of id ten " + passages[5]), (201, passages[5]), (202, passages[1]), rows[12], rows[12]]


def test_matches_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "d", "n", 1) for i, t in rows], SCHEMA)
    pairs = lambda s: [(x.start, x.end) for x in s]
    got = sorted(((r.id, r.text, pairs(r.shared), pairs(r.removed)) for r in C.deduplicate(frame).collect()), key=str)
    assert got == slow(rows, C.MIN_WORDS)
    assert sum(bool(r[3]) for r in got) > 20


def test_passages_of_51_words_go_and_short_ones_stay(spark):
    rng = random.Random(11)
    rows, passages = [], {}
    for i in range(5000):
        passages[i] = words(rng, 51 + i % 40)
        for k in (0, 10_000):
            rows.append((k + i, " ".join([*words(rng, 30), *passages[i], *words(rng, 30)])))
        if i < 500:
            line = words(rng, 45)
            for k in (20_000, 30_000):
                rows.append((k + i, " ".join([*line, *words(rng, 60)])))
    frame = spark.createDataFrame([(i, t, "d", "n", 1) for i, t in rows], SCHEMA)
    got = {r.id: r for r in C.deduplicate(frame).collect()}
    text = dict(rows)
    assert all(got[k + i].text == text[k + i] and not got[k + i].shared for i in range(500) for k in (20_000, 30_000))
    assert all(got[i].text == text[i] and got[i].shared for i in range(5000))
    assert all(" ".join(passages[i]) not in got[10_000 + i].text and len(got[10_000 + i].text.split()) <= 60 for i in range(5000))


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(12)
    text = " ".join(words(rng, 200_000))
    frame = spark.createDataFrame([(1, text, "", "", 0), (2, "own words first\n" + text, "", "", 0)], SCHEMA)
    got = {r.id: r for r in C.deduplicate(frame).collect()}
    assert got[1].text == text and got[2].text == "own words first\n"
    assert [(s.start, s.end) for s in got[2].removed] == [(16, 16 + len(text))]


def test_empty(spark):
    assert C.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []
