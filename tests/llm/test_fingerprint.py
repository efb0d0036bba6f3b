import hashlib
import math
import random
import re
from collections import Counter

import xxhash

from boxlens.llm import fingerprint as W

SCHEMA = "doc_id bigint, text string, key string, fingerprint string, n long"
MASK = (1 << 64) - 1


def h64(value, seed):
    data = value.encode() if isinstance(value, str) else (value & MASK).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def h32(value, seed):
    return xxhash.xxh64_intdigest((value & 0xFFFFFFFF).to_bytes(4, "little"), seed & MASK)


def slow_levels(text, samples):
    """Least level of each sample; Spark hashes columns in turn, each with the hash before as its seed."""
    counts = Counter(w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", text.lower()) if w)
    out = []
    for k in range(samples):
        levels = []
        for w, n in counts.items():
            term = h64(w, 42)
            one = h32(k, h64(term, 42))
            two = h32(1, one)
            u = lambda x, shift, width: ((x >> shift & ((1 << width) - 1)) + 0.5) * 2.0**-width
            r, b = -math.log(u(one, 0, 21) * u(one, 21, 21)), u(one, 42, 22)
            log_c = math.log(-math.log(u(two, 0, 32) * u(two, 32, 32)))
            levels.append(log_c - r * (math.floor(math.log(n) / r + b) - b + 1))
        out.append(min(levels, default=None))
    return out


def slow_edit(rows):
    rows = sorted(set((i is None, i, t or "") for i, t in rows), key=lambda r: (r[0], r[1] or 0, (lambda v: v - (1 << 64) if v >> 63 else v)(h64(r[2], 42))))
    out = {}
    for j, (_, i, t) in enumerate(rows):
        m, following = len(t) // 4, rows[(j + 1) % len(rows)][2]
        out[i, t] = t[: len(t) - m] + following[:m], following
    return out


def corpus():
    rng = random.Random(9)
    vocab = ["The", "of", "été", "日本", "x"] + [f"w{i}" for i in range(80)]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "\n", "  "]) for _ in range(rng.choice([1, 3, 40, 200])))) for i in range(0, 120, 2)]
    return rows + [(1, None), (3, ""), (5, " \n\t"), (7, rows[3][1]), (0, rows[0][1]), (0, rows[0][1]), (0, "other text of the same id"), (None, "no id at all here"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "f", 1) for i, t in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = corpus()
    got = sorted(W.fingerprints(frame(spark, rows)).collect(), key=str)
    assert len(got) == len(rows)
    edits, levels = slow_edit(rows), {}

    def of(t):
        if t not in levels:
            levels[t] = slow_levels(t, W.SAMPLES)
        return levels[t]

    like = lambda a, b: sum(x == y for x, y in zip(of(a), of(b), strict=True)) / W.SAMPLES
    want = []
    for i, t in rows:
        edited, following = edits[i, t or ""]
        want.append((i, len(t or ""), hashlib.sha256(edited.encode()).hexdigest(), like(t or "", edited), like(t or "", following)))
    assert sorted(((r.id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert by[7][0].fingerprint == by[6][0].fingerprint and len(by[7][0].fingerprint) == 8 * W.SAMPLES
    assert set(by[1][0].fingerprint) == {"0"} == set(by[5][0].fingerprint)


def test_collisions_follow_generalised_jaccard(spark):
    rng, rows, truth = random.Random(1), [], {}
    for i in range(30):
        a = Counter({f"w{rng.randrange(60)}": rng.randrange(1, 9) for _ in range(40)})
        b = Counter({w: max(0, n + rng.randrange(-2, 3)) for w, n in a.items()}) + Counter({f"w{rng.randrange(60)}": 2 for _ in range(rng.randrange(9))})
        truth[i] = sum((a & b).values()) / sum((a | b).values())
        rows += [(f"{i}a", " ".join(a.elements())), (f"{i}b", " ".join(b.elements()))]
    sig = {r.key: r.signature for r in W.signatures(spark.createDataFrame(rows, "key string, text string"), samples=96).collect()}
    found = [sum(x == y for x, y in zip(sig[f"{i}a"], sig[f"{i}b"], strict=True)) / 96 - truth[i] for i in range(30)]
    assert abs(sum(found) / 30) < 0.03 and max(map(abs, found)) < 0.2


def test_small_tables(spark):
    assert W.fingerprints(frame(spark, [])).collect() == []
    r = W.fingerprints(frame(spark, [(4, "abcd efgh")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and r.near_next == 1.0
