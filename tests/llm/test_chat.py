import hashlib
import random

from boxlens.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, depth int"


def corpus():
    rng = random.Random(4)
    say = ["hi", "", "<turn:", "</turn>", "\\l", "\\", "\\\\b<", ">", "é😀", "a\nb", "x" * 900]
    rows = [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    for c in range(120):
        turns = ["shared opening"] if c % 3 else []
        turns += [rng.choice(say) + rng.choice(["", "<", "b"]) for _ in range(rng.randrange(1, 5))]
        rows += [(c, t, ["user", "assistant", "system", "<odd>\\g"][rng.randrange(4) if t else 0], x) for t, x in enumerate(turns)]
    rows += [(500 + i, t, "user", "same") for i in range(60) for t in range(3)]
    rows += [(900, None, None, None), (900, 1, "assistant", None), (None, 3, "assistant", "z"), (901, 1, "b", "tie"), (901, 1, "a", "tie"), (901, 1, "a", "tie")]
    rng.shuffle(rows)
    return rows


def slow(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)


def test_read_back_is_lossless(spark):
    rows = corpus()
    nodes, members = chat.prefix_tree(frame(spark, rows))
    got = {r.conv: r for r in chat.digests(chat.read_back(nodes, members)).collect()}
    want = slow(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns))), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_tree_matches_a_plain_trie(spark):
    rows = corpus()
    nodes, members = chat.prefix_tree(frame(spark, rows))
    nodes = {r.node: r for r in nodes.collect()}
    prefixes = {tuple(t[: i + 1]) for t in slow(rows).values() for i in range(len(t))}
    assert len(nodes) == len(prefixes)  # every shared beginning once
    stream = sorted(nodes.values(), key=lambda r: r.start)
    at, stack = 0, []
    for r in stream:
        assert (r.start, r.length) == (at, len(r.formatted))  # no gaps, no overlaps
        at += r.length
        while stack and stack[-1].node != r.parent:
            stack.pop()
        assert (r.parent is None) == (not stack) and r.depth == len(stack)  # depth-first
        assert [(a.start, a.end) for a in r.ancestors] == [(s.start, s.start + s.length) for s in stack]
        assert r.position == sum(s.length for s in stack) and r.loss == (r.role == "assistant")
        stack.append(r)
    assert {m.node for m in members.collect()} <= nodes.keys()


def test_empty(spark):
    nodes, members = chat.prefix_tree(frame(spark, []))
    assert nodes.count() == members.count() == chat.read_back(nodes, members).count() == 0
