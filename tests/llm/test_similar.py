import random

import numpy as np

import corpus_pipeline
from boxlens.llm import similar

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, digest string, n string"


def slow_sets(rows):
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        out.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def slow_components(rows):
    """Least id of the component of every row, from all pairs of sets."""
    sets, part = slow_sets(rows), list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    return [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]


def corpus():
    """Copies with edits around the threshold, chains, a common line and short texts."""
    rng = random.Random(3)
    vocab = ["The", "of", "été", "日本語"] + [f"w{i}x" for i in range(300)]
    line = [rng.choice(vocab) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c d e"), (6, "a b c d f"), (7, "b a b c d e a b c d e")]
    for i in range(30):
        base = line + [rng.choice(vocab) for _ in range(rng.choice([8, 30, 150]))]
        for k in range(rng.choice([1, 3, 12])):
            rows.append((100 + len(rows), " ".join(base)))
            base = list(base)
            for _ in range(1 + k % 3):
                base[rng.randrange(len(base))] = rng.choice(vocab)
    return rows + [rows[20], (900, rows[30][1].upper())]


def test_groups_match_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "d", "n") for i, t in rows], SCHEMA).repartition(5)
    names = {r.digest: r.component for r in similar.similar_groups(frame).collect()}
    digest = lambda t: int(np.uint64(similar.xxhash.xxh3_64_intdigest(similar.shingles((t or "").encode()).tobytes())).astype(np.int64))
    assert [names[digest(t)] for _, t in rows] == slow_components(rows)
    assert similar.similar_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stage_takes_edited_copies(spark):
    """Both pairs have a similarity of over 0.8, and 7 and 11 bits between three-word SimHashes."""
    docs = corpus_pipeline.read(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()}
    assert not kept & {145, 177} and {1, 6} & kept == {1, 6}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept == set(slow_components(rows))


def test_long_text_in_slices(monkeypatch):
    text = " ".join(str(i % 37) + "x" * (i % 5) for i in range(1000)).encode()
    whole = similar.shingles(text)
    monkeypatch.setattr(similar, "SLICE", 7)
    assert (similar.shingles(text) == whole).all()


def test_stage_judges_rows_that_repeat_an_id_by_their_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (2, two), (None, three), (None, three), (None, one), (None, one), (3, one)]
    frame = spark.createDataFrame([(i, t, "d", "n") for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.one_of_each_group(spark, frame, SF).collect()))
    assert kept == [(0, three), (1, one), (1, two)]


def test_tiles_find_what_stars_leave(spark, monkeypatch):
    """Groups larger than a tile, all pairs in tiles only, and frequent shingles that pass without a look."""
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "d", "n") for i, t in rows], SCHEMA).repartition(5)
    for name, value in (("TILE", 2), ("TURNS", 1), ("HOT", 8), ("SAMPLE", 1), ("BUCKET_ROWS", 1)):
        monkeypatch.setattr(similar, name, value)
    names = {r.digest: r.component for r in similar.similar_groups(frame).collect()}
    digest = lambda t: similar._digest(similar.shingles((t or "").encode()))
    assert [names[digest(t)] for _, t in rows] == slow_components(rows)


def test_simhash_radius_keeps_links():
    """Of drawn pairs around the threshold all lie well within the radius, and unrelated ones beyond it."""
    rng = np.random.default_rng(5)
    far = lambda x, y: int(np.bitwise_count(similar.simhash(x) ^ similar.simhash(y)).sum())
    for n in (similar.FEW, 100, 1000):
        near, apart = [], []
        for _ in range(300):
            every = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            common = -(-8 * n // 9)  # of n each: similarity 0.8
            x, y = every[:n], np.r_[every[:common], every[n : 2 * n - common]]
            near.append(far(x, y))
            apart.append(far(x, every[n:]))
        assert max(near) <= similar.RADIUS - 15 and min(apart) > similar.RADIUS


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Copies of one text, up to and beyond the least similarity to it, are not all compared with each other."""
    rng = random.Random(8)
    base = [f"w{i}x" for i in range(150)]
    rows = [(1, " ".join(base))]
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((2 + i, " ".join(words)))
    pairs, write = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df, name: (t := write(df, name), name == "similar-pairs" and pairs.append(t.count()))[0])
    monkeypatch.setattr(similar, "SAMPLE", 1)
    frame = spark.createDataFrame([(i, t, "d", "n") for i, t in rows], SCHEMA).repartition(5)
    names = {r.digest: r.component for r in similar.similar_groups(frame).collect()}
    assert [names[similar._digest(similar.shingles(t.encode()))] for _, t in rows] == slow_components(rows)
    assert sum(pairs) < 3 * len(rows)
