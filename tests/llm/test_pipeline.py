import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from boxlens.llm import bpe, decontaminate, pii, quality
from boxlens.llm.common import read
from tests.llm.test_decontaminate import slow_words
from tests.llm.test_similar import slow_components

SF = "/root/testdata/sf0.001"


def test_run_matches_stage_by_stage_brute_force(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    stats = quality.statistics_of(read(spark, SF, "documents"))
    model = quality.fit(stats, read(spark, SF, "labels"))
    docs = {i: t for i, t in docs.items() if model.score(np.array([quality.statistics(t.encode())]))[0] >= 0.5}
    docs = {i: docs[i] for i, c in zip(docs, slow_components(list(docs.items())), strict=True) if i == c}
    windows = set()
    for r in read(spark, SF, "benchmark").collect():
        ws = slow_words(r.text)
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))}
    grams = lambda ws: {tuple(ws[i : i + 10]) for i in range(len(ws) - 9)}
    assert all(len(w) == 10 for w in windows)
    docs = {i: t for i, t in docs.items() if not windows & grams(slow_words(t))}
    # the potentials are learned from what the stages before have kept
    field = pii.learn(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    for i, t in docs.items():
        base, added = pii._find(field, [t.encode()])[0]
        for k, a, b in sorted(base + added, key=lambda s: -s[1]):
            docs[i] = docs[i][:a] + f"[{pii.KINDS[k].upper()}]" + docs[i][b:]
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        ids = np.asarray(coder.encode_ordinary(t), "<u4").tobytes()
        want[i] = (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(got) < 200
    assert not any(re.search(r"@mail", t) for t in docs.values())


def test_stages_with_nulls_repeats_and_odd_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id bigint, fp string"
    text = "some words about nothing in particular that go on for a while and then end here"
    rows = [(1, text, "en", None, 80, "s", 1, "f"), (1, text, "en", None, 80, "s", 1, "f"), (2, text.upper(), None, "a", None, None, 7, ""), (None, text, "en", "a", 80, "s", 1, "f"),
            (3, None, "en", "a", None, "s", 1, "f"), (4, "", "en", "a", 0, "s", 1, "f"), (5, "mail a.b@c.de " + "word " * 50, "en", "a", 264, "s", 1, "f")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
            assert docs.columns == frame.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.count() == docs.count() and "doc_id" in out.columns
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, 5]


def test_contaminated_rows_go_alone(spark):
    """Neither rows without an id nor repeats of a contaminated row's id go with it."""
    item = next(r.text for r in read(spark, SF, "benchmark").collect() if len(slow_words(r.text)) > 12)
    clean = "nothing of any test is in here " * 3
    rows = [(None, f"x {item} y"), (None, clean), (1, clean), (1, item), (2, clean), (2, None), (None, "")]
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.clean_of_benchmarks(spark, frame, SF).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_the_rest_does_not_need_the_text_package():
    from pathlib import Path

    top = Path(corpus_pipeline.__file__).parent
    for path in (top / "boxlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "boxlens.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
    assert decontaminate.WINDOW == 10
