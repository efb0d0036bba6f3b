import hashlib
import random

import pytest
import numpy as np
import public_tokenizers
import tiktoken

from boxlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def samples():
    rng = random.Random(1)
    alphabets = ["abcdefghij etaoin", "äöüßéèñ ÀÇ", "日本語中文字", "0123456789 ", " \t\n\r\x0b\x1c\x85\u2028\xa0", "!?.,;'\"#$%", "\U0001F600\U0001F4A9\u200d", "'s't're've'm'll'd ", "\u2581 _", "\x00\x01\x7f\xad\ufeff"]
    out = ["", " ", "a", "<unk>", "<s></s>", "<0x41>", "don't stop  \n\n x", "x" * 5000, "ab" * 3000, " " * 300 + "z", "\u2581\u2581a"]
    for _ in range(400):
        pick = [rng.choice(alphabets) for _ in range(rng.choice([1, 2, 5]))]
        out.append("".join(rng.choice(rng.choice(pick)) for _ in range(rng.randrange(1, 120))))
    return out


def test_same_ids_as_ranks(tokens, reference):
    codec = bpe.Codec(tokens, public_tokenizers.PATTERN)
    for text in samples():
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_every_token_of_the_model(tokens):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.model_proto(tokens))
    letters = bpe.byte_letters()
    assert len(set(letters)) == 256 and model.vocab_size() == len(tokens) + 1
    for i in range(0, len(tokens), 97):
        assert model.id_to_piece(i) == "".join(letters[b] for b in tokens[i])


def test_whole_table(spark, reference):
    rows = [(i, t) for i, t in enumerate(samples())] + [(7, "again"), (7, "again"), (None, None)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = sorted(((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(frame, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((str(r.id), bytes(r.data)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert bpe.round_trip(frame.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
