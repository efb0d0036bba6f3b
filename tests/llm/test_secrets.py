import hashlib
import random
import re
import string
import uuid

import public_tokenizers
import pytest

from boxlens.llm import registry, secrets
from boxlens.llm.common import read

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(registry.RANKS)


def slow_base(text):
    """The rules as they are stated, on the text itself."""
    assign = re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.IGNORECASE | re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def spans(frame):
    show = lambda s: [f"{x.kind}:{x.start}:{x.end}" for x in s]
    return {r.id: (show(r.base), show(r.added)) for r in frame.collect()}


def find(spark, rows, **more):
    return spans(secrets.find(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, public_tokenizers.PATTERN, **more))


def test_query_has_the_base_spans_of_the_stated_rules(spark):
    want = {r.doc_id: slow_base(r.text or "") for r in read(spark, SF, "documents").collect()}
    rows = registry.op11_secrets(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(want) and sum(map(len, want.values())) > 10
    for r in rows:
        base = want[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in secrets.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
        assert r.n_random == 0  # the fixture's texts hold no random strings but those


PIECES = ["password: hunter22", "PASSWD='ab", "token=abc", "api-key=abcdef", "Api_Key = \"Zz9+/_.=-\"", "ſecret=abcdefg", "toKen=abcdefg", "AKIA" + "Q" * 16, "AKIA" + "Q" * 15,
          "deadbeef" * 3, "deadbeef" * 2 + "deadbee", "DEADBEEF" * 4, "secret" + " " * 50, "secret : : abcdef", "é", "日本語", "\n", " ", "a", "=", "\"", "token token=\"abcdef"]


def test_base_spans_on_odd_texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(PIECES, k=rng.randint(1, 8)))) for i in range(400)]
    got = find(spark, rows)
    assert {i: got[i][0] for i, _ in rows} == {i: slow_base(t) for i, t in rows}


def test_random_strings_are_found_and_others_left_alone(spark):
    rng = random.Random(2)
    kinds = [string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", string.ascii_lowercase + string.digits]
    drawn = ["".join(rng.choices(a, k=n)) for a in kinds for n in (20, 32, 64) for _ in range(60)]
    rows = [(i, f"Le mot déjà vu {s}, puis rien.") for i, s in enumerate(drawn)]
    got = find(spark, rows)
    for i, s in enumerate(drawn):
        assert set(got[i][1]) <= {f"random:15:{15 + len(s)}"}
    assert sum(bool(got[i][1]) for i in range(len(drawn))) >= 0.97 * len(drawn)
    plain = ["getElementByIdentifier2", "src/main/java/org/example", "x86_64-linux-gnu-gcc12", "ISO-8601-date-2020-01-01", "4111-1111-1111-1111-1111", str(uuid.UUID(int=rng.getrandbits(128))),
             "internationalization", "commit 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B", "SHA256:9F86D081884C7D659A2FEAA0C55AD015", "data:image/png;base64,iVBORw0KGgoAAAANSUhEUg" + drawn[0],
             "D41D8CD98F00B204E9800998ECF8427E", "mail3.example.com"]
    got = find(spark, list(enumerate(plain)))
    assert {plain[i]: v[1] for i, v in got.items() if v[1]} == {}


def test_known_digests_and_overlaps_are_left_out(spark):
    digest = hashlib.sha1(b"x").hexdigest().upper()
    assert find(spark, [(1, digest)])[1] == ([], ["random:0:40"])
    assert find(spark, [(1, digest)], known=[digest.lower()])[1] == ([], [])
    text = 'token = "Zk3vQ9xB7pLw2RtY8sUe"'
    assert find(spark, [(1, text)])[1] == ([f"assign:0:{len(text) - 1}"], [])
    with pytest.raises(ValueError):
        secrets.find(spark.createDataFrame([], "doc_id bigint, text string"), PATH, public_tokenizers.PATTERN, known=map(str, range(secrets.KNOWN + 1)))


def test_nulls_long_texts_repeats_and_odd_columns(spark):
    long = "words and " * 200_000 + "Zk3vQ9xB7pLw2RtY8sUe" * 2000
    rows = [(1, None, "x", 1), (None, "", "x", 1), (2, long, "x", 1), (2, long, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, base string, added bigint")
    found = secrets.find(frame, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.id or 0, len(r.base), [(s.start, s.end) for s in r.added]) for r in found) == [
        (0, 0, []), (1, 0, []), *[(2, 0, [(2_000_000, 2_040_000)])] * 2]
    empty = secrets.summary(secrets.find(frame.filter("false"), PATH, public_tokenizers.PATTERN))
    assert empty.collect() == [] and "spans" in empty.columns
