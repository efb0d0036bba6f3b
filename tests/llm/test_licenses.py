import pytest

from boxlens.llm import licenses as L

SCHEMA = "doc_id bigint, text string, license string, digest string"
MIT = next(t for k, t in L.KNOWN if k == "MIT" and len(t) > 500)
ISC = next(t for k, t in L.KNOWN if k == "ISC")


def scanned(spark, rows, **more):
    return L.scan(spark.createDataFrame([(i, t, "l", "d") for i, t in rows], SCHEMA), **more).collect()


@pytest.mark.parametrize("text, name", [
    (MIT, "MIT"), (MIT.upper(), "MIT"), ("Copyright (c) 2020 Someone & Sons\n\n" + MIT, "MIT"), ("\u00a9 2020 X\n" + MIT.replace(" ", "\n  "), "MIT"),
    (MIT.replace('"', "\u201c").replace("sublicense", "sub-licence"), "MIT"), (MIT.replace("HOLDERS BE", "HOLDERS  (BE)"), "MIT"), (ISC.replace(", ", " ,"), "ISC"),
    ("licenced under CC-BY-NC 4.0", "CC-BY-NC-4.0"), ("This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International Licence!", "CC-BY-NC-4.0"),
    (MIT + " more", None), (MIT[1:], None), ("The above copyright notice", None), ("", None), (None, None), ("...", None), ("Copyright (c) 2020 me", None)])
def test_whole_texts(spark, text, name):
    row = scanned(spark, [(1, text)])[0]
    assert row.license == name


def test_lines(spark):
    notes = [t for _, t in L.KNOWN if len(t) < 200]
    rows = [(1, "Words first.\n" + "\n".join(notes[:3]) + "\nand last"), (2, "a line\n" + notes[0].upper() + " \n" + notes[0]), (3, "x" * 200_000 + "\n" + notes[4]),
            (4, notes[0] + " and on"), (None, "q\n" + notes[4]), (2, "a line\n" + notes[0].upper() + " \n" + notes[0]), (5, "\n".join(notes[:1] * 3000))]
    got = sorted(((r.id, r.license, r.n_notices, r.notices) for r in scanned(spark, rows)), key=str)
    names = dict((t, k) for k, t in L.KNOWN)
    want = [(1, None, 3, ",".join(sorted({names[t] for t in notes[:3]}))), (2, None, 2, "MIT"), (3, None, 1, names[notes[4]]), (4, None, 0, ""),
            (None, None, 1, names[notes[4]]), (2, None, 2, "MIT"), (5, None, 3000, "MIT")]
    assert got == sorted(want, key=str)


def test_own_list_and_empty_tables(spark):
    row = scanned(spark, [(1, "MY behavior: Text")], known=(("b", "my behaviour text"), ("a", "my behavior, text"), ("none", "--")))[0]
    assert (row.license, row.n_notices) == ("a", 1)
    assert scanned(spark, []) == []
    assert scanned(spark, [(1, "x")], known=(("none", "--"),))[0].license is None
