import datetime as dt
import random
import re

from boxlens.llm import urls as U

DAY = dt.date(2024, 1, 1)
CAPTURES = "page_id bigint, url string, day date, host string, pattern string"
ENTRIES = "list string, pattern string, active boolean, day date, seq bigint, url string"


def slow_host(url):
    rest = url.lower()
    if (m := re.match(r"([a-z][a-z0-9+.-]*:)?//", rest)):
        rest = rest[m.end():]
    rest = re.split(r"[/?#]", rest)[0].rpartition("@")[2] if "@" in re.split(r"[/?#]", rest)[0] else re.split(r"[/?#]", rest)[0]
    host = rest[: rest.index("]") + 1] if rest.startswith("[") and "]" in rest else rest.split(":")[0]
    return re.sub(r"^www\.", "", re.sub(r"\.$", "", host))


def slow_path(url):
    path = re.split(r"[?#]", re.sub(r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?[^/?#]*", "", url))[0]
    if not path:
        return "/"
    out = []
    for step in path.split("/")[1:]:
        if step == "..":
            del out[-1:]
        elif step != ".":
            out.append(step)
    if path.split("/")[-1] in (".", ".."):
        out.append("")
    return "/" + "/".join(out)


def slow_match(pattern, url):
    """A host pattern covers subdomains, one with a slash a path prefix."""
    host, path = slow_host(url), slow_path(url)
    if "/" in pattern:
        return bool(host) and (host + path).startswith(pattern) and pattern.endswith("/") and pattern.split("/")[0] == host and pattern != host + "/"
    return host == pattern or (host.endswith("." + pattern) and not re.fullmatch(r"[0-9.]+", host))


def slow(captures, entries):
    out = []
    for page, url, day in captures:
        state = {}
        for name, pattern, active, since, seq in sorted((e for e in entries if None not in e), key=lambda e: (e[3], e[4], e[2])):
            if day is not None and since <= day:
                state[name, pattern] = active
        hits = [k for k, on in state.items() if on and url is not None and slow_match(k[1], url)]
        out.append((page, len(hits), ",".join(sorted({a for a, _ in hits})), ",".join(sorted({b for _, b in hits}))))
    return sorted(out, key=str)


def tables():
    rng = random.Random(6)
    hosts = ["a.com", "www.a.com", "x.a.com", "b.org", "y.x.a.com", "evil-a.com", "c.net", "10.0.0.1", "[::1]"]
    urls = [rng.choice(["http://", "https://u:p@", "", "HTTPS://", "//"]) + rng.choice(hosts) + rng.choice(["", ":80", "."]) + rng.choice(["", "/", "/p", "/p/", "/p/q/r?x=/z/", "/P/q#/s/", "/z/../p/q/.", "/../p/./", "/p/q/..", "/p/.hidden/x"]) for _ in range(150)]
    captures = [(i, u, DAY + dt.timedelta(rng.randrange(200))) for i, u in enumerate(urls)] + [(900, None, DAY), (901, "http://a.com/", None), (None, "a.com", DAY + dt.timedelta(150)), (902, "", DAY), (903, "///", DAY)]
    captures += captures[:2]
    patterns = ["a.com", "x.a.com", "com", "b.org", "b.org/p/", "a.com/p/q/", "a.com/p/", "c.net", "10.0.0.1", "0.1", "1", "[::1]", "[::1]/p/"]
    entries = [(f"l{rng.randrange(3)}", rng.choice(patterns), rng.random() < 0.7, DAY + dt.timedelta(rng.randrange(-40, 210)), rng.randrange(5)) for _ in range(160)]
    return captures, entries + [(None, "a.com", True, DAY, 1), ("l0", None, True, DAY, 1), ("l0", "a.com", True, None, 1)]


def frames(spark, captures, entries):
    return spark.createDataFrame([(*c, "h", "p") for c in captures], CAPTURES), spark.createDataFrame([(*e, "u") for e in entries], ENTRIES)


def test_matches_brute_force(spark):
    captures, entries = tables()
    pages, listed = frames(spark, captures, entries)
    got = U.evaluate(pages, U.intervals(listed)).collect()
    assert sorted(((r.id, r.n_matches, r.lists, r.patterns) for r in got), key=str) == slow(captures, entries)
    assert all(r.blocked == (r.n_matches > 0) for r in got) and sum(r.blocked for r in got) > 30


def test_intervals(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [("l", "p", True, day(1), 1), ("l", "p", True, day(3), 2), ("l", "p", False, day(5), 3), ("l", "p", True, day(5), 4), ("l", "p", False, day(9), 5), ("l", "q", False, day(1), 1)]
    spans = U.intervals(frames(spark, [], rows)[1]).collect()
    assert sorted((r.since, r.until) for r in spans) == [(day(1), day(3)), (day(3), day(5)), (day(5), day(9))]


def test_empty_tables(spark):
    captures, entries = tables()
    pages, listed = frames(spark, captures, entries)
    nothing = frames(spark, [], [])
    assert U.evaluate(nothing[0], U.intervals(listed)).count() == 0
    assert {r.blocked for r in U.evaluate(pages, U.intervals(nothing[1])).collect()} == {False}
