"""The automaton against regular expressions, and the rules against a plain reading."""

import random
import re

import pyarrow as pa

from lifeframe.llm import spans, urls


def plain_match(glob, text):
    parts = [".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob)]
    return re.fullmatch("".join(parts), text, re.S) is not None


def test_automaton():
    rng = random.Random(8)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", ".", "é"]) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/.éx\n") for _ in range(rng.randrange(0, 20))) for _ in range(600)] + ["a/" * 3000, "", "b" * 200]
    ascii_globs = [g for g in globs if not ("?" in g and "é" in "".join(texts))] + ["*?b" * 3, "**" + "ab" * 50 + "**", "", "*"]
    automaton = urls.Automaton(ascii_globs)
    assert automaton.words > 3
    for first, _, data, offsets in spans.slices(pa.array(texts)):
        hits = automaton.run(data, offsets)
        for i, row in enumerate(hits):
            text = texts[first + i]
            if "é" in text and any("?" in g for g in ascii_globs):
                continue  # a question mark stands for one byte
            assert [bool(x) for x in row] == [plain_match(g, text) for g in ascii_globs], text


RULES = [
    urls.HostRule("allow", "com", "/"), urls.HostRule("block", "example.com", "/en/"), urls.HostRule("allow", "www.example.com", "/en/"),
    urls.HostRule("block", "net", "/es/"),
]


def plain_judge(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    glob = any(plain_match(g, f".{host}{path}") for g in urls.DEFAULT_GLOBS)
    return host, path, best and best.host + best.path, best.verdict if best else "block" if glob else "allow"


def test_rules(spark):
    given = [
        "http://Example.COM/en/a?x#y", "https://www.example.com/en/", "http://a.b.example.com/fr/1", "http://notexample.com/en/", "http://com/",
        "http://com", "http://evil.org/x.example.com/en/", "ftp://x.net/es/1", "http://net/es/", "net/es/", "", None, "://", "a://b://c/d", "http://x.org/a#b?c",
        "http://spam-farm.example.org/en/1", "http://a.spam.org", "http://spam.org/", "http://x.org/spam/", "http://x.org/f.exe", "http://x.org/f.exe?x",
        "http://é.example.com/en/", "http://x.org/" + "a" * 50_000, "http://x.org/\nlogin/\n", "http://user@com:80/", "HTTP://X.CoM/É",
    ]
    rows = [(i, u, "mine") for i, u in enumerate(given)] + [(None, "http://com/", "mine"), (0, given[0], "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = urls.judge(pages, RULES).collect()
    assert sorted(str(tuple(r[:5])) for r in got) == sorted(str((i, *plain_judge(u))) for i, u, _ in rows)
    assert urls.judge(pages.filter("false"), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, [], []).collect()} == {"allow"}
