"""URL filters: against brute force, with an empty list, hot keys and clashing columns."""

import random

from skarn.llm import urlfilter


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "?#":
            rest = rest.split(mark)[0]
        at = rest.find("/")
        host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    rng = random.Random(8)
    hosts = ["com", "Example.com", "a.b.example.com", "net", "x.NET", "org", "", ".", "a..com", "ünï.org", "example.com:80"]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/de/8", "/es/", "/é/ü", "/en/7?q=/de/", "#/en/", "/\n/en"]
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "://", "a://b://c/d"] + [None] * 50
    rules = [*urlfilter.RULES, ("com", "", "block"), ("b.example.com", "/en/", "allow"), ("org", "/é", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    for blocks in (None, 1):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, listed, blocks=blocks).collect()}
        assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_empty_list_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://com/en/", 5, 6.0, "r", "v", "e")], "page_id long, url string, host int, path double, rule string, verdict string, extra string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    out = urlfilter.filter_urls(pages, none)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in out.collect()] == [(1, "http://com/en/", "e", "com", "/en/", None, "allow")]
    twice = spark.createDataFrame([("com", "/en/", "block"), ("com", "/en/", "allow"), (None, None, "block")], "host string, path string, verdict string")
    assert urlfilter.filter_urls(pages, twice).first()["verdict"] == "allow"
