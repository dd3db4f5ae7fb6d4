import random

from idloom.llm import url_filter as u

SCHEMA = "page_id long, url string, host string, rule int"


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), a, h + p) for h, p, a in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(urls)], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judged(pages, u.rule_table(spark, rules), ["page_id"]).collect()}
    assert got == {i: brute(x, rules) for i, x in enumerate(urls)}


def test_rules_of_the_query(spark):
    check(spark, [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.b.Example.NET/en/x?y=/z", "http://example.net/fr/", "x://notexample.com/de/", "http://example.com/de", "http://example.com/de/#a", "http://q.org/fr/", "a://b://c.net/", "http://e.net?u=/", "http://x..net/", "http://.net/", "http://net./", "http://" + "a." * 5000 + "net/" + "p" * 100000], u.RULES)


def test_nested_rules_against_brute_force(spark):
    r = random.Random(5)
    hosts = [".".join(r.choices(["a", "b", "c", "ab"], k=r.randrange(1, 5))) for _ in range(60)]
    paths = ["".join(r.choices(["/", "x", "y/", "/x/"], k=r.randrange(0, 5))) for _ in range(40)]
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in zip(r.choices(hosts, k=60), r.choices(paths, k=60), strict=True)}.values()) + [("", "/", "block"), ("a", "/x", "allow"), ("a", "/x", "block")]
    check(spark, [f"http://{r.choice(hosts)}/{r.choice(paths)}" for _ in range(600)] + ["http://a.b/x"] * 50, rules)


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert u.judged(none, u.rule_table(spark), ["page_id"]).collect() == []
    some = spark.createDataFrame([(None, "http://a.net/", "x", 1)] * 3, SCHEMA)
    assert [tuple(r) for r in u.judged(some, u.rule_table(spark).limit(0), ["page_id"]).collect()] == [(None, "a.net", "/", None, "allow")] * 3
