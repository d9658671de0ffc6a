import random

from keepwell.llm import urls

KIND = "page_id long, url string, host int, rule string"


def slow(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = max(((len(h + (p or "")), len(h), a, h + (p or "")) for h, p, a in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")), default=None)
    return host, path, best and best[3], best[2] if best else default


def test_against_every_rule(spark):
    rng = random.Random(4)
    labels = ["a", "b", "net", "org", "example", "a-b", "é"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))

    def path():
        return "".join("/" + rng.choice(["en", "e", "de", ""]) for _ in range(rng.randrange(0, 4)))

    rules = list({(host(), rng.choice([path(), None, "/"]), rng.choice(["allow", "block"])) for _ in range(120)})
    rules += [("", "/x", "block"), (None, "/", "block")]
    pages = [(i, f"http://{host().upper() if i % 5 == 0 else host()}{path()}{rng.choice(['', '?q=/en', '#x', '/'])}", 0, "r")
             for i in range(1500)]
    pages += [(9001, None, 0, ""), (9002, "", 0, ""), (9003, "no scheme/net/", 1, ""), (9004, "://", 1, ""),
              (9005, "a://b://net/", 1, ""), (9006, "http://" + "x." * 3000 + "net/" + "p" * 9000, 0, "")]
    pages += [pages[0], pages[0], (None, "http://net/", 0, "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got = urls.judge(spark.createDataFrame(pages, KIND),
                         spark.createDataFrame(rules, "host string, path string, action string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    usable = [r for r in rules if r[0]]
    order = lambda x: tuple((v is not None, str(v)) for v in x)
    assert sorted((tuple(r) for r in got), key=order) == sorted(
        ((i, *slow(u, usable)) for i, u, *_ in pages), key=order)


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert tuple(urls.judge(one, rules, "block").first()) == (1, "a", "/b", None, "block")
    assert urls.judge(one.limit(0), rules).count() == 0
