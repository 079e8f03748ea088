import random
import tempfile

from kasauti.llm import url_filters as u


def best(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.name), r.name), default=None)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for i, c in enumerate(rest):
        if c in "/?#":
            host, tail = rest[:i], rest[i:]
            break
    else:
        host, tail = rest, ""
    for c in "?#":
        tail = tail.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail


def test_against_brute_force(spark, monkeypatch):
    random.seed(5)
    hosts = ["com", "a.com", "b.a.com", "ab.com", "org", "x.org", "com.org", "a-b.com", "a.b.a.com"]
    paths = ["", "/", "/en/", "/en/7", "/e", "/en/77/x"]
    rules = [u.Rule(random.choice(["block", "allow"]), h, p) for h in hosts for p in paths if random.random() < 0.4]
    urls = [None, "", "no scheme", "http://", "http://A.com?x=/en/", "HTTP://B.A.COM/en/7#y", "ftp://a.com/en/://z", "http://a.com\n/en/", "http://a..com/", "http://.com/en/"]
    urls += [f"http://{random.choice(hosts + ['zz.net'])}{random.choice(paths)}{random.choice(['', '?q', '#f', '9'])}" for _ in range(300)]
    rows = [(i // 2, x, "h", None) for i, x in enumerate(urls + urls[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string").repartition(3)
    for block in (100_000, 4):
        monkeypatch.setattr(u, "BLOCK_RULES", block)
        out = sorted(map(repr, u.filter_urls(df, rules).collect()))
        truth = []
        for i, url, _, _ in rows:
            host, path = split(url)
            r = best(rules, host, path) if host else None
            truth.append((i, host, path, r.name if r else None, r.verdict if r else "allow"))
        assert out == sorted(f"Row(page_id={i}, host={h!r}, path={p!r}, rule={n!r}, verdict={v!r})" for i, h, p, n, v in truth)


def test_empty_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert u.filter_urls(df.limit(0), [u.rule("block", "com/")]).collect() == []
    assert u.filter_urls(df, [], default="block").first()["verdict"] == "block"


def test_rule_parsing():
    assert u.rule("block", "com/en/") == u.Rule("block", "com", "/en/") and u.rule("allow", "net").path == ""


def test_rules_that_contradict_or_tie(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.a.a/xxxx")], "page_id long, url string")
    rules = [u.Rule("allow", "a", "/x"), u.Rule("block", "a", "/x"), u.Rule("allow", "a", "/x")]
    tie = [u.Rule("allow", "a.a.a", "/x"), u.Rule("block", "a.a", "/xxx"), u.Rule("allow", "a", "/")]
    for block in (100_000, 1):
        monkeypatch.setattr(u, "BLOCK_RULES", block)
        assert [(r["rule"], r["verdict"]) for r in u.filter_urls(df, rules).collect()] == [("a/x", "block")]
        assert [(r["rule"], r["verdict"]) for r in u.filter_urls(df, tie).collect()] == [("a.a.a/x", "allow")]


def test_rules_of_the_contract(spark):
    """net/de/ is allowed, but for example.net/de/8."""
    from kasauti.llm.queries import op10_url_filters

    contract = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    rules = [u.Rule(*r) for r in contract]
    hosts = [h + e for e in ("com", "net", "org") for h in ("", "example.", "m.EXAMPLE.", "badexample.", "example-")] + ["netx", "net.com", ""]
    urls = [None, "", "example.net/de/8"] + [f"http://{h}{p}" for h in hosts for p in ("", "/de/", "/de/8", "/de/8/x?q", "/de/7#f", "/de?/8", "/en/", "/en/7", "/en/77", "/En/7", "/es/", "//de/8")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3).write.mode("overwrite").parquet(f"{(folder := tempfile.mkdtemp())}/pages.parquet")
    found = {r["page_id"]: tuple(r)[1:] for r in op10_url_filters(spark, folder).collect()}
    for i, url in enumerate(urls):
        host, path = split(url)
        r = best(rules, host, path) if host else None
        assert found[i] == (host, path, r.name if r else None, r.verdict if r else "allow"), url
    told = {url: found[i][2:] for i, url in enumerate(urls)}
    assert told["http://net/de/"] == told["http://badexample.net/de/8"] == ("net/de/", "allow") and told["http://m.EXAMPLE.net/de/8/x?q"] == ("example.net/de/8", "block")
