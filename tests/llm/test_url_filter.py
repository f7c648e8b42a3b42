import re

from stringloom.llm import url_filter as u

URLS = [
    None, "", "no scheme", "http://", "http://NET/", "https://a.b.net", "https://a.b.net/", "https://a.b.net?x", "https://example.net/en/x", "https://x.example.net/en/", "https://notexample.net/en/",
    "http://example.com/de/1", "http://example.com/de", "ftp://w.example.com/de/#f", "https://org/fr/", "https://a.org/fr/x?y=1", "https://a.org/de/", "x://y://z/fr/", "http://adult-x.example.com/en/", "http://m.adult-x.example.com/",
    "http://a..net/", "http://.net/", "http://" + "a." * 3000 + "net/", "http://é.org/fr/é", "http://ÀB.Org/fr/",
]


def plain(url, rules=u.RULES, listed=u.LISTED_HOSTS):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h.count("."), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[2]
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in listed) else "allow"


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(URLS * 2)], "page_id long, url string, key int")
    for r in u.filter_urls(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]), r["url"]
    assert u.filter_urls(df.limit(0)).count() == 0


def test_other_rules_and_no_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "page_id long, url string")
    rules = (("block", "b.net", ""), ("allow", "a.b.net", "/"), ("block", "org", "/fr"), ("allow", "a.org", "/fr/x"))
    for r in u.filter_urls(df, rules, ("net",)).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], rules, ("net",)), r["url"]
    assert {r["verdict"] for r in u.filter_urls(df, (), ()).collect()} == {"allow"}


def test_cascade_is_exact(spark, monkeypatch):
    keys = [f"k{i}" for i in range(20_000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = keys[::7] + ["not in the universe"]
    monkeypatch.setattr(u, "RATE", 0.5)  # many levels
    monkeypatch.setattr(u, "LEAST_BITS", 64)
    made = u.Members(universe, listed)
    got = {r["key"] for r in universe.where(made.holds(universe["key"])).collect()}
    assert got == set(keys[::7]) and len(made.levels) > 2
    monkeypatch.undo()
    assert len(u.Members(universe, listed).levels) <= 3
    table = u.Members(universe, spark.createDataFrame([(k,) for k in listed + [None, keys[0]]], "key string"))
    assert {r["key"] for r in table.mark(universe, "key", "x").where("x").collect()} == got
    monkeypatch.setattr(u, "MAX_BITS", 100)
    joined = u.Members(universe, listed)
    assert joined.levels is None and {r["key"] for r in joined.mark(universe, "key", "x").where("x").collect()} == got


def test_bits_follow_the_listed_keys(spark):
    universe = spark.range(300_000).selectExpr("concat('u', id) as key")
    made = u.Members(universe, [f"u{i * 1000}" for i in range(20)])
    assert [m for m, _, _ in made.levels] == [u.LEAST_BITS] * len(made.levels) and len(made.levels) <= 2
    made = u.Members(universe, [f"u{i * 100}" for i in range(3000)])
    assert sum(m for m, _, _ in made.levels) < 3000 * 20 + u.LEAST_BITS * len(made.levels)
    assert universe.where(made.holds(universe["key"])).count() == 3000


def test_beyond_the_bits_the_answer_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(u, "MAX_BITS", 0)
    df = spark.createDataFrame([(i, x, 1, "h") for i, x in enumerate(URLS * 2)], "page_id long, url string, key int, host string")
    got = u.filter_urls(df).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]), r["url"]


def test_query(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = u.op5_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(pages[r["page_id"]])
