import re

from feedloom.llm import url_filter as uf

PAGES = "page_id long, url string, html string, host int, lower string"
OUT = "page_id long, bad int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("(?s)[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("(?s)[^?#]*", rest[len(host) :])[0]


def judged(spark, urls, outcomes, **more):
    pages = spark.createDataFrame([(i, u, None, 1, "x") for i, u in urls], PAGES)
    return {r["page_id"]: r for r in uf.judge(pages, spark.createDataFrame(outcomes, OUT), **more).collect()}


def test_host_path_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://example.com/de", "x://y.net/fr/1",
            "x://net/es/", "x://anet/es/", "http://É.com?q", "http://h\nx.net/es/a\nb#c", "a://b://c/d", "http://com/", "http://x.com", "http://xexample.com/en/"]
    want = {4: "www.example.com/en/", 5: "example.com/en/", 6: "com/", 7: "net/fr/", 8: "net/es/", 11: "net/es/", 13: "com/", 15: "com/"}
    got = judged(spark, list(enumerate(urls)), [])
    said = {f"{h}{p}": v for v, h, p in uf.RULES}
    for i, url in enumerate(urls):
        assert (got[i]["host"], got[i]["path"]) == split(url), url
        assert got[i]["rule"] == want.get(i), url
        assert got[i]["verdict"] == said.get(want.get(i), "allow")


def test_reputation_shrinks_and_blocks(spark):
    urls, outcomes, i = [], [], 0
    for host, n, bad in [("good.org", 300, 15), ("bad.spam.org", 60, 54), ("new.spam.org", 1, 1), ("one.fine.org", 1, 1), ("x.fine.org", 200, 8), ("also.spam.org", 80, 70)] + [(f"h{k}.site{k}.org", 20, 1) for k in range(30)]:
        for k in range(n):
            urls.append((i, f"http://{host}/{k}"))
            outcomes.append((i, int(k < bad)))
            i += 1
    urls += [(i, "http://never.seen.org/"), (i + 1, None)]
    outcomes += [(None, 1), (3, None), (i + 1, 1)]
    got = judged(spark, urls, outcomes)
    verdict = {r["host"]: r["verdict"] for r in got.values()}
    assert verdict["bad.spam.org"] == verdict["also.spam.org"] == "block"
    assert verdict["good.org"] == verdict["one.fine.org"] == verdict["never.seen.org"] == verdict[""] == "allow"
    lower = {r["host"]: r["lower"] for r in got.values()}
    assert lower["new.spam.org"] > lower["one.fine.org"]
    pages = spark.createDataFrame([(k, u, None, 1, "x") for k, u in urls + urls[:2]], PAGES)
    kept = uf.filter_pages(pages, spark.createDataFrame(outcomes, OUT))
    assert kept.columns == pages.columns and kept.count() == sum(r["verdict"] == "allow" for r in got.values()) + 2


def test_empty(spark):
    assert judged(spark, [], []) == {}
