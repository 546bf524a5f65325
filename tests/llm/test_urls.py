import re

from labelweave.llm import urls

PAGES = "page_id long, url string, html string, node string, verdict string, rule string"
CANONICAL = '<html><head><link rel="canonical" href="{}"></head>'
REFRESH = "<META http-equiv='refresh' content='0; url={}'>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "n", "v", "r") for r in rows], PAGES)


def brute_rule(url):
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (match[1], match[2]) if match else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: len(r.text), default=None)


ROWS = [
    (1, "http://a.example.net/x", ""),
    (2, "http://A.example.NET/en/1#top", ""),
    (3, "http://example.com/de/1", None),
    (4, "http://notexample.com/de/1", CANONICAL.format("http://clean.org/1")),
    (5, "http://clean.org/1#part", ""),
    (6, "http://alias.edu/1", REFRESH.format("http://bad.net/")),
    (7, "http://alias.edu/2", CANONICAL.format("http://alias.edu/1")),
    (8, "http://good.org/fr/x", CANONICAL.format("http://alias.edu/2")),
    (9, "http://net", ""),
    (10, "http://x.net?q=/", ""),
    (11, None, CANONICAL.format("http://bad.net/")),
    (12, "no scheme/net/", CANONICAL.format("/relative")),
    (13, "", ""),
    (13, "ftp://x.net/a://b.org/fr/", ""),
    (7, "http://alias.edu/2", CANONICAL.format("http://alias.edu/1")),
    (None, "http://x.example.net/en", ""),
]


def test_rules_links_and_awkward_rows(spark):
    found = urls.judge(pages(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    by = {}
    for r in found:
        by.setdefault(r.page_id, []).append(r)
    inherited = {4: "allow", 5: "allow", 6: "block", 7: "block"}
    for page, url, _ in ROWS:
        host, path, rule = brute_rule(url)
        want = (host, path, rule and rule.text, rule.verdict if rule else inherited.get(page, "allow"))
        assert want in [(r.host, r.path, r.rule, r.verdict) for r in by[page]], (page, want, by[page])
    assert {r.alias_of for p in (6, 7, 8) for r in by[p]} == {"http://alias.edu/1"}
    assert by[8][0].verdict == "allow" and by[1][0].alias_of == "http://a.example.net/x" and by[12][0].alias_of is None


def test_given_redirects_and_long_chains(spark):
    rows = [(k, f"http://h{k}.edu/", "") for k in range(60)]
    hops = [(f"http://h{k}.edu/#a", f"http://h{k + 1}.edu/") for k in range(49)] + [("http://h49.edu/", "http://z.net/"), (None, "x://y")]
    found = urls.judge(pages(spark, rows), redirects=spark.createDataFrame(hops, "a string, b string")).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == set(range(50))


def test_no_pages_and_no_rules(spark):
    assert urls.judge(pages(spark, [])).count() == 0
    assert {r.verdict for r in urls.judge(pages(spark, ROWS), rules=()).collect()} == {"allow"}


VARIANTS = {
    "HTTP://www.A.edu:80/x/?utm_source=q&b=2&ref=z&a=1#top": "https://a.edu/x?b=2&a=1",
    "https://a.edu:443//": "https://a.edu",
    "http://a.edu:8080/X?&": "https://a.edu:8080/X",
    "http://www.a.edu?gclid=1": "https://a.edu",
    "ftp://a.edu/": None, "": None, None: None, "a.edu/x": None,
}


def test_variants_share_a_plain_address(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(u,) for u in VARIANTS], "url string")
    assert {r.url: r.plain for r in rows.select("url", urls.plain_address(F.col("url")).alias("plain")).collect()} == VARIANTS


def test_a_block_passes_on_to_variants(spark):
    """The port hides a host from the rule; its plain address does not."""
    rows = [(1, "http://bad.net:80/x", ""), (2, "https://www.bad.net/x/", ""), (3, "http://fine.edu/x?ref=1", ""), (4, "http://fine.edu/x", "")]
    found = {r.page_id: r for r in urls.judge(pages(spark, rows)).collect()}
    assert found[1].rule is None and found[1].verdict == "block" and found[2].verdict == "block"
    assert found[1].alias_of == found[2].alias_of == "http://bad.net:80/x"
    assert found[3].verdict == "allow" and found[3].alias_of == found[4].alias_of


def test_long_block_lists_are_joined(spark):
    many = tuple(urls.rule(f"h{k}.edu/p{k % 7}", "block" if k % 2 else "allow") for k in range(3000)) + urls.RULES
    rows = [(k, f"ftp://a.b.h{k}.edu/p{k % 7}/x", "") for k in range(0, 3000, 13)] + [(9001, "ftp://xh1.edu/p1", "")]
    listed = urls.rule_table(spark, many)
    for given in (many, listed):
        found = {r.page_id: r for r in urls.judge(pages(spark, rows), given).collect()}
        assert all(found[k].verdict == ("block" if k % 2 else "allow") and found[k].rule == f"h{k}.edu/p{k % 7}" for k in range(0, 3000, 13))
        assert found[9001].rule is None
