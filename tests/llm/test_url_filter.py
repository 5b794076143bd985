from slantscope.llm import url_filter as uf


def pages_frame(spark, tmp_path, rows, name="pages"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string, u string").write.parquet(path)
    return spark.read.parquet(path)


def verdicts(df):
    return {r["page_id"]: (r["rule"], r["verdict"], r["decided_by"]) for r in df.collect()}


def page(i, url, html=None):
    return (i, url, html, "x", "y", "z")


def canonical(href):
    return f"<html><head><LINK href='{href}' rel=canonical></head>"


def test_parts_rules_and_odd_urls(spark, tmp_path):
    rows = [page(1, "https://A.Example.NET/en/1?x#y"), page(2, "http://a.net"), page(3, "http://a.net/"), page(4, None), page(5, "no scheme.net/"),
            page(6, "://x.org/fr/a"), page(7, "HTTP://ÄB.org?q=/fr/"), page(8, "https://example.com/de"), page(9, "https://m.example.com/de/1"),
            page(10, ""), page(11, "http://evilexample.net/en/"), page(None, "http://b.net/k"), page(3, "http://a.net/")]
    got = uf.judge(pages_frame(spark, tmp_path, rows)).collect()
    by = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert by[(1, "a.example.net", "/en/1")] == ("example.net/en/", "allow")
    assert by[(2, "a.net", "")] == (None, "block")  # an alias of http://a.net/ by spelling
    assert by[(3, "a.net", "/")] == ("net/", "block")
    assert by[(4, "", "")] == (None, "allow") == by[(5, "", "")] == by[(10, "", "")]
    assert by[(6, "x.org", "/fr/a")] == ("org/fr/", "allow")
    assert by[(7, "Äb.org", "")] == (None, "allow")
    assert by[(8, "example.com", "/de")] == (None, "allow")
    assert by[(9, "m.example.com", "/de/1")] == ("example.com/de/", "block")
    assert by[(11, "evilexample.net", "/en/")] == ("net/", "block")
    assert by[(None, "b.net", "/k")] == ("net/", "block")


def test_blocks_reach_aliases_and_allow_goes_first(spark, tmp_path):
    rows = [page(1, "https://good.com/a", canonical("http://bad.net/b")),  # alias of a blocked page
            page(2, "https://far.com/c", '<meta http-equiv="refresh" content="0; URL=https://good.com/a">'),  # and two steps away
            page(3, "https://www.good.com/a/?utm_source=x#top"),  # a spelling of 1
            page(4, "https://m.org/fr/1", canonical("https://bad.net/b")),  # its own allow rule decides
            page(5, "https://mixed.com/1", canonical("https://q.org/fr/1")), page(6, "https://mixed.com/2", canonical("https://q.org/fr/1")),
            page(7, "https://one.com/x/y", canonical("../up")), page(8, "https://one.com/x/z", canonical("/root")), page(9, "https://one.com/root"),
            page(10, "https://lone.com/")]
    got = verdicts(uf.judge(pages_frame(spark, tmp_path, rows)))
    # 1, 2, 3 share a component with 4's explicit allow, which goes before the block of bad.net
    assert got[1] == (None, "allow", "allowed alias") and got[4] == ("org/fr/", "allow", "rule")
    assert got[5] == (None, "allow", "allowed alias") and got[10] == (None, "allow", "none")
    rows = [r for r in rows if r[0] != 4]
    got = verdicts(uf.judge(pages_frame(spark, tmp_path, rows, "again")))
    assert got[1] == got[2] == got[3] == (None, "block", "alias")
    assert got[8] == (None, "allow", "none") == got[9]


def test_redirect_table_rule_frame_and_nothing(spark, tmp_path):
    pages = pages_frame(spark, tmp_path, [page(1, "https://a.com/1"), page(2, "https://b.com/2")])
    hops = spark.createDataFrame([("https://a.com/1", "https://t.co/x"), ("https://t.co/x", "https://b.com/2"), (None, "https://a.com/1")], "src string, dst string")
    rules = spark.createDataFrame([("T.co", "/", "block"), ("t.co", "/", "block"), ("b.com", "/zzz", "allow"), ("a.com", "/1", "maybe")],
                                  "rule_host string, rule_path string, rule_verdict string")
    got = verdicts(uf.judge(pages, rules, redirects=hops))
    assert got == {1: (None, "block", "alias"), 2: (None, "block", "alias")}
    assert uf.judge(pages.limit(0)).count() == 0


def test_targets_are_decoded_and_resolved(spark, tmp_path):
    rows = [page(1, "https://hub.com/s?p=1&q=2", canonical("http://bad.net/b")),  # blocked; the others reach it by its exact address
            page(2, "https://other.com/1", canonical("https://hub.com/s?p=1&amp;q=2")),
            page(3, "https://hub.com/x/y/z", canonical("../../s?p=1&#38;q=2")),
            page(4, "https://hub.com/s?p=9", canonical("?p=1&#x26;q=2")),
            page(5, "https://other.com/2", canonical("https://hub.com/a/./b/../../s?p=1&q=2")),
            page(6, "https://other.com/3", '<meta http-equiv=refresh content="0; url=https://hub.com/s?p=1&amp;q=2">'),
            page(7, "https://other.com/4", canonical("https://hub.com/s?p=1&amp;q=3")),
            page(8, "https://hub.com/t?p=7", canonical("?next=https://bad.net/b"))]
    got = verdicts(uf.judge(pages_frame(spark, tmp_path, rows)))
    assert all(got[i] == (None, "block", "alias") for i in range(1, 7))
    assert got[7] == got[8] == (None, "allow", "none")
    texts = {"a&eacute;b": "a\xe9b", "x&copy=2&lt=3": "x&copy=2&lt=3", "x&amp": "x&", "&#233;&#xe9;&#x1F600;": "\xe9\xe9\U0001f600",
             "&nothing;&#xD800;&#99999999;&": "&nothing;&#xD800;&#99999999;&", "a&b;c&&amp;amp;": "a&b;c&&amp;", "": ""}
    df = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", uf.decoded(uf.F.col("t"))).collect())
    paths = {"../../../u": "https://a.com/u", "./v/..": "https://a.com/p/q/", "w/.": "https://a.com/p/q/w/", "#f": "https://a.com/p/q/r?k=1#f",
             "//b.com/./c?../d": "https://b.com/c?../d", "..": "https://a.com/p/", "s..t/.u": "https://a.com/p/q/s..t/.u"}
    df = spark.createDataFrame(list(paths.items()), "t string, want string")
    got = {r["t"]: r["got"] for r in df.withColumn("got", uf.resolved(uf.F.lit("https://a.com/p/q/r?k=1#z"), uf.F.col("t"))).collect()}
    assert got == paths
