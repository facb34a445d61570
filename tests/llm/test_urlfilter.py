import numpy as np

from loomwork.llm import urlfilter as uf
from loomwork.llm.queries import URL_RULES


def test_rules_list_and_odd_urls(spark):
    urls = [
        ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        ("http://sub.example.net/en/1?q", "sub.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("http://net", "net", "", None, "allow"),
        ("http://x.org/fr/#a://b", "x.org", "/fr/", "org/fr/", "allow"),
        ("https://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
        ("http://www.bad.com/deep/page", "www.bad.com", "/deep/page", None, "block"),
        ("http://ok.com/one/?x", "ok.com", "/one/", None, "block"),
        ("http://ok.com/two", "ok.com", "/two", None, "allow"),
        ("http:/nothing", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(urls)] + [(0, urls[0][0], "x", "y")], "page_id long, url string, rule string, verdict string")
    listed = spark.createDataFrame([("bad.com",), ("ok.com/one",), (None,), ("",), ("bad.com",)], "url string")
    out = uf.judge(pages, URL_RULES, listed)
    assert out.columns == ["page_id", "url", *uf.ADDED]
    rows = out.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == urls[r.page_id]
    assert uf.judge(pages.limit(0), URL_RULES, listed).count() == 0
    assert uf.judge(pages, URL_RULES, listed.limit(0)).where("listed").count() == 0


def test_filter_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(3000).selectExpr("concat('host', id, '.com') as k")
    table = uf.build_filter(keys, "k")
    passes = uf._passes(spark, table)
    probe = spark.range(20_000).selectExpr("concat('host', id, '.com') as k", "id").selectExpr("xxhash64(k) as h", "id").withColumn("p", passes("h"))
    assert probe.where("id < 3000 and not p").count() == 0
    assert probe.where("id >= 3000 and p").count() < 340
    tight = uf.build_filter(keys, "k", max_bytes=64)
    assert tight.shape == (1, 8) and tight.dtype == np.uint64


def test_false_positives_are_removed(spark):
    """One block holds all bits, so the filter passes nearly everything; the join decides."""
    listed = spark.range(300).selectExpr("concat('l', id, '.com') as url")
    pages = spark.range(600).selectExpr("id as page_id", "concat('http://l', id, '.com/') as url")
    out = uf.judge(pages, (), listed, max_bytes=64)
    assert out.where("listed").count() == 300 and out.where("listed and page_id >= 300").count() == 0


def test_beyond_the_broadcast_bound(spark):
    """Hot keys, listed and not, cold keys, whole hosts, and keys that the filter lets through by mistake."""
    listed = spark.range(3000).selectExpr("case when id % 2 = 0 then concat('h', id, '.com') else concat('h', id, '.com/p') end as url")
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('http://h', case when id % 3 = 0 then 2 when id % 3 = 1 and id % 7 = 0 then 9001 else id % 4000 end, '.com/p') as url")
    small, large = (uf.judge(pages, (), listed, max_bytes=m, broadcast_bytes=b) for m, b in ((32 << 20, 32 << 20), (4096, 0)))
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0 and large.count() == 20_000
    assert small.where("listed").count() == pages.selectExpr("cast(regexp_extract(url, 'h([0-9]+)', 1) as int) as h").where("h < 3000").count()


def test_only_keys_that_pass_are_shuffled(spark):
    listed = spark.range(50).selectExpr("concat('l', id, '.com/a') as url")
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://l', id, '.com/a') as url", "repeat('x', 1000) as html")
    plan = uf.judge(pages, (), listed)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


def test_clashing_names_keep_their_values(spark):
    names = ["_key", "_salt", "_row", "_k0", "_canonical_key", "_host_key", "_ruled", "key", "n", "_pass0", "_in"]
    pages = spark.createDataFrame([(1, "http://l1.com/a", *range(len(names)))], "page_id long, url string, " + ", ".join(f"`{n}` int" for n in names))
    r = uf.judge(pages, (), spark.createDataFrame([("l1.com/a",)], "url string"))
    assert r.columns == [*pages.columns, *uf.ADDED] and tuple(r.select(*names).first()) == tuple(range(len(names))) and r.first().verdict == "block"
