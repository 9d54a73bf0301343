import time
import pytest

from factlake.llm import url_filter
from factlake.llm.queries import RULES, SQL, op6_url_filter

from .checks import same_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, sf):
    assert same_rows(op6_url_filter(spark, f"/root/testdata/{sf}"), SQL["op6_url_filter"], f"/root/testdata/{sf}")


def test_rules_and_cases(spark):
    rows = [
        (1, "http://a.b.NET/x", "a.b.net", "/x", "net/", "block"),
        (2, "https://example.net/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
        (3, "https://w.example.net/fr/1", "w.example.net", "/fr/1", "net/", "block"),
        (4, "http://notexample.com/de/", "notexample.com", "/de/", None, None),
        (5, "http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        (6, "http://some.org/fr/x", "some.org", "/fr/x", "org/fr/", "allow"),
        (7, "http://some.net", "some.net", "", None, None),
        (8, "http://some.net?x=/", "some.net", "", None, None),
        (9, None, "", "", None, None),
        (10, "no scheme/de/", "", "", None, None),
        (11, "", "", "", None, None),
        (12, "a://b://c/d", "b:", "//c/d", None, None),
        (13, "x\n://news.org/fr/\u00e9", "news.org", "/fr/\u00e9", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, ["page_id"], "url", RULES).collect()}
    for key, _, host, path, rule, verdict in rows:
        assert (got[key].host, got[key].path, got[key].rule) == (host, path, rule)
        assert got[key].verdict == verdict or verdict is None and got[key].verdict in ("allow", "block")
    assert url_filter.judge(df.filter("false"), ["page_id"], "url", RULES).count() == 0
    assert url_filter.judge(df.union(df), ["page_id"], "url", RULES).count() == 2 * len(rows)


def test_classifier(spark):
    bad = ["casino-win", "cheap-pills", "free-bets", "ads-track", "adult-x", "spam-farm"]
    urls = [(i, f"https://{'www.' * (i % 2)}{h}.example.com/en/{i}.html", True) for i, h in enumerate(bad)]
    seen = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()
    urls += [(100 + i, r.url, any(b in r.url for b in bad)) for i, r in enumerate(seen)]
    df = spark.createDataFrame(urls, "page_id long, url string, bad boolean")
    got = url_filter.judge(df, ["page_id", "bad"], "url", [])
    wrong = got.filter("(verdict = 'block') != bad").count()
    assert wrong <= 0.01 * len(urls)


def test_no_python_on_the_way(spark):
    plan = op6_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_training_bounds():
    assert url_filter.train([])[0] == 0.0
    with pytest.raises(ValueError):
        url_filter.train([("http://a/", True)] * (url_filter.MAX_LABELLED + 1))


def test_very_long_urls_take_time_in_proportion(spark):
    """Without a rule for them; a quadratic form would need minutes for one of these."""
    path = "".join(f"/{i:x}\U0001f600é" for i in range(90_000))
    df = spark.createDataFrame([(i, f"https://long.example/{path[i:]}", "x") for i in range(4)], "page_id long, url string, mark string")
    started = time.monotonic()
    rows = url_filter.judge(df, ["page_id", "mark"], "url", []).collect()
    assert time.monotonic() - started < 60
    assert [r.path for r in sorted(rows)] == ["/" + path[i:] for i in range(4)] and all(r.logit is not None for r in rows)


def test_grams_are_those_of_the_model(spark):
    bias, weights = url_filter.train()
    urls = ["https://a.b/c", "http://é\U0001f600.x/y", "x://", "https://spam-casino.example/win/now", "none"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(df, ["page_id"], "url", []).collect():
        cells = url_filter._cells(url_filter._marked(r.host, r.path))
        assert r.logit == pytest.approx(bias + 10 * weights[cells].sum() / max(1, len(cells)), abs=1e-4)
