import hashlib
import re

import pytest

from factlake.llm import warc_derive as wd
from factlake.llm.queries import SQL, op3_warc_derive

from .checks import same_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, sf):
    assert same_rows(op3_warc_derive(spark, f"/root/testdata/{sf}"), SQL["op3_warc_derive"], f"/root/testdata/{sf}")


def test_cases(spark):
    page = ('<html LANG="en-GB"><head><META charset=utf-8><title> A &amp;\n B</title><script>if (a<b) {"</p>"}</script></head><body>'
            "<!-- no\n --><p>One&nbsp;&amp;lt; two<br/>three <b>bold</b>er</p>\n\n<ul><li>x<li>y</ul><a href='/u'>link</a> 1 < 2<style>p{}")
    rows = [(1, "http://a/", page), (1, "http://a/", page), (2, None, None), (3, "http://b/", ""), (None, "http://c/", "<script>never closed")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, block_digest int")
    sources = wd.responses(df, "page_id", "url", "html")
    by_id = {r.record_id: r for r in sources.collect()}
    made = wd.derive(sources).collect()
    assert len(made) == 2 * len(rows)
    for r in made:
        source = by_id[r.refers_to]
        assert r.source_key == source.source_key and r.source_payload_digest == source.payload_digest
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
        fields = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:-1])
        assert fields["WARC-Refers-To"] == source.record_id and fields["WARC-Type"] == r.warc_type
        assert ("WARC-Target-URI" in fields) == bool(source.target_uri)
        if r.warc_type == "metadata":
            assert source.payload_digest in r.block and source.block_digest in r.block and "HTTP/1.1 200 OK" in r.block
    texts = {r.source_key: r.block for r in made if r.warc_type == "conversion"}
    assert texts[1] == "A &\nB\nOne &lt; two\nthree bolder\nx\ny\nlink 1 < 2"
    assert texts[2] == texts[3] == texts[None] == ""
    facts = next(r.block for r in made if r.warc_type == "metadata" and r.source_key == 1)
    assert re.match(r"title: A &amp; B\r\nlanguage: en-GB\r\ncharset: utf-8\r\noutlinks: 1\r\n", facts)
    assert wd.derive(sources.filter("false")).count() == 0
    text = "".join(r.value for r in wd.as_warc(wd.derive(sources)).collect())
    assert text.count("WARC/1.1\r\n") == 2 * len(rows)
