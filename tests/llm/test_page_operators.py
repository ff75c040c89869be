"""Archives and URL filters."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import url_filters, warc
from gaugeflow.llm.runtime import prepare

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def test_archive_round_trip(spark, tmp_path):
    long = "é" * 60
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "http://c", None), (4, "http://d", "short"), (5, "http://e", "short"), (None, "http://f", long), (7, "http://g", "z" * 300_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "w")
    out = {r.page_id: r for r in warc.round_trip(pages, path).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1), 7: ("response", None),
    }
    assert out[1].target_uri == "http://a/%0D%0AX: y"
    back = warc.read_archive(spark, path)
    payloads = {r.record_id: r.payload for r in back.where("record_type = 'response'").collect()}
    assert bytes(payloads["urn:page:1"]).decode() == long and len(payloads) == 5
    assert back.where("record_type IN ('revisit') AND refers_to = 'urn:page:1'").count() == 2
    assert [r.payload for r in warc.read_archive(spark, path, payload="skip").where("record_id = 'urn:page:7'").collect()] == [None]


def test_predicates_are_pushed_down():
    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 3), warc.IsNotNull(("target_uri",))]))
    assert len(left) == 1
    assert reader.wanted({"record_type": "response", "target_uri": "u"}) and not reader.wanted({"record_type": "response", "target_uri": None})


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    record = {"record_type": "response", "record_id": "r", "target_uri": "u", "payload_digest": None, "payload_bytes": 10**6, "refers_to": None, "payload": b"ab" * 500_000}
    data = warc.encode(record) * 3
    taken = []
    more = warc._Member._more
    monkeypatch.setattr(warc._Member, "_more", lambda self, n: taken.append(n) or more(self, n))
    assert list(warc.records(io.BytesIO(data), len(data), True, lambda row: False, True, False)) == []
    assert sum(taken) <= 3 * 2048
    assert gzip.decompress(data[: len(data) // 3]).startswith(b"WARC/1.1\r\n")


class Counting(io.BytesIO):
    """Counts the bytes read and the places sought."""

    fetched = 0

    def read(self, n=-1):
        out = super().read(n)
        self.fetched += len(out)
        return out


def test_bytes_are_fetched_once_and_skips_not_at_all():
    import random

    noise = random.Random(3).randbytes
    record = lambda payload: {"record_type": "response", "record_id": "r", "target_uri": "u", "payload_digest": None, "payload_bytes": len(payload), "refers_to": None, "payload": payload}
    small = b"".join(warc.encode(record(noise(500))) for _ in range(3000))
    file = Counting(small)
    assert len(list(warc.records(file, len(small), True, lambda row: True, True, False))) == 3000
    assert file.fetched <= len(small) + warc._WINDOW
    large = b"".join(warc.encode(record(noise(8 << 20))) for _ in range(4))
    file = Counting(large)
    assert len(list(warc.records(file, len(large), True, lambda row: True, False, False))) == 4
    assert file.fetched <= 5 * warc._WINDOW < len(large) / 4


def test_paths_are_completed_by_the_default_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "file:///")
        assert warc.qualified(spark, "/a/b") == "file:/a/b"
        assert warc.qualified(spark, "file:/a/b") == "file:/a/b"
        conf.set("fs.defaultFS", "viewfs:///")
        with pytest.raises(Exception, match="viewfs"):
            warc.write_archive(spark.createDataFrame([(1, "u", "x")], PAGES), str(tmp_path / "not-here"))
        assert not (tmp_path / "not-here").exists()
    finally:
        conf.set("fs.defaultFS", before)
    assert warc.store("file:///a/b")[1] == "/a/b"


def test_repeated_rows_and_long_headers(spark, tmp_path):
    rows = [(1, "http://a/" + "x" * 100_000, "p" * 200), (1, "http://b", "p" * 200), (1, "http://b", "p" * 200), (2, None, "p" * 200)]
    out = sorted((r.page_id, r.record_type, r.refers_to, len(r.target_uri or "")) for r in warc.round_trip(spark.createDataFrame(rows, PAGES), str(tmp_path / "r")).collect())
    assert out == [(1, "response", None, 8), (1, "response", None, 8), (1, "response", None, 100_009), (2, "revisit", 1, 0)]


def test_plain_and_foreign_archives():
    raw = gzip.decompress(warc.encode({"record_type": "response", "record_id": "r", "target_uri": "u", "payload_digest": hashlib.sha256(b"hey").hexdigest(), "payload_bytes": 3, "refers_to": None, "payload": b"hey"}))
    for data, packed in ((raw * 2, False), (gzip.compress(raw) * 2, True)):
        for wanted, n in ((lambda row: True, 2), (lambda row: False, 0)):
            rows = list(warc.records(io.BytesIO(data), len(data), packed, wanted, True, True))
            assert [r["payload"] for r in rows] == [b"hey"] * n
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(gzip.compress(raw)[:60]), 60, True, lambda row: True, True, False))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(raw.replace(b"hey", b"hoy")), len(raw), False, lambda row: True, True, True))


def test_empty_archive(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES), str(tmp_path / "e")).count() == 0


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "bad.com", ""), ("allow", "bad.com", ""), ("block", "evil.org", "/x")]


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules, redirects=redirects).collect()}


def test_rules(spark):
    out = judged(
        spark,
        [(1, "http://WWW.Example.NET/en/a?b", ""), (2, "http://x.net/en", None), (3, "http://x.net", ""), (4, None, ""), (5, "no scheme", ""), (6, "ftp://a.bad.com?q://r", ""), (7, "http://evil.org/xy#f", ""), (8, "http://notevil.org/x", ""), (9, "http://internet/", "")],
    )
    assert out == {
        1: ("www.example.net", "/en/a", "example.net/en/", "allow"), 2: ("x.net", "/en", "net/", "block"), 3: ("x.net", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("a.bad.com", "", "bad.com", "allow"), 7: ("evil.org", "/xy", "evil.org/x", "block"), 8: ("notevil.org", "/x", None, "allow"), 9: ("internet", "/", None, "allow"),
    }
    assert judged(spark, []) == {}


def test_hosts_of_very_many_labels(spark):
    rows = [(1, "http://" + "a." * 20_000 + "example.net/en/x", ""), (2, "http://" + "a." * 20_000 + "net/", None), (3, "http://" + "." * 5000, ""), (4, "http://net", ""), (5, "http://x.net/", "")]
    assert {i: (r[2], r[3]) for i, r in judged(spark, rows).items()} == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("net/", "block")}
    none = spark.createDataFrame([], "action string, host string, path string")
    pages = spark.createDataFrame(rows, PAGES)
    assert {r.verdict for r in url_filters.judge(pages, none).collect()} == {"allow"}


def test_aliases_inherit(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.io/1", link.format("https://evil.org/x1")), (2, "http://b.io/2", '<META http-equiv=refresh content="0; url=//a.io/1#top">'), (3, "http://c.io/3", link.format("/other")),
        (4, "http://c.io/other", ""), (5, "http://d.io/", link.format("http://example.net/en/5")), (6, "http://e.io/", link.format("http://evil.org/x6")), (7, "http://evil.org/x6", link.format("http://d.io/")), (8, "http://f.io", link.format("relative")),
    ]
    redirects = spark.createDataFrame([("http://g.io/", "https://b.io/2"), (None, "x")], "source string, target string")
    out = judged(spark, [*rows, (9, "http://g.io/#z", "")], redirects)
    verdicts = {i: r[3] for i, r in out.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block"}


def test_link_targets(spark):
    link = '<link rel="canonical" href="{}">'
    page = "http://A.io/x/y/p?q=1#f"
    given = {
        "page.html": "http://a.io/x/y/page.html", "../z": "http://a.io/x/z", "../../../z/./?a": "http://a.io/z/?a", "?id=1": "http://a.io/x/y/p?id=1",
        "./": "http://a.io/x/y/", "..": "http://a.io/x/", "/r/../s#t": "http://a.io/s#t", "//b.io/c": "http://b.io/c", "https://b.io/?u=http://c": "https://b.io/?u=http://c",
        "s?u=http://c/../d": "http://a.io/x/y/s?u=http://c/../d", "http://b.io/?a=1&amp;b=2&#38;c=&amp;lt;": "http://b.io/?a=1&b=2&c=&lt;", "mailto:x": None, "#g": "http://a.io/x/y/p?q=1#g",
    }
    pages = spark.createDataFrame([(i, page, link.format(k)) for i, k in enumerate(given)], PAGES)
    out = [r.target for r in url_filters.page_links(pages).collect()]
    assert out == [v for v in given.values() if v]
    bare = spark.createDataFrame([(1, "http://a.io", link.format("p") + link.format("/q") + "<meta http-equiv=refresh content='0;url=r'><META http-equiv=refresh content=0;url=s>"), (2, "http://b.io", None)], PAGES)
    assert sorted(r.target for r in url_filters.page_links(bare).collect()) == [f"http://a.io/{c}" for c in "pqrs"]


def test_relative_and_later_aliases_inherit(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.io/d/1", link.format("2")), (2, "http://a.io/d/2", link.format("http://none.io/") + link.format("http://evil.org/x?a=1&amp;b=2")),
        (3, "http://evil.org/x?a=1&b=2", ""), (4, "http://a.io/4", ""),
    ]
    assert {i: r[3] for i, r in judged(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
