"""Operators 1 and 10, and the registered queries of the subpackage."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemetric.llm import queries as R
from tidemetric.llm import url_filter as U
from tidemetric.llm import warc as A
from tidemetric.llm.common import new_folder, table

PAGES = "page_id long, url string, html string, digest string, n string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_round_trip_with_copies_and_nulls(spark):
    big, other = "é<p>x</p>\r\n\r\nWARC/1.1\r\n" * 100, "o" * 999
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (4, "http://c", other), (6, "http://d", other), (7, "u", None), (8, "u", ""), (None, "u", big), (9, "u", "z" * 3_000_000), (9, "u", "z" * 3_000_000)]
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in A.archive_pages(pages(spark, rows)).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    revisit = {1: 5, 3: 5, None: 5}
    want = sorted(((i, len((t or "").encode()), sha(t), "revisit" if t == big and i in revisit else "response", 5 if t == big and i in revisit else None) for i, _, t in rows), key=str)
    assert got == want
    assert A.archive_pages(pages(spark, [])).count() == 0


def test_members_stand_alone_at_their_offsets(spark, tiny):
    folder = new_folder(spark, "warc-test")
    A.write_warc(table(spark, tiny, "pages"), f"{folder}/streams")
    index = A.normalise(spark, f"{folder}/streams", f"{folder}/records").collect()
    assert len(index) == table(spark, tiny, "pages").count()
    for archive in {r["archive"] for r in index}:
        raw = open(archive.removeprefix("file://"), "rb").read()
        rows = sorted((r for r in index if r["archive"] == archive), key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        assert sum(r["length"] for r in rows) == len(raw)
        texts = [zlib.decompress(raw[r["offset"] : r["offset"] + r["length"]], 31) for r in rows]
        assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts)
        assert gzip.decompress(raw) == b"".join(texts)
        side = open(f"{archive.removeprefix('file://')}.idx").read().splitlines()
        assert [line.split("\t")[:2] for line in side] == [[str(r["offset"]), str(r["length"])] for r in rows]


URLS = {
    "https://Example.COM/a?b#c": ("example.com", "/a", "com/", "allow"),
    "http://sub.example.com/en/x": ("sub.example.com", "/en/x", "example.com/en/", "block"),
    "http://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://a.net/fr/1": ("a.net", "/fr/1", "net/fr/", "block"),
    "http://a.net?x=/fr/": ("a.net", "", None, None),
    "http://a.org#http://b.com/": ("a.org", "", None, None),
    "no scheme": ("", "", None, None),
    "http://É.NET/es/": ("É.net", "/es/", "net/es/", "block"),
}


def test_urls_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(99, None, None), (99, None, None), (None, "http://q.com", None), (98, "http://long.com/" + "x" * 1_000_000, None)]
    got = U.judge_urls(pages(spark, rows), spark.createDataFrame([], "host string, good int")).collect()
    assert len(got) == 14 and all(r["verdict"] in ("allow", "block") for r in got)
    named = {r["page_id"]: r for r in got}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (named[i]["host"], named[i]["path"], named[i]["rule"]) == (host, path, rule)
        assert verdict is None or named[i]["verdict"] == verdict
    assert (named[99]["host"], named[99]["path"], named[99]["rule"]) == ("", "", None)
    assert U.judge_urls(pages(spark, []), spark.createDataFrame([], "host string, good int")).count() == 0


def test_reputation_shrinks_towards_the_levels_above(spark):
    hosts = [("a.good.org", 200, 190), ("b.good.org", 0, 0), ("a.bad.org", 200, 10), ("b.bad.org", 1, 1), ("new.org", 0, 0)]
    got = {r["host"]: (r["mean"], r["bound"]) for r in U.host_reputation(spark.createDataFrame(hosts, "host string, n long, good long")).collect()}
    assert got["a.good.org"][0] > got["b.good.org"][0] > 0.5 > got["b.bad.org"][0] > got["a.bad.org"][0]
    assert 0.3 < got["new.org"][0] < 0.7
    assert all(bound < mean for mean, bound in got.values())
    assert got["a.good.org"][0] - got["a.good.org"][1] < got["b.good.org"][0] - got["b.good.org"][1]


def test_registered_domains(spark):
    hosts = {"a.b.co.in": ("co.in", "b.co.in"), "x.com.cn": ("com.cn", "x.com.cn"), "me.github.io": ("github.io", "me.github.io"), "u:p@www.example.com:8080": ("com", "example.com"), "example.com": ("com", "example.com"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""), "a." * 50_000 + "org": ("org", "a.org")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["s"], r["d"]) for r in df.select("host", U.suffix_of(F.col("host")).alias("s"), U.domain_of(F.col("host")).alias("d")).collect()}
    assert got == hosts


LISTED = {  # host: (suffix, domain) by the rules below
    "a.b.x.nsw.gov.au": ("nsw.gov.au", "x.nsw.gov.au"), "x.gov.au": ("gov.au", "x.gov.au"), "gov.au": ("gov.au", "gov.au"), "b.me.uk": ("me.uk", "b.me.uk"), "c.d.ck": ("d.ck", "c.d.ck"), "a.www.ck": ("ck", "www.ck"), "ck": ("ck", "ck"),
    "deep.me.github.io": ("github.io", "me.github.io"), "a.example.com.": ("com", "example.com"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "[::1]:80": ("[::1]", "[::1]"), "u:p@10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "2130706433": ("2130706433", "2130706433"),
    "unlisted": ("unlisted", "unlisted"), "": ("", ""), "a." * 20_000 + "gov.au": ("gov.au", "a.gov.au"),
}


def test_public_suffix_list_as_a_table(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "au", "gov.au", "nsw.gov.au", "uk", "me.uk", "*.ck", "!www.ck", "github.io", None, "")], "rule string")
    hosts = spark.createDataFrame([(h, 1, 1) for h in LISTED], "host string, n long, good long")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in U.registered_domains(hosts, rules).collect()}
    assert got == LISTED
    assert U.host_reputation(hosts, suffixes=rules).count() == len(LISTED)
    none = U.registered_domains(hosts, rules.filter("false"))
    assert {r["host"]: r["suffix"] for r in none.collect()}["x.gov.au"] == "au"


def test_addresses_are_no_names(spark):
    hosts = {"10.1.2.3": "10.1.2.3", "[2001:db8::1]:80": "[2001:db8::1]", "a.example.com.": "example.com", "u@[::1]": "[::1]", "x.co.uk.": "x.co.uk"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: r["d"] for r in df.select("host", U.domain_of(F.col("host")).alias("d")).collect()} == hosts
    judged = U.judge_urls(pages(spark, [(1, "http://10.1.2.3:80/a", None), (2, "http://[::1]/b", None), (3, "http://a.org./c", None)]), spark.createDataFrame([], "host string, good int")).collect()
    assert {r["page_id"]: r["host"] for r in judged} == {1: "10.1.2.3:80", 2: "[::1]", 3: "a.org."}


def test_a_host_with_most_pages_is_judged_where_it_is(spark, monkeypatch):
    rows = [(i, f"http://hot.org/{i}", None) for i in range(300)] + [(1000 + i, f"http://h{i}.org/", None) for i in range(50)]
    outcomes = spark.createDataFrame([("hot.org", 0)] * 40 + [("h1.org", 1)] * 40, "host string, good int")
    one = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages(spark, rows), outcomes).collect()}
    monkeypatch.setattr("tidemetric.llm.common.HEAVY_KEYS", 10)
    two = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages(spark, rows), outcomes).collect()}
    assert one == two and len(one) == 350 and one[0] == "block" and one[1001] == "allow"


def test_twins_are_registered():
    assert set(R.ORACLE_SQL) < set(R.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in R.QUERIES) == sorted(set(range(1, 14)) & {int(n[2:].split("_")[0]) for n in R.QUERIES})


@pytest.mark.parametrize("name", sorted(R.ORACLE_SQL))
def test_query_matches_its_twin(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = R.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    found = con.execute(R.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    one = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(one(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(one(r[names.index(c)]) for c in columns) for r in found.fetchall())
