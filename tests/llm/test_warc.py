"""WARC round trip, revisits against a plain as-of loop, canonical URLs."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import warc
from quernstone.llm.shared import new_path, ship

FIELDS = "record_id string, kind string, url string, t long, status int, headers map<string,string>, payload binary"


def test_round_trip(spark):
    ship(spark)
    rows = [("a", "response", "http://x/é?a=1", 5, 200, {"etag": '"1"', "x": "a: b"}, bytes(range(256)) * 50_000), ("b", "revisit", None, -3, 304, {}, None), ("c", "response", "u", None, None, None, b"\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows * 3, FIELDS).repartition(2)
    folder = new_path(spark, "warc-test")
    got = warc.read_warc(spark, folder, warc.write_warc(df, folder)).collect()
    want = [(*r[:5], r[5] or {}, r[6] or b"") for r in rows * 3]
    assert sorted(((*r[:6], bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    assert {r.payload for r in warc.read_warc(spark, folder, warc.write_warc(df, folder), payload=False).collect()} == {None}
    none = new_path(spark, "warc-test")
    assert warc.read_warc(spark, none, warc.write_warc(df.limit(0), none)).collect() == []


def record(kind, own, block, content="application/http; msgtype=response", date="2021-03-04T05:06:07Z", url="http://www.example.org/a"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {date}\r\n" + (f"WARC-Target-URI: {url}\r\n" if url else "") + f"Content-Type: {content}\r\nContent-length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


FOREIGN = [
    record("warcinfo", "1", b"software: x\r\nformat: WARC File Format 1.0\r\n", "application/warc-fields", url=None),
    record("request", "2", b"GET /a HTTP/1.1\r\nHost: www.example.org\r\n\r\n", "application/http; msgtype=request"),
    record("response", "3", b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1, 2\r\nVia: x\r\nset-cookie: b=2\r\nVia: y\r\nETag: \"v1\"\r\nX-Long: one\r\n  two\r\n\r\n<html>\r\n\r\nWARC/1.0</html>"),
    record("metadata", "4", b"fetchTimeMs: 3\r\n", "application/warc-fields"),
    record("revisit", "5", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"v1\"\r\nDate: later\r\n\r\n", date="2021-03-04T06:06:07.25+01:00"),
    record("revisit", "6", b"HTTP/1.1 304 Not Modified\r\nETag: \"v2\"\r\n\r\n", date="2022", url="https://example.org/a#x"),
    record("resource", "7", b"HTTP/1.1 200 no header block", "text/plain", date="soon"),
]


@pytest.mark.parametrize("packed", ["members", "whole", "plain"])
def test_foreign_files(spark, tmp_path, packed):
    """Records of every kind, standard dates, repeated and folded fields; compressed by record, as a whole, not at all."""
    ship(spark)
    raw = {"members": b"".join(map(gzip.compress, FOREIGN)), "whole": gzip.compress(b"".join(FOREIGN)), "plain": b"".join(FOREIGN)}[packed]
    (tmp_path / ("a.warc" if packed == "plain" else "a.warc.gz")).write_bytes(raw)
    (tmp_path / "notes.txt").write_text("x")
    folder = f"file://{tmp_path}"
    records = warc.read_warc(spark, folder, warc.warc_files(spark, folder))
    got = {r.record_id.removeprefix("urn:uuid:"): r for r in records.collect()}
    assert [got[k].kind for k in sorted(got)] == ["warcinfo", "request", "response", "metadata", "revisit", "revisit", "resource"]
    assert got["3"].headers == {"set-cookie": "a=1, 2\nb=2", "via": "x, y", "etag": '"v1"', "x-long": "one two"} and bytes(got["3"].payload) == b"<html>\r\n\r\nWARC/1.0</html>"
    assert got["2"].headers == {"host": "www.example.org"} and bytes(got["1"].payload).startswith(b"software") and got["1"].url is None
    assert [got[k].status for k in sorted(got)] == [None, None, 200, None, 304, 304, None]
    assert got["3"].t == 1_614_834_367_000_000 and got["5"].t == got["3"].t + 250_000 and got["6"].t == 1_640_995_200_000_000 and got["7"].t is None
    found = {r.record_id[-1]: r for r in warc.resolve_revisits(records).collect()}
    assert (found["5"].outcome, found["6"].outcome) == ("resolved", "mismatch") and found["5"].response_id == found["6"].response_id == "urn:uuid:3"
    assert found["5"].headers == {"set-cookie": "a=1, 2\nb=2", "via": "x, y", "etag": 'W/"v1"', "x-long": "one two", "date": "later"}
    again = new_path(spark, "warc-test")
    copied = warc.read_warc(spark, again, warc.write_warc(records.where("kind IN ('response', 'revisit')"), again)).collect()
    assert {r.record_id[-1]: (r.t, r.url, r.status, r.headers, bytes(r.payload)) for r in copied} == {k: (r.t, r.url, r.status, r.headers, bytes(r.payload)) for k, r in got.items() if k in "356"}


def test_dates_and_cut_files():
    assert warc.ticks(warc.warc_date(1)) == 1 and warc.ticks(warc.warc_date(-62_135_596_800_000_000)) == -62_135_596_800_000_000
    assert [warc.ticks(x) for x in ("1970", "1970-01", "1970-01-01", "1970-01-01T00:00Z", "", None, "x", "19700101000000")][:4] == [0, 0, 0, 0]
    assert [warc.ticks(x) for x in ("", None, "x", "1970-13")] == [None] * 4
    small = [b"".join(FOREIGN)[k : k + 7] for k in range(0, sum(map(len, FOREIGN)), 7)]
    assert len(list(warc._records(iter(small)))) == len(FOREIGN)
    with pytest.raises(ValueError):
        list(warc._records(iter([FOREIGN[2][:-20]])))


def plain(rows):
    full = [r for r in rows if r[1] == "response" and 200 <= (r[4] or 0) <= 299 and r[4] != 206]
    low = -(1 << 63)
    out = []
    for r in rows:
        if r[1] != "revisit":
            continue
        earlier = [x for x in full if x[2] == r[2] and r[2] is not None and ((low if x[3] is None else x[3]), x[0]) < ((low if r[3] is None else r[3]), r[0])]
        best = max(earlier, key=lambda x: (low if x[3] is None else x[3], x[0]), default=None)
        new, old = r[5] or {}, (best[5] or {}) if best else {}
        strip = lambda x: x and x.removeprefix("W/")
        agree = None
        if strip(new.get("etag")) and strip(old.get("etag")):
            agree = strip(new["etag"]) == strip(old["etag"])
        elif new.get("last-modified") and old.get("last-modified"):
            agree = new["last-modified"] == old["last-modified"]
        outcome = "missing" if not best else {None: "unverified", True: "resolved", False: "mismatch"}[agree]
        headers = new
        if outcome == "resolved":
            fresh = {k: v for k, v in new.items() if k not in warc.FIXED_FIELDS}
            headers = {k: v for k, v in old.items() if k != "connection"} | fresh
        out.append((r[0], outcome, best[0] if best else None, headers))
    return sorted(out, key=str)


def test_as_of_join_with_a_hot_url(spark):
    rng = random.Random(4)
    tag = lambda: rng.choice([{}, {"etag": rng.choice(['"1"', 'W/"1"', '"2"'])}, {"last-modified": rng.choice("ab")}])
    rows = []
    for i in range(900):
        url = rng.choice(["hot/a", "hot/a", f"x/{i % 40}", None])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((f"r{i:04d}", kind, url, rng.choice([rng.randint(0, 300), None, 7]), rng.choice([200, 200, 206, 404, None]), rng.choice([None, tag() | {"connection": "close", "content-length": str(i), "x": str(i)}]), 1))
    df = spark.createDataFrame(rows, FIELDS.replace("payload binary", "extra int"))
    got = warc.resolve_revisits(df).collect()
    assert sorted(((r.record_id, r.outcome, r.response_id, r.headers) for r in got), key=str) == plain(rows)
    assert {r.outcome for r in got} == {"resolved", "mismatch", "unverified", "missing"}
    assert warc.resolve_revisits(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "url, key",
    [("HTTP://WWW.Example.org:80/A/b//?b=2&utm_source=x&a=1#f", "example.org/A/b?a=1&b=2"), ("https://e.org", "e.org"), ("https://e.org/?ref=1&", "e.org"), ("e.org/x?", "e.org/x"), ("http://e.org?x=1", "e.org?x=1"), ("", ""), (None, None)],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key
