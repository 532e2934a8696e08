import gzip
import hashlib
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tandemrank.llm import archives
from tandemrank.llm.archives import arc_records, convert, convert_pages, read_warcs, resolved, synthesise, warc_date, warc_record, warc_records
from tandemrank.session import scratch_dir

V1 = b"filedesc://old.arc 0.0.0.0 19970102030405 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
V1 = V1.replace(b" 76\n", b" %d\n" % len(V1.split(b"\n", 1)[1])) + b"\n"
V2BODY = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
V2 = b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc %d\n" % len(V2BODY) + V2BODY + b"\n"


def v1(url, block, date=b"19980101000000", kind=b"text/html", size=None):
    return b"%s 1.2.3.4 %s %s %d\n" % (url, date, kind, len(block) if size is None else size) + block + b"\n"


def v2(url, block, date=b"20020101000000"):
    return b"%s 1.2.3.4 %s text/html 200 abc - 77 new.arc %d\n" % (url, date, len(block)) + block + b"\n"


def test_header_lines_of_both_versions_and_declared_lengths():
    inner = b"HTTP/1.0 200 OK\r\n\r\nx\nhttp://no/ 1.1.1.1 19990101000000 text/html 3\nabc\n\n"
    for data in (V1 + v1(b"http://a/b c", inner) + v1(b"dns:a", b"a. 5 IN A 1.2.3.4", kind=b"text/dns"), gzip.compress(V1) + gzip.compress(v1(b"http://a/b c", inner)) + gzip.compress(v1(b"dns:a", b"a. 5 IN A 1.2.3.4", kind=b"text/dns"))):
        got = list(arc_records(data))
        assert [f["URL"] for _, f, _, _ in got] == ["filedesc://old.arc", "http://a/b c", "dns:a"]
        assert got[1][2] == inner and {s for *_, s in got} == {"ok"} and got[1][0] == len(V1)
    got = list(arc_records(V2 + v2(b"http://x", inner) + v2(b"http://y", b"")))
    assert [f["Result-code"] for _, f, _, _ in got] == ["200"] * 3 and got[1][1]["Checksum"] == "abc" and got[2][2] == b""
    kinds = [synthesise("old.arc", "d", at, f, b)["kind"] for at, f, b, _ in arc_records(V1 + v1(b"http://a", inner) + v1(b"dns:a", b"z"))]
    assert kinds == ["warcinfo", "response", "resource"]


def test_damaged_files_resume_or_end():
    good = v1(b"http://good", b"HTTP/1.0 200 OK\r\n\r\nfine")
    short = v1(b"http://short", b"HTTP/1.0 200 OK\r\n\r\nmore than said", size=25)
    got = [(f["URL"], s) for _, f, _, s in arc_records(V1 + short + good + good)]
    assert got == [("filedesc://old.arc", "ok"), ("http://short", "ok"), ("http://good", "resumed"), ("http://good", "ok")]
    assert [s for *_, s in arc_records(V1 + good[:-8])][-1] == "truncated"
    assert not list(arc_records(b"")) and not list(arc_records(b"\n\n")) and not list(arc_records(b"no header here\n"))
    packed = gzip.compress(V1 + good * 50)
    r = random.Random(1)
    for _ in range(200):
        bad = bytearray(packed if r.random() < 0.5 else V1 + good * 5)
        for _ in range(r.randrange(1, 5)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        bad = bytes(bad[: r.randrange(len(bad))])
        for at, f, block, _ in arc_records(bad):
            warc_record(synthesise("n", "1970-01-01T00:00:00Z", at, f, block))
        list(warc_records(bad))


@pytest.mark.parametrize("digits, date", [
    ("19990102030405", "1999-01-02T03:04:05Z"), ("199901020304", "1999-01-02T03:04:00Z"), ("19990102", "1999-01-02T00:00:00Z"),
    ("19990102030405678", "1999-01-02T03:04:05Z"), ("19991302030405", None), ("", None), ("1999010203040x", None), ("²⁰²⁰²⁰²⁰", None),
])
def test_dates(digits, date):
    assert warc_date(digits) == date


def test_records_round_trip_with_digests():
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\n\xff\x00body\r\n\r\nWARC/1.1\r\n"
    made = synthesise("n", "2000-01-01T00:00:00Z", 7, {"URL": "http://a", "Archive-date": "bad", "Content-type": "text/html", "IP-address": "1.2.3.4"}, block)
    again = synthesise("n", "2000-01-01T00:00:00Z", 7, {"URL": "http://a", "Archive-date": "bad", "Content-type": "text/html", "IP-address": "1.2.3.4"}, block)
    assert made == again and uuid.UUID(made["id"][10:-1]).version == 5 and made["date"] == "2000-01-01T00:00:00Z"
    data = warc_record(made) + b"\r\n\r\n" + warc_record(made, ("<i>", "u", "d")) + b"\r\n\r\n"
    (h, b), (rh, rb) = warc_records(data)
    assert b == block and h["warc-type"] == "response" and rh["warc-type"] == "revisit" and rh["warc-refers-to"] == "<i>"
    assert rb == block[: block.index(b"\xff")] and rh["warc-payload-digest"] == h["warc-payload-digest"] == archives._sha1(block[len(rb) :])
    assert [x for x, _ in warc_records(data[:-40])] == [h]


def brute(rows):
    out = []
    for d, _, t in rows:
        body = (t or "").encode()
        same = [x for x, _, y in rows if (y or "") == (t or "")]
        last = max(x for x in same if x is not None) if any(x is not None for x in same) else None
        again = len(body) >= 1000 and d != last
        out.append((d, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_pages_equal_brute_force(spark):
    r = random.Random(2)
    big = ["é" * 500, "x" * 1000, "<p>\r\n\r\n" * 300, "y" * 999, "WARC/1.1\r\n" * 200, "\x00" * 2000]
    rows = [(i, f"http://h/{i} z", r.choice(big) if r.random() < 0.7 else f"page {i}\r\n") for i in range(120)]
    rows += [(200, None, None), (201, "", ""), (202, "a\nb", "short"), (203, "u", "z" * 2_000_000), (None, "n", "x" * 1000), (None, "n", "only" * 300), (-5, "n", "only" * 300), (2**62, "u", "é" * 500)]
    pages = spark.createDataFrame([(*x, 1, "k") for x in rows], "page_id bigint, url string, html string, turn int, path string").repartition(5)
    got = convert_pages(pages, f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    seen = [(x["turn"], x["payload_bytes"], x["sha1"], x["kind"], x["refers_turn"]) for x in got.collect()]
    assert sorted(seen, key=str) == brute(rows)
    assert got.filter("NOT sound").count() == 0 and got.select("id").distinct().count() == len(rows)


def test_repeated_rows_store_one_and_empty_tables_nothing(spark):
    rows = [(7, "u", "q" * 1500)] * 5
    got = convert_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    assert sorted((x["kind"], x["refers_turn"]) for x in got.select("kind", F.coalesce("refers_turn", F.lit(0)).alias("refers_turn")).collect()) == [("response", 0)] + [("revisit", 7)] * 4
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert convert_pages(none, f"{scratch_dir(spark)}/{uuid.uuid4().hex}").count() == 0


def test_bytes_of_any_encoding_pass(spark):
    raw = bytes(range(256)) * 8
    pages = spark.createDataFrame([(1, "u", raw), (2, "u", raw)], "page_id bigint, url string, raw binary")
    got = convert_pages(pages.select("page_id", "url", F.col("raw").cast("string").alias("html")), f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    assert {(x["turn"], x["payload_bytes"], x["sha1"], x["kind"]) for x in got.collect()} == {(k, len(raw), hashlib.sha1(raw).hexdigest(), v) for k, v in ((1, "revisit"), (2, "response"))}


def test_foreign_archives(spark):
    arcs = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n" + b"same" * 400
    with open(f"{arcs}/a.arc", "wb") as f:
        f.write(V1 + v1(b"http://one", body) + v1(b"dns:one", b"1.2.3.4", kind=b"text/dns"))
    with gzip.open(f"{arcs}/b.arc.gz", "wb") as f:
        f.write(V2 + v2(b"http://two", body) + v2(b"http://three", b"HTTP/1.1 404 No\r\n\r\n"))
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    convert(spark, arcs, out)
    got = {x["uri"]: x for x in resolved(read_warcs(spark, out)).collect() if x["kind"] != "warcinfo"}
    assert {u: x["kind"] for u, x in got.items()} == {"http://one": "revisit", "dns:one": "resource", "http://two": "response", "http://three": "response"}
    assert got["http://one"]["refers"] == got["http://two"]["id"] and got["http://one"]["payload_bytes"] == 1600 and all(x["sound"] for x in got.values())
    assert got["http://two"]["date"] == "2002-01-01T00:00:00Z"
