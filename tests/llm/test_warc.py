import base64
import hashlib
import os

import pytest

from careline.llm import warc

SCHEMA = "page_id long, url string, html string, id long, payload string, n int"


def fake(n, body="zz"):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\n"
            f"Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n")


PAGES = [
    (1, "u1", "plain"), (2, "u2", "plain"), (3, None, None), (4, "u4", ""), (5, "u\r\n5", "before " + fake(90) + fake(91, "y" * 40) + " after"),
    (6, "u6", "WARC/1.1\r\n" * 3), (7, "u7", "cut WARC/1.1\r\nContent-Length: 7\r\n\r\nabc"), (8, "ü", "é 日本 " * 3000),
    (2, "u2", "plain"), (9, "u9", fake(92)), (10, "u10", fake(92)), (None, "u", "null id"), (11, "a", "x" * 200_000), (1, "u1b", "plain"),
    (12, "u12", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"), (13, "u13", "WARC/1.1\r"), (14, "u14", "\r\n\r\nWARC/1.1\r\n\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out, used = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        h = h or ""
        best = first.get(h)
        response = i == best and h not in used
        if response:
            used.add(h)
        out.append((i, len(h.encode()), digest(h), "response" if response else "revisit", None if response else best))
    return sorted(out, key=str)


@pytest.mark.parametrize("split, compression", [(None, None), (3000, None), (40_000, None), (3000, "gzip")])
def test_round_trip_with_magics_in_payloads(spark, tmp_path, split, compression):
    df = spark.createDataFrame([(*r, 0, "", 0) for r in PAGES], SCHEMA)
    path = str(tmp_path / "a")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
        warc.write_archives(df.coalesce(1), path, compression=compression)
        found = warc.resolved(warc.read_archives(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    have = sorted(((r.id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in found), key=str)
    assert have == expected(PAGES)


def test_small_payloads_are_not_revisited(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"), least_bytes=5)
    found = {r.id: r.kind for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_a_broken_file_keeps_what_comes_before(spark, tmp_path):
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "x.warc").write_bytes((fake(1) + fake(2, "ok") + "junk " + fake(3)).encode())
    (tmp_path / "a" / "y.warc").write_bytes(("junk" + fake(4)).encode())
    (tmp_path / "a" / "z.warc").write_bytes(fake(5)[:-9].encode())
    assert sorted(r.id for r in warc.read_archives(spark, str(tmp_path / "a")).collect()) == ["<urn:page:1>", "<urn:page:2>"]


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).count() == 0
