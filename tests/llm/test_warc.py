import gzip
import hashlib

import pytest

from wavetable.llm.warc import op6, read_archives, record, salvage, write_archives

SF = "/root/testdata/sf0.001"


def records(n=5):
    return [record(i, f"http://x/{i} y", f"<p>{i}</p>\r\n\r\nWARC/1.1 in the text ".encode() * (i + 1), None, "2024-01-01T00:00:00Z") for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_is_quarantined_and_later_records_recovered(packed):
    parts = [gzip.compress(r, mtime=0) if packed else r for r in records()]
    whole = list(salvage(b"".join(parts)))
    assert [r["record_id"] for r in whole] == [f"<urn:page:{i}>" for i in range(5)] and whole[1]["target_uri"] == "http://x/1%20y"
    bad = bytearray(parts[2])
    bad[-12 if packed else -40] ^= 255
    data = b"junk" + parts[0] + parts[1] + bytes(bad) + parts[3] + b"\x1f\x8b\x08 more junk" + parts[4][:-9]
    got = list(salvage(data))
    found = [r["record_id"] for r in got if r["kind"] == "record"]
    # the last member lacks its trailer only: its record is there and its digest holds
    assert found == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>"] + ["<urn:page:4>"] * packed
    gaps = [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"]
    assert gaps[0] == (0, 4) and gaps[1] == (4 + len(parts[0]) + len(parts[1]), len(bad)) and sum(gaps[-1]) == len(data)
    assert sum(r["length"] for r in got) == len(data)


def test_wrong_length_and_wrong_digest():
    a, b = records(2)
    longer = a.replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert [r["kind"] for r in salvage(longer + b)][-1] == "record"
    other = a.replace(b"<p>0", b"<q>0", 1)
    assert [(r["kind"], r.get("error")) for r in salvage(other + b)][0] == ("gap", "wrong block digest")
    assert list(salvage(b"")) == []


def test_round_trip_with_revisits(spark, tmp_path):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "u1", big), (7, None, big), (3, "a\r\nb", big), (4, "", small), (5, "u", small), (6, "u", None), (None, "n", big), (8, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "d").withColumnRenamed("d", "page_id")
    write_archives(df.selectExpr("*", "1 as s", "2 as keep"), str(tmp_path / "w"))
    got = {r["record_id"]: r for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 8 and {r["kind"] for r in got.values()} == {"record"}
    assert got["<urn:page:7>"]["record_type"] == "response" and got["<urn:page:7>"]["target_uri"] is None
    for i in ("1", "3", "-"):
        r = got[f"<urn:page:{i}>"]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == ("revisit", "<urn:page:7>", 1200)
        assert r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert got["<urn:page:4>"]["record_type"] == got["<urn:page:5>"]["record_type"] == "response"
    assert bytes(got["<urn:page:5>"]["payload"]) == small.encode() and got["<urn:page:3>"]["target_uri"] == "a%0D%0Ab"
    assert got["<urn:page:6>"]["payload_bytes"] == 0


def test_query_on_a_table(spark):
    got = {r["page_id"]: r for r in op6(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        data = (p["html"] or "").encode()
        assert (got[p["page_id"]]["payload_bytes"], got[p["page_id"]]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert read_archives(spark, str(tmp_path / "e")).count() == 0


def test_records_of_a_shared_member_are_salvaged_one_by_one():
    parts = records(5)
    bad = parts[2].replace(b"<p>2", b"<q>2", 1)
    plain = b"".join([*parts[:2], bad, *parts[3:]])
    got = list(salvage(gzip.compress(plain, mtime=0)))
    assert [r.get("record_id") for r in got] == ["<urn:page:0>", "<urn:page:1>", None, "<urn:page:3>", "<urn:page:4>"]
    assert (got[2]["kind"], got[2]["inner"], got[2]["inner_length"], got[2]["error"]) == ("gap", len(parts[0]) + len(parts[1]), len(bad), "wrong block digest")
    # a cut end loses only what is cut; the file's bytes are a gap
    noise = [record(i, None, hashlib.sha512(b"%d" % i).hexdigest().encode() * 40, None, "2024-01-01T00:00:00Z") for i in range(6)]
    member = gzip.compress(b"".join(noise), mtime=0)
    cut = member[: len(member) * 2 // 3]
    got = list(salvage(cut + gzip.compress(parts[0], mtime=0)))
    found = [r["record_id"] for r in got if r["kind"] == "record"]
    assert found[:3] == [f"<urn:page:{i}>" for i in range(3)] and found[-1] == "<urn:page:0>" and 4 <= len(found) < 7
    assert [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"] == [(0, len(cut))]
    # a record without digest in a damaged member is not trusted
    bare = b"\r\n".join(x for x in parts[0].split(b"\r\n") if b"Digest" not in x)
    broken = bytearray(gzip.compress(bare, mtime=0))
    broken[-6] ^= 255
    assert [r["kind"] for r in salvage(bytes(broken))] == ["gap"]


def test_a_very_long_payload_and_many_failures_in_a_row():
    big = record(1, "u", b"WARC/1. " * 400_000, None, "2024-01-01T00:00:00Z")
    data = b"WARC/1.1\r\nbroken\r\n\r\n" * 300 + big
    got = list(salvage(data))
    assert [r["kind"] for r in got] == ["gap", "record"] and got[1]["payload_bytes"] == 3_200_000


def test_repeated_pages_of_a_table_become_revisits(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    again = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    rows = pages.unionByName(again).unionByName(pages.where("page_id % 6 = 0").withColumn("page_id", F.col("page_id") + 2_000_000))
    write_archives(rows, str(tmp_path / "r"))
    got = {r["record_id"]: r for r in read_archives(spark, str(tmp_path / "r"), payloads=False).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault((r["html"] or "").encode(), []).append(r["page_id"])
    seen = 0
    for data, ids in groups.items():
        for i in ids:
            r = got[f"<urn:page:{i}>"]
            revisit = len(data) >= 1000 and i != max(ids)
            seen += revisit
            assert (r["record_type"], r["refers_to"]) == (("revisit", f"<urn:page:{max(ids)}>") if revisit else ("response", None))
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert seen > 0
