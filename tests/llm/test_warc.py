import gzip
import io

from treeline.llm import warc


def stream(*members):
    data = io.BytesIO(b"".join(members))
    return list(warc.Records(lambda n: data.read(min(n, 7))))  # small reads: members end anywhere in a block


def test_one_member_a_record_with_digests():
    block = b"hello\r\n\r\nworld"
    good = warc.member(block, {"WARC-Type": "resource", "WARC-Block-Digest": warc.digest(block)})
    bad = warc.member(block, {"WARC-Type": "resource", "WARC-Block-Digest": warc.digest(b"other")})
    none = warc.member(b"", {"WARC-Type": "warcinfo"})
    rows = stream(good, bad, none)
    assert [r["block_digest_ok"] for r in rows] == [True, False, None]
    assert rows[0]["payload"] == block and rows[2]["content_length"] == 0
    assert [r["record_no"] for r in rows] == [0, 1, 2]


def test_http_payload_and_digest_forms():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    headers = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": "sha256:" + __import__("hashlib").sha256(b"body").hexdigest()}
    (row,) = stream(warc.member(block, headers))
    assert row["payload"] == b"body" and row["payload_digest_ok"] is True


def test_broken_streams_name_the_problem():
    one = warc.member(b"x" * 1000, {"WARC-Type": "resource"})
    assert stream(one, one[:40])[1]["problem"] == "truncated member"
    assert stream(one, b"plain text")[1]["problem"] == "not a gzip member"
    assert stream(gzip.compress(b"no header at all"))[0]["problem"] == "no WARC header"
    assert stream(gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\nx"))[0]["problem"] == "no Content-Length"
    assert "shorter" in stream(gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx"))[0]["problem"]
    assert "longer" in stream(gzip.compress(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nxyz"))[0]["problem"]
    assert stream() == []


def test_records_behind_a_broken_member_come_back():
    block = bytes(range(256)) * 40 + b"\x1f\x8b\x08" * 5
    one = warc.member(block, {"WARC-Type": "resource", "WARC-Block-Digest": warc.digest(block)})
    torn = one[: len(one) // 2] + b"\0" * 20 + one[len(one) // 2 + 20 :]
    for broken in (torn, one[:60], b"noise \x1f\x8b\x08 noise", one[:-4]):
        rows = stream(one, broken, one, one)
        assert [r.get("block_digest_ok") for r in rows if not r["problem"]].count(True) == 3, broken[:10]
        assert sum(bool(r["problem"]) for r in rows) >= 1


def test_damaged_and_missing_files_of_a_table(spark, tmp_path):
    one = warc.member(b"x" * 1000, {"WARC-Type": "resource", "WARC-Block-Digest": warc.digest(b"x" * 1000)})
    (tmp_path / "a.gz").write_bytes(one + b"torn" + one)
    (tmp_path / "b.gz").write_bytes(b"")
    rows = warc.read_warc(spark, [f"file://{tmp_path}/{n}.gz" for n in "abc"]).collect()
    by = {n: sorted(r.problem or "" for r in rows if r.file.endswith(f"{n}.gz")) for n in "abc"}
    assert by == {"a": ["", "", "not a gzip member"], "b": [], "c": ["no such file"]}


def test_pages_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/c", "<p>é</p>"), (1, "http://a.b/c", "<p>é</p>"), (None, None, None), (2, "http://x\ny", ""), (3, "u", "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS file")
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    back = warc.read_warc(spark, files)
    assert back.where("block_digest_ok AND payload_digest_ok AND problem IS NULL").count() == len(rows)
    assert sorted(bytes(r.payload).decode() for r in back.collect()) == sorted(r[2] or "" for r in rows)
    assert warc.read_warc(spark, []).count() == 0
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/none") == []
