import base64
import gzip
import hashlib
import io
import zipfile

import pytest
from oracle import SF, oracle_rows, spark_rows

from keelson.llm import warc
from keelson.llm.queries import ORACLES, op7_warc

SCHEMA = "page_id long, url string, html string, payload_bytes long, digest binary, first long, text string"


def pages(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 20_000, "<p>a</p>", "\r\n\r\n", "x\x00y", "é" * 20_000]
    made = [(i, None if i == 1 else f"http://h/{i}", h, -1, None, None, None) for i, h in enumerate(html)]
    return spark.createDataFrame([*made, (2, "http://h/again", "<p>a</p>", 0, None, None, None), (None, "u", "<p>b</p>", 0, None, None, None)], SCHEMA), html


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, zip64, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 200)
    rows, html = pages(spark)
    got = warc.archive_round_trip(rows, zip64=zip64).collect()
    assert len(got) == 12
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {}
    for i, h in enumerate(html):
        last[sha(h)] = i
    for r in got:
        if r["page_id"] is None:
            continue
        h = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), sha(h))
        top = last[sha(h)]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == top else ("revisit", top))


def test_small_payloads_are_all_responses(spark):
    rows, _ = pages(spark)
    got = warc.archive_round_trip(rows, least_bytes=100).collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100)
    assert sum(r["record_type"] == "revisit" for r in got) == 1


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files_that_others_read(tmp_path, zip64):
    path = tmp_path / "a.wacz"
    w = warc.ZipWriter(open(path, "wb"), zip64)  # noqa: SIM115
    w.add("archive/é.warc.gz", b"abc" * 1000)
    w.add("indexes/index.cdxj", b"")
    w.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("archive/é.warc.gz") == b"abc" * 1000
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        found = warc.directory(f, f.size())
        offset, size, method = found["archive/é.warc.gz"]
        assert method == 0 and f.read_at(size, warc.data_offset(f, offset)) == b"abc" * 1000


def test_packages_of_others_are_read(tmp_path):
    path = tmp_path / "b.wacz"
    data = warc.record(7, "http://x", b"<p>", warc.base32_sha1(b"<p>"), None)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", data)
        z.writestr("indexes/index.cdxj", f'{{"page": 7, "offset": 0, "length": {len(data)}, "filename": "archive/data.warc.gz"}}')
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    (r,) = warc.read_package(f"file://{path}")
    assert (r["page_id"], r["payload"], r["record_type"]) == (7, b"<p>", "response")


def test_damage_is_an_error(tmp_path):
    from pyarrow import BufferReader

    with pytest.raises(ValueError):
        warc.directory(BufferReader(b"no package at all"), 17)
    good = warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), None)
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(gzip.decompress(good).replace(b"abc", b"abd")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("indexes/index.cdxj", "x" * 100)
    path = tmp_path / "c.wacz"
    path.write_bytes(out.getvalue())
    with pytest.raises(ValueError):
        list(warc.read_package(f"file://{path}"))


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    assert spark_rows(op7_warc(spark, SF)) == oracle_rows(ORACLES["op7_warc"])
