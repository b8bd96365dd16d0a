import gzip
import json
import zlib
from pathlib import Path

import pytest

from gleanspark.llm.shared import shared_folder
from gleanspark.llm.warc import archived, normalised, page_records

ROWS = [
    (1, "http://a/\r\nX: y", "<p>" + "same " * 40),
    (2, None, "<p>" + "same " * 40),
    (3, "http://c", None),
    (4, "http://d", ""),
    (5, "http://e", "short"),
    (6, "http://f", "short"),
    (7, "http://g", "\r\n\r\nWARC/1.1\r\n\r\n" * 30),
    (8, "http://h", "ü" * 500_000),
    (9, "http://i", "ü" * 500_000),
    (2, None, "<p>" + "same " * 40),
    (None, "http://n", "no id" * 50),
    (None, "http://o", "no id" * 50),
    (None, "http://p", "<p>" + "same " * 40),
    (None, None, None),
]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS path")


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_pages_come_back(spark, archive_bytes):
    folder = f"{shared_folder(spark)}/warc-test-{archive_bytes}"
    rows = page_records(pages(spark), folder, archive_bytes).collect()
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows}
    assert len(rows) == len(ROWS)
    same, long = len("<p>" + "same " * 40), 1_000_000
    assert got == {
        (1, same, "response", None), (2, same, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None),
        (5, 5, "response", None), (6, 5, "response", None), (7, 480, "response", None), (8, long, "response", None),
        (9, long, "revisit", 8), (None, 250, "response", None), (None, same, "revisit", 1), (None, 0, "response", None),
    }


def test_archives_and_index_on_disk(spark):
    folder = f"{shared_folder(spark)}/warc-files"
    read = archived(pages(spark), folder)
    payloads = {r.page_id: r.payload for r in read.collect() if r.record_type == "response"}
    assert {i: p.decode() for i, p in payloads.items() if i} == {i: h or "" for i, _, h in ROWS if i and i in payloads}
    assert read.count() == len(ROWS)
    root = Path(folder.removeprefix("file://"))
    for whole in root.glob("whole/*.warc.gz"):
        # one member before, a member for each record after, the same bytes in both
        unpack = zlib.decompressobj(31)
        content = unpack.decompress(whole.read_bytes())
        assert unpack.eof and not unpack.unused_data
        members = root / "members" / whole.name
        data = members.read_bytes()
        assert gzip.decompress(data) == content
        rows = [json.loads(line) for line in (root / "members" / whole.name.replace(".warc.gz", ".cdxj")).open()]
        assert sum(r["length"] for r in rows) == len(data)
        parts = [gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in rows]
        assert b"".join(parts) == content and all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def test_broken_archives_are_errors(tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for name, data in (("cut", gzip.compress(record * 50)[:-9]), ("short", gzip.compress(record[:-6]))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises((ValueError, zlib.error)):
            list(normalised(f"file://{tmp_path}/{name}", f"file://{tmp_path}/out/{name}.warc.gz"))
        assert not list((tmp_path / "out").glob("*.gz"))


def test_no_pages(spark):
    assert page_records(pages(spark).where("false"), f"{shared_folder(spark)}/warc-none").count() == 0
