from __future__ import annotations

import gzip
import hashlib

import pytest

from skyledger.llm import common, warc

from .conftest import collected, prose

SCHEMA = "page_id long, url string, html string, digest string, shard int"
PAGE, SHORT = prose(1, 100), "tiny"
ROWS = [
    (5, "http://a/", PAGE), (3, None, PAGE), (9, "http://b/\r\nX: y", PAGE), (None, "u", PAGE), (7, "", None), (2, "v", ""),
    (4, "v", SHORT), (1, "v", SHORT), (6, "é", prose(2, 30_000)), (3, "again", PAGE), (3, None, PAGE),
    (8, "w", "line\r\n\r\nWARC/1.1\r\n" + prose(3, 40)), (10, None, None), (11, "z", "é" * 50), (12, "z", "é" * 50),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_bytes", [1, 300, 1 << 20])
def test_round_trip(spark, file_bytes):
    folder = common.shared_dir(spark, "t-warc")
    manifest = warc.write_archives(pages(spark), folder, shard_bytes=2000, file_bytes=file_bytes)
    got = collected(warc.read_archives(manifest, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(got, key=repr) == expected(ROWS)


def test_same_rows_give_the_same_files(spark):
    def files(df):
        folder = common.shared_dir(spark, "t-warc")
        manifest = warc.write_archives(df, folder, shard_bytes=3000, file_bytes=2000)
        return sorted(collected(manifest, "file", "records", "bytes", "sha256"))

    assert files(pages(spark)) == files(pages(spark, ROWS[::-1]).repartition(5))


def test_records_are_plain_gzip_members(spark):
    folder = common.shared_dir(spark, "t-warc")
    manifest = warc.write_archives(pages(spark, ROWS[:3]), folder)
    fs, base = common.store(folder)
    with fs.open_input_file(f"{base}/{manifest.first()['file']}") as f:
        data = gzip.decompress(f.read())
    assert data.count(b"WARC/1.1\r\n") == 3 and data.count(b"\r\nX: y") == 0 and data.endswith(b"\r\n\r\n")


def test_files_outside_the_manifest_do_not_count_and_changed_ones_fail(spark):
    folder = common.shared_dir(spark, "t-warc")
    manifest = warc.write_archives(pages(spark, ROWS[:2]), folder)
    fs, base = common.store(folder)
    common.commit_file(fs, f"{base}/part-000099-00000.warc.gz", b"left by a dead attempt")
    assert warc.read_archives(manifest, folder).count() == 2
    common.commit_file(fs, f"{base}/{manifest.first()['file']}", b"cut")
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_archives(manifest, folder).collect()


def test_empty_table(spark):
    folder = common.shared_dir(spark, "t-warc")
    manifest = warc.write_archives(pages(spark, []), folder)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0
