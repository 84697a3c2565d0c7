from __future__ import annotations

import hashlib

from compare import compare, connect
from pyarrow import fs

from panelwright.llm import warc
from panelwright.llm.queries import PLANS, SQL


def test_round_trip_and_random_access(spark, monkeypatch):
    copy = "<html>" + "copy é " * 40 + "</html>"
    rows = [(7, "http://a/1", copy), (3, "http://a/2", copy), (9, None, copy), (4, "http://b\r\n/x", None),
            (5, "u", ""), (6, "u", "short"), (8, "u", "short"), (None, "u", copy), (3, "http://a/2", copy),
            (10, "u", "WARC/1.1\r\n\r\n" * 500), (11, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'z' as digest", "1 as bundle")
    index = warc.write_bundles(df)
    got = sorted(map(tuple, warc.read_bundles(spark, index).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == copy and page != 3
        want.append((page, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    texts = {page: html for page, _, html in rows}
    for r in index.collect():
        record = warc.read_record(r.bundle, r.frame, r.offset)
        assert record["page"] == (None if r.page_id is None else str(r.page_id))
        if record["kind"] == "response":
            assert record["payload"] == (texts[r.page_id] or "").encode()
        else:
            assert record["refers_to"] == "3"
    empty = warc.write_bundles(df.limit(0))
    assert empty.count() == 0 and warc.read_bundles(spark, empty).count() == 0


def test_frames_stand_alone_and_the_table_is_a_skippable_frame(tmp_path):
    files = fs.LocalFileSystem()
    path = str(tmp_path / "one.warc.zst")
    writer = warc.BundleWriter(files, path)
    records = [warc.record_bytes(i, "u", b"p" * 300_000, hashlib.sha256(b"p" * 300_000).hexdigest(), None)
               for i in range(10)]
    places = [writer.add(r) for r in records]
    writer.close()
    with files.open_input_file(path) as file:
        table = warc.seek_table(file)
        assert len(table) == places[-1][0] + 1 > 1
        frames = [warc.read_frame(file, p) for p in table]
    assert b"".join(frames) == b"".join(records)
    for (frame, offset), record in zip(places, records):
        assert frames[frame][offset : offset + len(record)] == record
    # any Zstandard reader sees the same stream, the table being a skippable frame
    import zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole == b"".join(records)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    difference, _ = compare(spark, connect(sf), PLANS["op5_warc"], SQL["op5_warc"], sf)
    assert difference is None, difference
