import hashlib
import io

import zstandard

from historymine.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, sha1 int"
BIG = "<p>" + "words and é " * 200


def rows_of(pages):
    return [
        (1, "http://a/x y", BIG, "clash", 0), (5, None, BIG, None, 1), (3, "http://b", BIG, "", 2), (4, "u", "small", "", 2), (6, "u", "small", "", 2),
        (7, "", None, None, None), (8, "u", "", None, None), (None, "u", BIG, None, None), (5, "again", BIG, None, None),
        (9, "long", "<div>x</div>\r\n\r\n" * 60_000, None, None), (10, "\r\nbad: 1", BIG + "!", None, None),
    ]


def test_round_trip(spark):
    rows = rows_of(None)
    got = warc.archive(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        same = max(r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None)
        revisit = len(payload) >= 1000 and page_id is not None and page_id != same
        expected.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", same if revisit else None, None if revisit else payload))
    pick = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or (None if r.payload is None else b"")) for r in got]
    assert sorted(pick, key=repr) == sorted(expected, key=repr)
    assert {r.url for r in got if r.page_id in (1, 7, 10)} == {"http://a/x%20y", "urn:unknown", "%0D%0Abad:%201"}


def test_file_layout(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archives(spark.createDataFrame([(i, "u", f"{BIG} {i}") for i in range(300)], "page_id bigint, url string, html string"), path)
    files = sorted((tmp_path / "archive").glob("part-*"))
    assert files
    for file in files:
        content = file.read_bytes()
        found = list(warc.frames(content))
        assert found[0][0] == warc.DICTIONARY_MAGIC and found[-1][2] == len(content)
        dictionary = zstandard.ZstdCompressionDict(content[8 : found[0][2]])
        # any reader gets all records from the file with that dictionary
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content), read_across_frames=True)
        assert stream.read().count(b"WARC/1.1\r\n") == sum(f[0] == warc.FRAME_MAGIC for f in found)
        alone = [f for f in found if f[0] == warc.FRAME_MAGIC][-1]
        assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(content[alone[1] : alone[2]]).startswith(b"WARC/1.1")


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []
