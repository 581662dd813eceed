import io

import pytest
from tessera.llm import warc_zstd as w
from tessera.llm.common import new_path


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_bundle_seek_table_round_trip():
    import zstandard

    out = File()
    writer = w.BundleWriter(out, frame_bytes=100)
    records = [w.record(i, f"http://x/{i} \r\n", b"p" * i, "00" * 20, None, "revisit") for i in range(40)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = w.BundleReader(out)
    for r, (frame, offset, length) in zip(records, places, strict=True):
        assert reader.frame(frame)[offset : offset + length] == r
    out.seek(0)
    whole = zstandard.ZstdDecompressor().stream_reader(out, read_across_frames=True).read()
    assert whole == b"".join(records)
    assert out.getvalue()[-4:] == bytes.fromhex("b1ea928f")


def test_round_trip_matches_brute_force(spark):
    import hashlib

    big, other = "é<p>\r\n\r\nbody" * 200, "z" * 1000
    rows = [(1, "http://a", big), (5, None, big), (3, "u", big), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", other), (9, "u", "z" * 999), (10, "u", "z" * 999), (None, "u", other), (5, None, big)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    got = sorted(map(tuple, w.round_trip(df).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        many = len(data) >= 1000 and sum((h or "") == (html or "") for _, _, h in rows) > 1
        revisit = many and page != max(same)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_lookup_seeks_and_follows_revisits(spark):
    df = spark.createDataFrame([(i, "u", "x" * 1500 if i % 2 else f"page {i}") for i in range(30)], "page_id long, url string, html string")
    out = new_path(spark, "warc-test")
    index = w.write(df, out)
    got = {r.page_id: bytes(r.payload).decode() for r in w.lookup(index, spark.createDataFrame([(3,), (4,), (29,), (77,)], "page_id long"), out).collect()}
    assert got == {3: "x" * 1500, 4: "page 4", 29: "x" * 1500}


def test_empty_table(spark):
    assert w.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_payload_is_refused():
    data = w.record(1, None, b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None, "response")
    head, block, end = w.parse(data)
    assert end == len(data) and w.content(head, block)[3] == b"abc"
    with pytest.raises(ValueError):
        w.content(head, block[:-1] + b"x")
