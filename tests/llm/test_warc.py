import hashlib

import pytest

from rowforge.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int, digest string")


def expected(rows):
    out, groups = [], {}
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page_id is not None:
            groups[body] = min(page_id, groups.get(body, page_id))
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        first = groups.get(body) if len(body) >= 100 and sum((r[2] or "").encode() == body for r in rows) > 1 else None
        refers = first if first is not None and first != page_id else None
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    long, near = "é" * 50, "x" * 99
    rows = [(7, "http://a/ü?q=1", long, 1, "d"), (3, None, long, 1, "d"), (3, "u", long, 1, "d"), (None, "u\r\nX: y", long, 1, "d"), (9, "u", near, 1, "d"), (8, "u", near, None, None)]
    rows += [(20, "u", None, 1, "d"), (21, "u", "", 1, "d"), (22, "u", "WARC/1.1\r\n\r\n" * 40, 1, "d"), (23, "u", "y" * 3_000_000, 1, "d"), (24, "u", "y" * 3_000_000, 1, "d")]
    index, folder = warc.archive(spark, pages(spark, rows))
    got = [tuple(r) for r in warc.read_bundles(index, folder).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_empty(spark):
    index, folder = warc.archive(spark, pages(spark, []))
    assert warc.read_bundles(index, folder).count() == 0


def test_one_record_by_index(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 200, 0, "") for k in range(50)]
    folder = warc.shared_folder(spark, "test")
    index = warc.write_bundles(warc.plan_records(pages(spark, rows)), folder, frame_bytes=5000, bundle_bytes=2000)
    found = index.collect()
    assert len({r.bundle for r in found}) > 1 and max(r.frame for r in found) > 0
    for r in found:
        head, block, end = warc.parse(warc.BundleReader(folder, r.bundle).record(r.frame, r.offset, r.length))
        assert head["WARC-Target-URI"] == f"http://h/{r.page_id}" and block.endswith(f"<p>{r.page_id}</p>".encode()) and end == r.length


def test_damage_is_found(spark, tmp_path):
    import pyarrow.fs

    files = pyarrow.fs.LocalFileSystem()
    w = warc.BundleWriter(files, str(tmp_path / "b"), 100)
    w.add(b"x" * 90), w.add(b"y" * 90)
    w.close()
    data = bytearray((tmp_path / "b").read_bytes())
    data[12] ^= 255
    (tmp_path / "b").write_bytes(data)
    with pytest.raises(Exception):
        warc.BundleReader(f"file://{tmp_path}", "b").frame(0)
