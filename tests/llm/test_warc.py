"""Archives: written, read back, revisits resolved; edge cases."""

import hashlib

from corvex.llm import store, warc


def archive(spark, rows, **options):
    path = store.fresh(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    manifest = warc.write(pages, path, **options)
    return path, manifest, {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(manifest, path).collect()}


def test_revisits(spark):
    rows = [(3, "http://a", "x", ""), (1, "http://b", "x", ""), (2, None, "x", ""), (4, "u", None, ""), (5, "u\r\nv", "", ""), (6, "u", "é\r\n\r\nWARC/1.1", "")]
    path, manifest, got = archive(spark, rows)
    assert got == {(1, 1, "response", None), (2, 1, "revisit", 1), (3, 1, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4), (6, 14, "response", None)}
    system, folder = warc._target(path)
    heads = []
    for r in manifest.collect():
        with system.open_input_stream(f"{folder}/{r.file}", compression=None) as stream:
            heads += [(h, b) for h, b in warc.records(stream, 7)]
    ids = {h["WARC-Record-ID"]: h for h, _ in heads}
    assert len(ids) == 6
    for h, body in heads:
        if h["WARC-Type"] == "revisit":
            target = ids[h["WARC-Refers-To"]]
            assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and body == b""
            assert h.get("WARC-Refers-To-Target-URI") == target.get("WARC-Target-URI")
    assert warc.base32_digest(b"x") == __import__("base64").b32encode(hashlib.sha1(b"x").digest()).decode()


def test_ties_nulls_and_small_payloads(spark):
    rows = [(1, "a", "x", ""), (1, "a", "x", ""), (None, "n", "x", ""), (None, None, "y", ""), (None, None, "y", ""), (7, "s", "x", "")]
    _, _, got = archive(spark, rows)
    assert got == {(1, 1, "response", None), (None, 1, "revisit", 1), (None, 1, "response", None), (7, 1, "revisit", 1)}
    assert {x[2] for x in archive(spark, rows, min_bytes=2)[2]} == {"response"}
    assert archive(spark, rows[:0])[2] == set()
