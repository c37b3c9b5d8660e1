import hashlib

import pytest

from voxhive.llm import warc

FAKE = (
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Type: text/html; charset=utf-8\r\n"
    "Content-Length: 5\r\n\r\nhello\r\n\r\n"
)
HTML = [
    (1, "http://a/1", "x" * 150), (2, "http://a/2", "x" * 150), (3, None, "short"), (4, "http://a\r\n/4", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", f"<p>{FAKE}{FAKE}</p>"), (8, "u", FAKE), (9, "u", f"{FAKE}"),
    (10, "u", "WARC/1.0\r\n" * 30), (11, "u", "äöü日本" * 60), (None, "u", "x" * 150), (0, "u", "y" * 120), (0, "u", "y" * 120),
    (12, "u", "tail WARC/1.0\r\n"), (13, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"),
]


def expected():
    heads = {}
    for i, _, h in HTML:
        if i is not None:
            heads[h] = min(i, heads.get(h, i))
    out = []
    for i, _, h in HTML:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i > heads[h]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", heads[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["128m", "333b", "64b"])
def test_round_trip_with_magic_in_payloads(spark, split):
    pages = spark.createDataFrame(HTML, "page_id long, url string, html string").coalesce(1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = warc.shared_path(spark, "warc-test")
    warc.write_archives(pages, path, records_per_file=9)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.resolved(warc.read_archives(spark, path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=repr) == expected()


def test_shuffled_heads_give_the_same_records(spark, monkeypatch):
    pages = spark.createDataFrame(HTML, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "HEADS_LIMIT", 0)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == expected()


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest string")
    assert warc.round_trip(pages).count() == 0


def test_pointer_jumping_keeps_only_the_chain(spark):
    rows = [("f", 0, 30), ("f", 10, 30), ("f", 30, 50), ("f", 40, 30), ("f", 50, 90), ("g", 0, None), ("g", 7, 0)]
    table = spark.createDataFrame(rows, "file string, offset long, successor long")
    assert sorted(map(tuple, warc.reachable(table).collect())) == [("f", 0), ("f", 30), ("f", 50), ("g", 0)]
