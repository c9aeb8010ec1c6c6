import hashlib

from pressgauge.llm import warc

S = "page_id long, url string, html string"


def run(spark, df, tmp_path, **k):
    return warc.captures(df, str(tmp_path / "a"), **k).collect()


def test_revisits_follow_the_largest_page(spark, tmp_path):
    big, other = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "y" * 2000
    rows = [(1, "http://a/ b\n", big), (2, "http://b", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", other), (None, "u", "n"), (9, "u", other), (9, "u", other), (8, "u", "z" * 1000), (8, "u", "z" * 1000)]
    got = run(spark, spark.createDataFrame(rows, S), tmp_path, with_payload=True)
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000:
            top[h] = max(i, top.get(h, 0))
    want = sorted(
        (str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in top and top[h] != i else "response", top[h] if h in top and top[h] != i else None) for i, _, h in rows
    )
    assert sorted((str(r.metadata.page_id), r.capture.payload_bytes, r.capture.payload_digest, r.capture.record_type, r.capture.refers_to) for r in got) == want
    ids = {r.capture.record_id for r in got}
    for r in got:
        if r.capture.record_type == "revisit":
            assert r.capture.refers_to_id in ids and r.capture.payload is None
        assert r.request.record_type == "request" and r.metadata.record_type == "metadata"
    assert {bytes(r.capture.payload) for r in got if r.metadata.page_id in (4, 3)} == {b"small", big.encode()}


def test_whole_table_round_trip(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = run(spark, df, tmp_path)
    want = {r.page_id: hashlib.sha1(r.html.encode()).hexdigest() for r in df.collect()}
    assert {r.metadata.page_id: r.capture.payload_digest for r in got} == want


def test_empty(spark, tmp_path):
    assert run(spark, spark.createDataFrame([], S), tmp_path) == []


def test_query_equals_sql(spark):
    from compare import both

    from pressgauge.llm import queries

    got, want = both(spark, "/root/testdata/sf0.001", queries.op5_warc, queries.ORACLES["op5_warc"])
    assert got == want
