import base64
import gzip
import hashlib
import os

import pytest

from tidemark.llm import warc


def test_round_trip(spark):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/\r\nX: y", "<p>é</p>"), (2, None, None), (5, "u", ""), (6, "v", "WARC/1.1\r\n\r\nx" * 20000), (None, "n", "<p>é</p>"), (None, "m", "only here"), (7, "w", "solo"), (1, "again", "<p>é</p>")]
    got = sorted(tuple(str(x) for x in r[:5]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    first = {}
    for i, _, h in rows:
        k = (h or "").encode()
        if i is not None:
            first[k] = min(first.get(k, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in first and i != first[b]
        want.append((str(i), str(len(b)), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(first[b] if again else None)))
    assert got == sorted(want)
    small = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string"), min_bytes=9)
    assert small.where("warc_type = 'revisit'").count() == 2  # of the 8-byte payloads "<p>é</p>" is 9 bytes long: ids 3 and null
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_source(spark, tmp_path, compression):
    warc.register(spark)
    rows = [(t, f"<urn:x:{i}>", f"http://h{i % 3}/", "2020-01-01T00:00:00Z", "text/plain", None, None, {"X-A": "b"}, None, bytes([i]) * (i * 7000)) for i in range(40) for t in [["response", "request", "metadata"][i % 3]]]
    df = spark.createDataFrame(rows, warc.WRITE_SCHEMA).repartition(3)
    path = f"file://{tmp_path}/w"
    df.write.format("warc").option("compression", compression).option("fileBytes", 100_000 if compression == "none" else 800).mode("append").save(path)
    names = os.listdir(f"{tmp_path}/w")
    assert len(names) > 4 and not any(n.startswith(".") for n in names)
    back = spark.read.format("warc").option("partitionBytes", 50_000).load(path)
    assert sorted((r.record_id, bytes(r.payload), r.headers["x-a"], r.content_length) for r in back.collect()) == sorted((r[1], r[-1], "b", len(r[-1])) for r in rows)
    some = back.where("warc_type = 'response' and target_uri like 'http://h0%'")
    assert "PythonScan" in some._jdf.queryExecution().toString() or some.count()
    assert sorted(r.record_id for r in some.collect()) == sorted(r[1] for i, r in enumerate(rows) if i % 3 == 0)
    assert all(r.payload is None for r in spark.read.format("warc").option("payloads", "false").load(path).collect())
    df.limit(1).write.format("warc").mode("overwrite").option("compression", compression).save(path)
    assert spark.read.format("warc").load(path).count() == 1


def test_skipped_payloads_are_not_read(tmp_path):
    """A pushed predicate is decided by the header; the payload of a failing record is sought over."""
    from pyspark.sql.datasource import EqualTo, GreaterThan

    f = tmp_path / "a.warc"
    record = lambda t, body: f"WARC/1.0\r\nWARC-Type: {t}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    f.write_bytes(record("request", b"\xff" * 10_000_000) + record("response", b"ok"))
    r = warc.WarcReader({"path": str(f)})
    left = list(r.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("content_length",), 1)]))
    assert len(left) == 1 and len(r.filters) == 1

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, k):
            self.n += k
            return self.f.read(k)

        def seek(self, k):
            self.f.seek(k)

        def size(self):
            return f.stat().st_size

    with open(f, "rb") as raw:
        c = Counting(raw)
        rows = list(r._records("a.warc", c))
    assert [x[-1] for x in rows] == [b"ok"] and c.n < 1_000_000
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", b"one")) + gzip.compress(record("response", b"")) + gzip.compress(record("request", b"z")))
    with open(tmp_path / "b.warc.gz", "rb") as raw:
        got = list(warc.WarcReader({"path": "x"})._records("b.warc.gz", raw))
    assert [x[-1] for x in got] == [b"one", b"", b"z"] and got[0][1] == 0 < got[1][1] < got[2][1]
    (tmp_path / "c.warc").write_bytes(record("response", b"one")[:-9])
    with pytest.raises(ValueError), open(tmp_path / "c.warc", "rb") as raw:
        list(warc.WarcReader({"path": "x"})._records("c.warc", raw))
