"""Archives of others, payloads passed over, predicates pushed."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from placewise.llm import warc


def _record(kind, headers, block, version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
RECORDS = [
    (_record("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"), b"software: x\r\n"),
    (_record("response", ["content-type: text/dns"], b"1 2 3"), b"1 2 3"),
    (_record("response", ["CONTENT-TYPE: application/http; msgtype=response"], HTTP + b"body\r\n\r\nmore"), b"body\r\n\r\nmore"),
    (_record("response", ["Content-Type: application/http"], b"HTTP/1.1 204 None"), b""),
    (_record("request", ["Content-Type: application/http; msgtype=request"], b"POST / HTTP/1.1\r\n\r\nq=1"), b"q=1"),
    (_record("resource", [], b"\r\n\r\nraw"), b"\r\n\r\nraw"),
    (_record("metadata", ["WARC-Concurrent-To: <a>", "warc-concurrent-to: <b>", "X-Long: one", "  two"], b""), b""),
    (_record("conversion", ["Content-Type: text/plain"], "ñ".encode()), "ñ".encode()),
    (_record("revisit", ["Content-Type: application/http"], HTTP), None),
]


@pytest.mark.parametrize("form", ["plain", "members", "one member"])
@pytest.mark.parametrize("block", [7, 1 << 20])
def test_all_record_types(form, block):
    parts = [r for r, _ in RECORDS]
    data = {"plain": b"".join(parts), "members": b"".join(map(gzip.compress, parts)), "one member": gzip.compress(b"".join(parts))}[form]
    got = list(warc.read_records(io.BytesIO(data), block=block))
    assert [b for _, b in got] == [b for _, b in RECORDS]
    assert got[6][0].get("WARC-CONCURRENT-TO") == "<a>, <b>" and got[6][0].get("x-long") == "one two"
    heads = [h.get("warc-type") for h, b in warc.read_records(io.BytesIO(data), payload=False, block=block)]
    assert heads == [h.get("WARC-Type") for h, _ in got]
    for cut in (1, 5, len(data) // 2):
        with pytest.raises((ValueError, EOFError)):
            list(warc.read_records(io.BytesIO(data[: len(data) - cut]), block=block))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n")))


def test_unwanted_payloads_are_passed_over():
    import os

    records = [warc.record(i, "u", os.urandom(3_000_000), "S", None, False) for i in range(4)]
    for data in (b"".join(map(warc.member, records)), b"".join(records)):
        n = []
        got = [(h.get(warc.PAGE_ID), len(b)) for h, b in warc.read_records(io.BytesIO(data), lambda h: h.get(warc.PAGE_ID) != "2", block=4096, on_read=n.append)]
        assert got == [("2", 3_000_000)]
        assert sum(n) < 3_100_000  # one payload of four
        n.clear()
        assert len(list(warc.read_records(io.BytesIO(data), payload=False, block=4096, on_read=n.append))) == 4
        assert sum(n) < 100_000
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(data[:-10]), lambda h: True, block=4096))
    assert gzip.decompress(warc.member(b"some data")) == b"some data"


def test_predicates_reach_the_reader(spark, tmp_path):
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(r for r, _ in RECORDS) + warc.record(9, "http://a/b", b"12345", "S" * 32, None, False))
    every = warc.read(spark, [str(path)])
    asked = [
        (F.col("record_type") == "response") & (F.col("page_id") == "9"),
        F.col("record_type").isin("response", "x") & F.col("target_uri").startswith("http://a"),
        (F.col("payload_bytes") >= 5) & F.col("target_uri").isNotNull(),
    ]
    for where in asked:
        rows = every.filter(where)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Filter " not in plan and "PushedFilters: []" not in plan  # the source answers all of it
        assert [bytes(r.payload) for r in rows.collect()] == [b"12345"]
    assert every.filter(F.col("headers")["A"] == "x").count() == 0
    assert warc.read(spark, [str(path)], require={"warc-type": ["request", "resource"]}).count() == 2
    assert {r.record_type for r in every.collect()} >= {"request", "resource", "metadata", "conversion", "warcinfo"}
