import hashlib

import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import warc


def brute(rows):
    first = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if i is not None:
            first[payload] = min(first.get(payload, i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and i != first.get(payload)
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first.get(payload) if revisit else None))
    return sorted(out, key=str)


ODD = [(1, "u", "x" * 100), (2, "u\r\nX: y", "x" * 100), (3, None, "x" * 99), (4, "", "x" * 99), (5, "u", None), (6, "é", "é" * 50), (7, "é", "é" * 50), (7, "é", "é" * 50), (None, None, "x" * 100), (9, "u", "")]


def test_records_match_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "url", "html")
    pages = pages.unionByName(spark.createDataFrame(ODD, "page_id long, url string, html string"))
    records = warc.read_archive(*warc.write_archive(pages))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=str)
    assert got == brute([tuple(r) for r in pages.collect()])


def test_round_trip_and_record_bytes(spark):
    pages = spark.createDataFrame([r for r in ODD if r[0] is not None], "page_id long, url string, html string")
    payloads, headers = warc.write_archive(pages)
    assert payloads.count() == len({(r[2] or "") for r in ODD})
    records = warc.read_archive(payloads, headers)
    want = sorted((i, (h or "").encode()) for i, _, h in ODD if i is not None)
    assert sorted((r.page_id, bytes(r.payload)) for r in records.collect()) == want
    for r in warc.record_bytes(records).collect():
        raw = bytes(r.record)
        head, body = raw.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert raw.startswith(b"WARC/1.1\r\n") and len(body) - 4 == int(fields["Content-Length"])


def parsed(raw):
    """One record by the format's grammar, read without the library."""
    version, _, rest = raw.partition(b"\r\n")
    assert version == b"WARC/1.1"
    fields = {}
    while True:
        line, _, rest = rest.partition(b"\r\n")
        if not line:
            break
        name, colon, value = line.partition(b":")
        assert colon and name.decode("ascii").replace("-", "").isalnum()
        fields[name.decode().lower()] = value.strip().decode()
    size = int(fields["content-length"])
    assert rest[size:] == b"\r\n\r\n"
    return fields, rest[:size]


def test_an_independent_reader_finds_the_mandatory_fields(spark):
    import http.client
    import io
    import re

    urls = [*ODD, (11, "http://a.b/" + "c" * 20_000 + "\tz", "y" * 200), (11, "http://a.b/" + "c" * 20_000 + "\tz", "y" * 200)]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    records = warc.read_archive(*warc.write_archive(pages))
    assert sorted((r.page_id, r.url) for r in records.where("page_id is not null").collect()) == sorted((i, u or "") for i, u, _ in urls if i is not None)
    seen = set()
    for r in warc.record_bytes(records).collect():
        fields, block = parsed(bytes(r.record))
        assert {"warc-record-id", "content-length", "warc-date", "warc-type", "content-type", "warc-target-uri"} <= set(fields)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"]) and re.fullmatch(r"<[a-z]+:\S+>", fields["warc-record-id"])
        seen.add(fields["warc-record-id"])
        status, head = block.split(b"\r\n", 1)
        assert status == b"HTTP/1.1 200 OK" and fields["content-type"] == "application/http; msgtype=response"
        message = io.BytesIO(head)
        length = int(http.client.parse_headers(message)["Content-Length"])
        payload = message.read()
        if fields["warc-type"] == "revisit":
            assert payload == b"" and length >= 100 and "warc-profile" in fields and "warc-refers-to-date" in fields
        else:
            assert length == len(payload) and fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert len(seen) == len(urls)


def test_damage_is_noticed_and_empty_is_empty(spark):
    pages = spark.createDataFrame(ODD[:2], "page_id long, url string, html string")
    payloads, headers = warc.write_archive(pages)
    with pytest.raises(Exception, match="payload damaged"):
        warc.read_archive(payloads.withColumn("payload", F.lit(b"other")), headers).collect()
    assert warc.read_archive(*warc.write_archive(pages.limit(0))).count() == 0
