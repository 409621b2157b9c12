import gzip
import re

import pytest

from tickloom.llm import warc


def test_records_link_and_keep_digests():
    page = "<html><head><title>t</title></head><body><p>Café &amp; tea</p><script>x</script><p>two</p></body></html>"
    source = warc.response(7, "http://a.example/x", page.encode())
    headers, block, end = warc.parse(source)
    assert end == len(source) and block.endswith(page.encode())
    (kind, about), (other, text) = warc.derive(source)
    assert (kind, other) == ("metadata", "conversion")
    mh, mb, _ = warc.parse(about)
    ch, cb, _ = warc.parse(text)
    assert cb.decode() == "Café & tea\ntwo"
    for h in (mh, ch):
        assert warc.field(h, "WARC-Refers-To") == warc.field(headers, "WARC-Record-ID")
        assert warc.field(h, "WARC-Target-URI") == "http://a.example/x"
    assert warc.field(ch, "WARC-Block-Digest") == warc.sha1(cb)
    assert f"source-WARC-Payload-Digest: {warc.sha1(page.encode())}" in mb.decode()
    assert f"conversion-record-id: {warc.field(ch, 'WARC-Record-ID')}" in mb.decode()
    assert warc.derive(about) == []


def test_chunks_charset_and_folding():
    body = "é".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\nTransfer-Encoding: chunked\r\n\r\n1\r\n" + body + b"\r\n0\r\n\r\n"
    record = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block)
    assert warc.parse(warc.derive(record)[1][1])[1].decode() == "é"
    with pytest.raises(ValueError, match="offset"):
        warc.parse(b"nothing")
    assert warc.parse(b"WARC/1.1\r\nA: 1\r\n 2\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[0][0] == ("A", "1 2")


def test_tables(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x", "e"), (1, "http://a/", "<p>x", "e"), (None, None, None, "e"), (2, "u", "", None), (3, "v", "y" * 300000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    made = warc.responses_of_pages(pages)
    got = warc.derivatives(made).collect()
    assert len(got) == 10 and {r.record_type for r in got} == {"metadata", "conversion"}
    assert {r.refers_to for r in got} == {r.record_id for r in made.collect()}
    for r in got:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", r.record_id)
    assert warc.derivatives(warc.responses_of_pages(spark.createDataFrame([], pages.schema))).count() == 0
    data = b"".join(bytes(r.member) for r in warc.members(made).collect())
    (tmp_path / "a.warc.gz").write_bytes(data)
    back = warc.read_records(spark, str(tmp_path / "a.warc.gz"))
    assert sorted(r.record_id for r in back.collect()) == sorted(r.record_id for r in made.collect())
    assert [h for h, _ in warc.parse_all(gzip.decompress(data))] == [h for h, _ in warc.parse_all(data)]


def _response(http: bytes) -> bytes:
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], http)


def test_broken_payloads_are_converted_up_to_the_fault(spark):
    whole = gzip.compress(b"plain text " * 5000)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n"
    cases = [
        (head + b"Transfer-Encoding: chunked\r\n\r\n3\r\nabc\r\nzz\r\nrest", "abc", "no chunk size"),
        (head + b"Transfer-Encoding: chunked\r\n\r\n9\r\nabc", "abc", "cut off"),
        (head + b"Content-Encoding: gzip\r\n\r\nnot gzip at all", "", "gzip"),
        (head + b"Content-Encoding: gzip\r\n\r\n" + whole[:100], None, "cut off"),
        (head + b"Content-Encoding: gzip\r\n\r\n" + whole, "plain text " * 5000, None),
        (b"", "", None),
    ]
    records = spark.createDataFrame([(i, "response", bytearray(_response(x))) for i, (x, _, _) in enumerate(cases)] + [(9, "response", bytearray(b"no record"))], "page_id long, record_type string, record binary")
    got = {(r.page_id, r.record_type): bytes(r.record) for r in warc.derivatives(records).collect()}
    assert len(got) == 2 * len(cases)
    for i, (_, text, fault) in enumerate(cases):
        if text is not None:
            assert warc.parse(got[i, "conversion"])[1].decode() == text
        about = warc.parse(got[i, "metadata"])[1].decode()
        assert ("http-payload-fault" in about) == bool(fault) and (not fault or fault in about)


def test_what_is_no_record_is_passed(spark, tmp_path):
    a, b = warc.response(1, "http://a/", b"<p>one"), warc.response(2, "http://b/", b"<p>two")
    (tmp_path / "x.warc").write_bytes(a + b"junk WARC/ junk\r\n" + b + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    broken = bytearray(gzip.compress(b, mtime=0))
    broken[len(broken) // 2] ^= 255
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(a, mtime=0) + bytes(broken) + gzip.compress(b, mtime=0))
    rows = warc.read_records(spark, str(tmp_path / "x.warc")).collect()
    assert [r.record_type for r in rows] == ["response", "malformed", "response", "malformed"] and rows[1].record == b"junk WARC/ junk\r\n"
    ids = [r.record_id for r in warc.read_records(spark, str(tmp_path / "y.warc.gz")).collect() if r.record_type == "response"]
    assert ids == [warc.field(warc.parse(x)[0], "WARC-Record-ID") for x in (a, b)]
