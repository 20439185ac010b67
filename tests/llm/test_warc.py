import gzip
import hashlib
import os
import zlib

import pytest

from tallyledger.llm.warc import index_of, mark_revisits, normalise, read_records, records_of, save_archives, write_archives

BIG = "<p>é" * 60


@pytest.fixture(scope="module")
def rows():
    pages = [(k, f"http://h/{k}?q=a b", BIG if k % 3 == 0 else f"{k}" * (k * 7)) for k in range(1, 40)]
    return [*pages, (50, None, None), (51, "u\r\nWARC-Type: x", ""), (52, "", "short"), (53, "", "short"), (None, "n", BIG), (None, None, "<i>" * 99)]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int").repartition(3)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        f = first.get(h) if len(raw) >= 100 else None
        revisit = f is not None and f != i
        out.append((i is None, i or 0, u or "", len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 3000, 1 << 23])
def test_round_trip(pages, rows, size):
    stored = normalise(write_archives(mark_revisits(pages), size))
    got = read_records(stored).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None and r.page_id is not None}
    assert all(texts[i] == (h or "") for i, _, h in rows if i in texts)


def test_members_stand_alone_and_the_index_finds_them(pages):
    stored = normalise(write_archives(mark_revisits(pages), 4000))
    data = {r.archive: bytes(r.data) for r in stored.collect()}
    entries = index_of(stored).collect()
    assert len(entries) == pages.count()
    for e in entries:
        member = data[e.archive][e.at : e.at + e.length]
        (fields, record), = records_of(member)
        assert fields["warc-type"] == e.type and record == gzip.decompress(member)
    for archive, raw in data.items():
        assert sum(e.length for e in entries if e.archive == archive) == len(raw)


def test_normalising_twice_changes_nothing(pages):
    once = normalise(write_archives(mark_revisits(pages), 4000))
    assert sorted(normalise(once).collect()) == sorted(once.collect())


def test_broken_streams_are_errors():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    whole = gzip.compress(record * 3)
    assert [r for _, r in records_of(whole)] == [record] * 3
    with pytest.raises((ValueError, zlib.error)):
        list(records_of(whole[:-12]))
    with pytest.raises(ValueError):
        list(records_of(gzip.compress(record[:-6])))
    assert list(records_of(b"")) == []


def test_files(pages, tmp_path):
    stored = normalise(write_archives(mark_revisits(pages), 4000))
    saved = save_archives(stored, f"file://{tmp_path}/out").collect()
    assert sum(r.records for r in saved) == pages.count()
    for r in saved:
        lines = open(f"{r.path}.idx").read().splitlines()
        raw = open(r.path, "rb").read()
        for line in lines:
            page, kind, at, length = line.split("\t")
            assert f"WARC-Type: {kind}".encode() in gzip.decompress(raw[int(at) : int(at) + int(length)])
    assert len(os.listdir(tmp_path / "out")) == 2 * len(saved)


@pytest.mark.parametrize("url", ["http://h/a%20b", "http://h/a b", "http://h/100%", "http://h/é?q=%C3%A9", "%2520", "a\tb"])
def test_escapes_of_a_url_stay_and_every_url_comes_back(spark, url):
    stored = normalise(write_archives(mark_revisits(spark.createDataFrame([(1, url, "x")], "page_id bigint, url string, html string"))))
    row = stored.first()
    head = gzip.decompress(bytes(row.data)).split(b"\r\n\r\n")[0].decode()
    uri = next(x for x in head.split("\r\n") if x.startswith("WARC-Target-URI: ")).removeprefix("WARC-Target-URI: ")
    assert uri.isascii() and " " not in uri and "%2520" not in uri.replace(url, "")
    if url == "http://h/a%20b":
        assert uri == url
    assert read_records(stored).first().url == url


def test_a_large_record_is_read_in_linear_time():
    import time

    body = os.urandom(1 << 20) * 48
    large = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    small = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    stream = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = stream.compress(small * 3 + large + small * 3) + stream.flush()
    begin = time.process_time()
    got = [record for _, record in records_of(data)]
    assert time.process_time() - begin < 5
    assert got == [*[small] * 3, large, *[small] * 3]


def test_empty(pages):
    assert read_records(normalise(write_archives(mark_revisits(pages.limit(0))))).count() == 0
