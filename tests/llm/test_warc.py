import gzip

import pytest

from evalspark.llm import warc
from evalspark.session import scratch_path
from tests.llm.conftest import sha

SCHEMA = "page_id long, url string, html string, file string, key int"


def archive(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(pages, folder, **options)
    return pages, folder, warc.Archive(captures, warc.write_index(captures, folder, 4, block_lines=3))


def rows_to_write():
    big = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "http://a.org/x", big), (3, "http://a.org/y", big), (9, "https://B.a.org:8080/z?q#f", big), (4, None, None),
            (6, "", ""), (7, "http://a.org/x", "short"), (8, "http://a.org/x", "short"), (None, "http://n.org/", big),
            (10, "http://long.org/" + "p" * 5000, "\r\n\r\nWARC/1.1\r\n" + "x" * 200_000), (11, "not a url \n at all", "\x00" + "y" * 200)]
    rows += [(100 + i, f"http://host{i % 3}.org/p{i}", f"page {i} " * 30) for i in range(40)]
    return rows


def test_round_trip(spark):
    rows = rows_to_write()
    pages, folder, made = archive(spark, rows, archive_bytes=2000)
    got = {r["page_id"]: r for r in warc.lookup(made, warc.wanted_keys(pages), folder, payload=True).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and h == html), default=page)
        again = page is not None and len(data) >= 100 and first < page
        r = got[page]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), sha(data))
        assert r["payload"] is None if again else bytes(r["payload"]) == data


def test_lookup_by_url(spark):
    pages, folder, made = archive(spark, rows_to_write())
    urls = spark.createDataFrame([("http://a.org/x",), ("HTTP://A.ORG/x",), ("http://absent.org/",), (None,)], "url string")
    wanted = warc.wanted_keys(urls, id_col=None)
    assert sorted(r["page_id"] for r in warc.lookup(made, wanted, folder).collect()) == [4, 5, 6, 7, 8]


def test_repeated_rows_are_records_of_their_own(spark):
    rows = [(1, "http://a.org/", "z" * 150), (1, "http://a.org/", "z" * 150), (2, "http://a.org/", "z" * 150),
            (2, "http://a.org/", "other" * 30), (3, "http://a.org/", "other" * 30), (3, "http://a.org/", "z" * 150)]
    pages, folder, made = archive(spark, rows)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in warc.lookup(made, warc.wanted_keys(pages), folder).collect())
    assert got == [(1, "response", 0), (1, "response", 0), (2, "response", 0), (2, "revisit", 1), (3, "revisit", 1), (3, "revisit", 2)]


def test_empty_table(spark):
    pages, folder, made = archive(spark, [])
    assert warc.lookup(made, warc.wanted_keys(pages), folder).collect() == []


def test_archives_are_plain_warc(spark):
    _, folder, made = archive(spark, [(1, "http://a.org/", "hello")])
    r = made.captures.first()
    store, base = warc.open_folder(folder)
    with store.open_input_file(f"{base}/{r['file']}") as f:
        raw = gzip.decompress(f.read_at(r["length"], r["at"]))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"hello\r\n\r\n")


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.org:80/A?b=c#d", "org,example,www)/A?b=c"), ("https://user:pw@x.org", "org,x)/"), ("", ")/"),
    (None, ")/"), ("x.org/p", "org,x)/p"), ("http://x.org?q", "org,x)/?q")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_a_damaged_record_is_noticed():
    member = warc.make_record(1, "http://a.org/", b"payload", None)
    raw = gzip.decompress(member).replace(b"payload", b"paylond")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(gzip.compress(raw))
