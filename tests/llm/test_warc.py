import hashlib

import pytest

from scorewatch.llm import warc
from scorewatch.session import fresh_dir

LONG = "x" * 999 + "é"
FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\n"
        "Content-Length: 5\r\n\r\nhello\r\n\r\n")


def read(spark, rows, schema="page_id long, url string, html string"):
    path = fresh_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, schema).repartition(3), path)
    return path, warc.with_originals(warc.records(spark, path)).collect()


def by_id(got):
    return {r.record_id: r for r in got}


def test_magic_inside_payloads_is_rejected(spark):
    rows = [(1, "http://a/", FAKE * 3), (2, None, "before" + FAKE + "WARC/1."), (3, "u\r\nv", "plain"),
            (4, "http://a/", "WARC/1.WARC/1.0\r\nno header"), (5, "http://b/", None), (6, "http://b/", "")]
    rows += [(i, f"http://c/{i}", f"{FAKE}{i}") for i in range(10, 60)]
    _, got = read(spark, rows)
    assert len(got) == len(rows)
    found = by_id(got)
    for i, _, html in rows:
        body = (html or "").encode()
        r = found[f"<urn:page:{i}>"]
        assert (r.type, r.length, r.digest) == ("response", len(body), hashlib.sha1(body).hexdigest())


def test_revisits_refer_to_the_largest_id(spark):
    rows = [(i, "http://a/", LONG) for i in (3, 9, 5)] + [(1, "http://a/", "s" * 999)] * 2
    rows += [(None, "http://a/", LONG), (9, "http://a/", LONG), (None, None, "y" * 2000), (None, None, "y" * 2000)]
    path, got = read(spark, rows)
    kinds = sorted((r.record_id, r.type, r.refers_to or "") for r in got)
    assert kinds == sorted(
        [(f"<urn:page:{i}>", "revisit", "<urn:page:9>") for i in (3, 5, "none")]
        + [("<urn:page:9>", "response", "")] * 2 + [("<urn:page:1>", "response", "")] * 2
        + [("<urn:page:none>", "response", "")] * 2)
    sha = hashlib.sha1(LONG.encode()).hexdigest()
    assert all(r.digest == sha and r.length == 1001 for r in got if r.type == "revisit")
    archived = spark.read.text(path, wholetext=True)
    assert sum(LONG in r.value for r in archived.collect()) >= 1


def test_records_across_byte_ranges(spark):
    rows = [(i, "http://a/", ("z" * (i % 700)) + FAKE * (i % 3)) for i in range(300)]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        path, got = read(spark, rows)
    finally:
        spark.conf.set(key, before)
    assert len(got) == 300
    assert {r.record_id: r.digest for r in got} == {
        f"<urn:page:{i}>": hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}


def test_empty_table_and_clashing_columns(spark):
    _, got = read(spark, [])
    assert got == []
    _, got = read(spark, [(1, "u", "h", 7, "x", "y")],
                  "page_id long, url string, html string, digest int, keep string, value string")
    assert [r.record_id for r in got] == ["<urn:page:1>"]


@pytest.mark.parametrize("cut", [10, 3])
def test_truncated_archive_ends_at_last_whole_record(spark, cut):
    path = fresh_dir(spark, "warc-cut")
    text = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n"
                   f"Content-Length: 9\r\n\r\nsome text\r\n\r\n" for i in range(5))[:-cut]
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    got = warc.records(spark, path).collect()
    assert len(got) == (4 if cut == 10 else 5)


def test_magic_inside_a_url(spark):
    rows = [(i, f"http://a/{i}", f"page {i}") for i in range(30)]
    rows[9:9] = [(100, "http://a/WARC/1.0/x?WARC/1.1", "odd"), (101, "http://b/WARC/1.", FAKE),
                 (102, "http://a/\u2028Content-Length: 1\u2028", "line separators")]
    path = fresh_dir(spark, "warc-url")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = by_id(warc.records(spark, path).collect())
    assert {i: (r.length, r.digest) for i, r in got.items()} == {
        f"<urn:page:{i}>": (len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}


@pytest.mark.parametrize("part", ["4k", "200b"])
def test_magic_inside_headers_of_other_writers(spark, part):
    def record(i, html, *more):
        head = ["WARC/1.0", *more[:1], "WARC-Type: response", f"WARC-Record-ID: <urn:WARC/1.{i}>",
                f"Content-Length: {len(html)}", *more[1:]]
        return "\r\n".join(head) + "\r\n\r\n" + html + "\r\n\r\n"

    html = {i: f"WARC/1.1\r\nContent-Length: 1\r\nno end {i}" if i % 5 == 1 else f"page {i}" for i in range(40)}
    odd = "WARC-Target-URI: http://a/WARC/1.0/" + "y" * 300 + "WARC/1.Content-Length: 3"
    path = fresh_dir(spark, "warc-foreign")
    text = "".join(record(i, html[i], *[[odd], ["X: 1", odd], ["X: 1"], [odd, odd]][i % 4]) for i in html)
    spark.createDataFrame([(text[:-4],)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, part)
    try:
        got = by_id(warc.records(spark, path).collect())
    finally:
        spark.conf.set(key, before)
    assert {i: r.digest for i, r in got.items()} == {
        f"<urn:WARC/1.{i}>": hashlib.sha1(h.encode()).hexdigest() for i, h in html.items()}
    assert {r.type for r in got.values()} == {"response"}


def test_headers_of_any_length(spark):
    rows = [(i, f"http://a/{i}", f"page {i}") for i in range(20)]
    rows[7:7] = [(100, "http://a/" + "u" * 70_000, "long"), (101, "http://a/" + "WARC/1.0/é" * 20_000, LONG)]
    path = fresh_dir(spark, "warc-long")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = by_id(warc.records(spark, path).collect())
    assert {i: r.digest for i, r in got.items()} == {
        f"<urn:page:{i}>": hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows}


def test_broken_chain_is_seen(spark):
    path = fresh_dir(spark, "warc-broken")
    text = "".join(f"WARC/1.1\r\nContent-Length: {n}\r\n\r\nsome text\r\n\r\n" for n in (9, 9, 8, 9))
    spark.createDataFrame([(text[:-4],)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.warns(UserWarning, match="end of the file"):
        assert warc.records(spark, path).count() == 3
    with pytest.raises(ValueError, match="end of the file"):
        warc.records(spark, path, whole_files=True)
