"""Archives with revisits: written, resolved and read back."""

import base64
import gzip
import hashlib
import io
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm import queries, warc
from changeflow.session import shared_dir

SCHEMA = "page_id long, url string, html string, file string, offset int, digest string, kind int"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(rows, least=0):
    first = {}
    for key, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((html or "").encode(), key)
    out, used = [], set()
    for key, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and data in used
        used.add(data)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((key, len(data), digest, "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def pages():
    bodies = [None, "", "<p>é€😀</p>", "<p>x</p>\r\n\r\nWARC/1.1\r\n", "y" * 200_000, "a", "a\r\n"]
    rows = [(i, f"http://x/{i}", bodies[i % 7]) for i in range(40)] + [(3, "http://x/3", "own")] * 3
    rows += [(None, None, "a"), (None, None, "nobody"), (None, None, "nobody"), (99, "http://x/\r\nWARC-Type: response\x7f", "z"), (50, "u", "a")]
    return [(*r, "f", 1, "d", 2) for r in rows]


def test_given_table(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = duck.sql(queries.WARC_SQL).fetchall()
    assert found(queries.op12(spark, sf_dir)) == sorted(want, key=repr)


@pytest.mark.parametrize("least", [0, 2, 1000])
def test_awkward_pages(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    result = warc.archive_pages(df, min_bytes=least, with_payload=True).cache()
    assert found(result) == expected(rows, least)
    got = sorted(bytes(r["payload"]).decode() for r in result.filter("record_type = 'response'").collect())
    whole = {t or "" for _, _, t, *_ in rows}
    assert set(got) == whole and (least or len(got) == len(whole))
    ids = {r["record_id"] for r in result.collect()}
    assert len(ids) == len(rows)
    assert {r["refers_to_id"] for r in result.filter("record_type = 'revisit'").collect()} <= {
        r["record_id"] for r in result.filter("record_type = 'response'").collect()}


def test_files_are_plain_warc(spark):
    folder = shared_dir(spark, "warc-test")
    rows = [(1, "http://x/1", "<p>same</p>"), (2, "http://x/2", "<p>same</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(df, folder)
    again = warc.deduplicate_archives(files, T.LongType(), folder + "-new")
    name = again.first()["file"].removeprefix("file://").removeprefix("file:")
    text = gzip.GzipFile(fileobj=io.BytesIO(open(name, "rb").read())).read().decode()
    assert re.findall("WARC-Type: (.*)\r", text) == ["warcinfo", "response", "revisit"]
    assert text.count("<p>same</p>") == 1 and "WARC-Profile: " + warc.REVISIT_PROFILE in text
    refers = re.search("WARC-Refers-To: (.*)\r", text)[1]
    assert f"WARC-Record-ID: {refers}\r" in text and "WARC-Refers-To-Target-URI: http://x/1\r" in text
    for part in text.split("WARC/1.1\r\n")[1:]:
        head, _, rest = part.partition("\r\n\r\n")
        size = int(re.search(r"^Content-Length: (\d+)", head, re.M)[1])
        assert rest.encode()[size:] == b"\r\n\r\n"


def test_damage_is_seen(spark):
    block = warc.http_block(3, b"abc")
    data = gzip.decompress(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], block))
    assert warc.parse(data)[1] == block
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc", b"abd"))
    packed = warc.record([("WARC-Type", "response")], block)
    assert [m[:2] for m in warc.members(io.BytesIO(packed * 2))] == [(0, len(packed)), (len(packed), len(packed))]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed + packed[:20])))


def test_empty_and_other_keys(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("b\n", "u", "x"), ("a", "u", "x"), ("", "u", "x")], "name string, at string, body string")
    rows = warc.archive_pages(df, "name", "at", "body").select("name", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows)) == [("", "response", None), ("a", "revisit", ""), ("b\n", "revisit", "")]
    numbers = spark.range(9, 12).select(F.col("id").cast("int").alias("page_id"), F.lit("u").alias("url"), F.lit("q").alias("html"))
    assert {r["refers_to"] for r in warc.archive_pages(numbers).filter("record_type = 'revisit'").collect()} == {9}
