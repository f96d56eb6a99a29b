"""The archive against a plain count of payloads, its records, and damage."""

import base64
import hashlib

import pytest
from check_queries import compare, connect
from pyspark.errors import PythonException

import __spark_entry__ as entry
from normlens.llm import warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, payload string, size int"
ROWS = [(1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"),
        (2, "http://a/2", "own é"), (7, None, None), (8, "http://a/8", ""), (9, "http://a b\r\nX: y", "x\r\n\r\nWARC/1.1 y" * 900),
        (None, "http://n", "<p>same</p>"), (None, "http://n", "only null"), (None, "http://m", "only null"),
        (4, "http://r", "again"), (4, "http://r", "again")]


def expected(rows, least=0):
    largest = {}
    for i, _, html in rows:
        known = largest.get(html or "")
        largest[html or ""] = max((x for x in (known, i) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        response = len(data) < least or i == largest[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if response else "revisit", None if response else largest[html or ""]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 6, 100])
def test_records(spark, least):
    folder = warc.new_folder(spark)
    pages = spark.createDataFrame([(*r, "old", "old", 1) for r in ROWS], SCHEMA)
    warc.write(pages.repartition(3), folder, least)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()]
    assert sorted(got, key=repr) == expected(ROWS, least)
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == len({r[2] or "" for r in ROWS})


def test_rebuilt_records_are_a_file(spark):
    folder = warc.new_folder(spark)
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), folder)
    data = b"".join(r.record for r in warc.records(spark, folder).collect())
    parsed = list(warc.parse(data))
    assert len(parsed) == len(ROWS)
    by_id = {f["warc-record-id"]: (f, block) for f, block in parsed}
    fields, block = by_id["<urn:page:9>"]
    assert fields["warc-target-uri"] == "http://a%20b%0D%0AX:%20y"
    assert block.endswith(ROWS[6][2].encode()) and len(block) == int(fields["content-length"])
    revisit, block = by_id["<urn:page:1>"]
    assert revisit["warc-refers-to"] == "<urn:page:5>" and block.endswith(b"\r\n\r\n") and b"same" not in block


def test_a_damaged_payload_raises(spark):
    folder, other = warc.new_folder(spark), warc.new_folder(spark)
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), folder)
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    (spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "payload_digest", "size", "response_id",
                                                         "cast('changed' AS binary) AS payload")
     .write.parquet(f"{other}/payloads"))
    with pytest.raises(PythonException, match="damaged"):
        warc.read(spark, other).collect()


def test_empty_table(spark):
    folder = warc.new_folder(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_query_agrees_with_sql_and_plain_digests(spark):
    made = entry.queries()["op13_warc"](spark, SF)
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in made.collect()]
    assert sorted(got, key=repr) == expected([tuple(r) for r in rows])
    assert compare(made, connect(SF), entry.oracle_sql()["op13_warc"]).startswith("ok")
