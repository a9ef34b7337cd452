import gzip
import glob
import hashlib

import duckdb

from tidemark.llm import warc

H = "h" * 120
ROWS = [(5, "u5", H), (3, "u3", H), (9, "u9", "é" * 60), (8, None, "é" * 60), (1, "u1", "tiny"), (2, "u2", "tiny"), (4, "u4", None), (6, "u6", ""), (7, "u\r\n7", "WARC/1.1\r\n" * 20), (3, "again", H), (None, "n", H), (None, "n2", "q" * 200), (None, "n3", "q" * 200)]


def write(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS n")
    warc.write_archive(df.repartition(4), f"{tmp_path}/a")


def test_round_trip(spark, tmp_path):
    write(spark, tmp_path)
    got = {(r.page_id, r.url): r for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    assert len(got) == len(ROWS)
    for p, url, html in ROWS:
        b = (html or "").encode()
        r = got[p, (url or "").replace("\r\n", "")]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        first = min((q for q, _, h in ROWS if (h or "") == (html or "") and q is not None), default=None)
        want = first if len(b) >= 100 and p != first else None
        assert (r.record_type, r.refers_to) == ("revisit" if want is not None else "response", want)
    stored = spark.read.parquet(f"{tmp_path}/a/payloads").collect()
    assert sorted(r.digest for r in stored) == sorted({hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in ROWS})


def test_exact_records_and_files(spark, tmp_path):
    write(spark, tmp_path)
    recs = [bytes(r.record) for r in warc.records(spark, f"{tmp_path}/a").collect()]
    assert len(recs) == len(ROWS)
    for r in recs:
        head, _, rest = r.partition(b"\r\n\r\n")
        n = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[n:] == b"\r\n\r\n"
    warc.export_warc(spark, f"{tmp_path}/a", f"{tmp_path}/w")
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.gz"))
    assert sorted(data) == sorted(b"".join(recs))


def test_damage_is_noticed(spark, tmp_path):
    write(spark, tmp_path)
    p = spark.read.parquet(f"{tmp_path}/a/payloads").selectExpr("digest", "CAST(concat(decode(payload, 'UTF-8'), '!') AS BINARY) AS payload").collect()
    spark.createDataFrame(p, "digest string, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/a/payloads")
    try:
        warc.read_archive(spark, f"{tmp_path}/a").collect()
    except Exception as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert warc.read_archive(spark, f"{tmp_path}/e").collect() == []


def test_oracle(spark, sf):
    got = sorted(map(tuple, warc.op4_warc_archive(spark, sf).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(c.execute(warc.OP4_SQL).fetchall())


def test_digests_come_from_the_records(spark, tmp_path):
    write(spark, tmp_path)
    rebuilt = warc.records(spark, f"{tmp_path}/a")
    got = sorted(warc.digests(rebuilt).collect(), key=str)
    b = lambda h: (h or "").encode()
    assert sorted((r.payload_bytes, r.payload_digest) for r in got) == sorted((len(b(h)), hashlib.sha256(b(h)).hexdigest()) for _, _, h in ROWS)
    parsed = warc.read_archive(spark, f"{tmp_path}/a").select(*got[0].__fields__).collect()
    assert sorted(map(tuple, parsed), key=str) == sorted(map(tuple, got), key=str)
    assert warc.digests(rebuilt.limit(0)).collect() == []
