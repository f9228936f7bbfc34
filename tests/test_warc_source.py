"""The archive source: split files, broken members, plain files, columns, filters and commits."""

import gzip
import os

import pytest

from lexloom.sources.warc import Piece, WarcReader, files_of, read_warc, record, write_warc

TYPES = "type string, uri string, block binary"


@pytest.fixture
def rows():
    blocks = [b"", b"\x1f\x8b\x08 not a member", b"WARC/1.1\r\nfake: head\r\n\r\nbody", os.urandom(200_000), "é\r\n\r\n".encode()]
    return [(["response", "revisit", None][i % 3], f"https://h/{i}", blocks[i % len(blocks)]) for i in range(60)]


def test_split_files_give_every_record_once(spark, tmp_path, rows):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(rows, TYPES).repartition(2), path)
    assert len(files_of(path)) == 2 and not (tmp_path / "w" / "_temporary" / "x").exists()
    want = sorted((t or "resource", u, len(b), b) for t, u, b in rows)
    for split in (1 << 10, 50_000, 1 << 30):
        df = read_warc(spark, path, split_bytes=split)
        assert df.rdd.getNumPartitions() == sum(-(-size // split) for _, size in files_of(path))
        got = df.collect()
        assert sorted((r.type, r.uri, r.length, bytes(r.block)) for r in got) == want
        assert all(r.digest.startswith("sha1:") and r.date == "1970-01-01T00:00:00Z" and r.refers_to is None for r in got)
    few = read_warc(spark, path, "uri string, type string", 50_000).where("type = 'revisit'")
    assert few.columns == ["uri", "type"] and few.count() == 20
    reader = WarcReader({"path": path}, None)
    assert list(reader.pushFilters([])) == []


def test_modes_of_writing(spark, tmp_path, rows):
    path, df = f"{tmp_path}/w", spark.createDataFrame(rows[:7], TYPES).coalesce(1)
    for mode, n in (("append", 7), ("append", 14), ("overwrite", 7)):
        write_warc(df, path, mode)
        assert read_warc(spark, path).count() == n
    write_warc(df.limit(0), path)
    assert read_warc(spark, path).count() == 7
    bad = df.selectExpr("type", "uri", "if(uri like '%5', raise_error('no'), block) as block")
    with pytest.raises(Exception, match="no"):
        write_warc(bad, path)
    assert read_warc(spark, path).count() == 7 and not os.path.exists(f"{path}/_temporary/x")


def test_broken_and_plain_files(spark, tmp_path):
    one, two, three = (record({"type": "response", "uri": u, "block": b"x" * n}) for u, n in (("a", 10), ("b", 50_000), ("c", 0)))
    whole = gzip.compress(one) + gzip.compress(two)[:-20] + gzip.compress(three)
    (tmp_path / "broken.warc.gz").write_bytes(whole + gzip.compress(one)[:30])
    got = {r.uri for r in read_warc(spark, f"{tmp_path}/broken.warc.gz").collect()}
    assert got >= {"a"}
    (tmp_path / "plain.warc").write_bytes(one + two + three)
    got = [(r.uri, r.length) for r in read_warc(spark, f"{tmp_path}/plain.warc").collect()]
    assert got == [("a", 10), ("b", 50_000), ("c", 0)]
    (tmp_path / "empty").mkdir()
    assert read_warc(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="nothing-here"):
        read_warc(spark, f"{tmp_path}/nothing-here").count()
    assert list(WarcReader({"path": str(tmp_path)}, None).found(Piece("", 0, 0))) == []
