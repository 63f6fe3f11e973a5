import zlib

from helpers import documents, rows
from pyspark.sql import functions as F

from opinspark.llm.sharding import shard_by_bytes, sharded


def test_contiguous_balanced_gapless(spark):
    docs = rows(11, 200) + rows(11, 200)[:50]
    got = shard_by_bytes(documents(spark, docs), 5).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in docs)
    texts = {r[0]: (r[1] or "").encode() for r in docs}
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
    for s in range(5):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(5):
        assert abs(sum(r.size for r in got if r.shard == s) - total / 5) <= biggest
    laid = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.text_hash, r.doc_id) for r in laid] == sorted((r.text_hash, r.doc_id) for r in got)


def test_empty(spark):
    assert shard_by_bytes(documents(spark, []), 24).count() == 0
    nothing = documents(spark, [(None, None, None, None, None, None, None, None)] * 3)
    assert sorted(r.slot for r in shard_by_bytes(nothing, 1).collect()) == [0, 1, 2]


def test_whole_rows(spark, tmp_path):
    table = rows(9, 80)
    docs = documents(spark, [*table, table[3], table[3], (None, None, None, None, None, None, None, None)])
    docs.write.parquet(f"{tmp_path}/d.parquet")
    expected = sorted(str(tuple(r)) for r in docs.collect())
    for source in (docs, spark.read.parquet(f"{tmp_path}/d.parquet"), docs.withColumn("_metadata", F.lit(1))):
        for how in ({}, {"broadcast_rows": 0}):
            got = sharded(source, 5, **how).collect()
            assert len({(r.shard, r.slot) for r in got}) == len(got)
            assert sorted(str(tuple(r.doc[: len(docs.columns)])) for r in got) == expected
    assert sharded(docs.limit(0), 5).count() == 0
