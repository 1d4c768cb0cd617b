import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import sharding


def jump_by_hand(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_follows_its_definition():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    for n in (1, 2, 7, 24, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_by_hand(int(k) % 2**64, n) for k in keys]


def test_growing_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign_shards(docs, 24).toPandas()
    moved = rows[rows.shard != rows.grown_shard]
    assert set(moved.grown_shard) == {24}
    assert abs(len(moved) / len(rows) - 1 / 25) < 0.01
    assert rows.groupby("shard").size().between(700, 970).all()


def test_slots_are_gapless_and_sizes_exact(odd_docs):
    rows = sharding.assign_shards(odd_docs).toPandas()
    assert list(rows.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert len(rows) == odd_docs.count()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert rows.groupby("doc_id", dropna=False).shard.nunique().max() == 1
    texts = odd_docs.select("text").toPandas().text
    expected = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted(zip(rows["size"], rows.text_crc32, strict=True)) == expected


def test_empty_table_and_bad_count(no_docs):
    assert sharding.assign_shards(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(no_docs, 0)


def test_written_shards_hold_their_rows(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r[0]: r[1] for r in back.select("doc_id", "_shard").collect()} == {
        r.doc_id: r.shard for r in sharding.assign_shards(docs, 4).collect()
    }
