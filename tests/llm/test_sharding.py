import zlib

from pyspark.sql import functions as F

from lodeframe.llm.sharding import shard_documents, shard_key, splitters, write_shards


def check(rows, out, shards):
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total, most = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(shards):
        own = [r for r in out if r.shard == s]
        assert abs(sum(r["size"] for r in own) - total / shards) <= most + 0.01 * total / shards
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert {r.law for r in out} == {"bytes"} and all(r.grown_shard is None for r in out)


def some_rows():
    return [(k, "x" * (k * 37 % 200) if k % 3 else "hot copy of a text") for k in range(3000)] + [(9000, None), (9001, ""), (9002, "é" * 700)]


def test_shards_are_even(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, size int, key string")
    out = shard_documents(docs).collect()
    check(rows, out, 24)
    assert sorted(map(str, out)) == sorted(map(str, shard_documents(docs.repartition(5)).collect()))


def test_small_blocks_give_gapless_slots(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = shard_documents(docs, shards=5, block_rows=40).collect()
    check(rows, out, 5)
    assert {r.doc_id: r.shard for r in out} == {r.doc_id: r.shard for r in shard_documents(docs, shards=5).collect()}


def test_a_group_of_equal_texts_stays_whole_if_it_fits(spark):
    rows = [(k, f"text {k % 50}" + "x" * (40 * (k % 50))) for k in range(1000)] + [(k, "small " + str(k // 2)) for k in range(2000, 3000)]
    rows += [(k, "a text that fills more than a shard of its own " * 20) for k in range(4000, 6000)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(rows, out, 8)
    shards_of = {}
    for r in out:
        shards_of.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(map(len, shards_of.values()))[:-1] == [1] * (len(shards_of) - 1) and max(map(len, shards_of.values())) > 1


def test_splitters_cut_where_bytes_say(spark):
    rows = spark.range(5000).select(shard_key(F.col("id").cast("string"), F.col("id")).alias("key"), (F.col("id") % 90 + 1).alias("size")).cache()
    bounds, total = splitters(rows, [1.0] * 10), rows.agg(F.sum("size")).first()[0]
    for k, b in enumerate(bounds, 1):
        below = rows.filter(F.col("key") < b).agg(F.sum("size")).first()[0]
        assert abs(below - total * k / 10) <= 0.001 * total / 10 + 90


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, None)], "doc_id long, text string")
    out = shard_documents(docs, shards=2).collect()
    assert len(out) == 4 and len({(r.shard, r.slot) for r in out}) == 4
    assert shard_documents(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "doc_id long, text string")
    write_shards(docs, str(tmp_path / "out"), shards=4)
    clashing = docs.selectExpr("doc_id", "text", "doc_id as shard", "text as _key", "1 as file_number", "2 as key")
    write_shards(clashing, str(tmp_path / "clashing"), shards=4, files_per_shard=2)
    again = spark.read.parquet(str(tmp_path / "clashing"))
    assert again.filter("shard = doc_id and _key = text").count() == 300 and again.select("_shard").distinct().count() == 4
    assert {(r.doc_id, r._shard) for r in again.collect()} == {(r.doc_id, r.shard) for r in shard_documents(docs, shards=4).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and set(back.columns) == {"doc_id", "text", "shard"}
    counts = {r.shard: r["count"] for r in back.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and max(counts.values()) - min(counts.values()) < 10
