import time

import pytest

from quirefold import schemas
from quirefold.operators import cache
from quirefold.sources import adapters
from quirefold.streaming import ingest
from tests.test_cache import LOG, log_rows, simulate

SF = "/root/testdata/sf0.001"


def finish(writer, seconds=90):
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        pytest.fail("the stream did not end")
    return query


def test_streamed_cache_equals_batch(spark, tmp_path):
    rows = sorted(log_rows(7, 240), key=lambda r: r[2])
    for k in range(4):  # micro-batches in order of time
        spark.createDataFrame(rows[k * 60 : k * 60 + 60], LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files are taken in order of their times
    log = spark.readStream.schema(spark.createDataFrame([], LOG).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    finish(ingest.cache_stream(log, 900.0, 200).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    got = {r.seq: (r.outcome, r.entries, r.total_bytes) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r.seq: (r.outcome, r.entries, r.total_bytes) for r in cache.replay(spark.createDataFrame(rows, LOG), 900.0, 200).collect()}
    assert got == batch == simulate(rows, 900.0, 200)


def test_streamed_blocks_equal_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.arriving_rows(spark, f"{tmp_path}/in", docs.schema, 1)
    finish(ingest.per_batch(stream, adapters.doc_blocks, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert got.count() == adapters.doc_blocks(docs).count()
    assert got.select("doc_id", "text").exceptAll(adapters.doc_blocks(docs).select("doc_id", "text")).isEmpty()


def test_arriving_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.pdf", b"%PDF one"), ("b.pdf", b"%PDF one"), ("c.pdf", b"%PDF two")):
        (tmp_path / "in" / name).write_bytes(content)
    rows = ingest.distinct_documents(ingest.arriving_files(spark, f"{tmp_path}/in"))
    finish(rows.select("doc_id", "path").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_schemas_are_whole():
    assert [f.name for f in schemas.BLOCKS.fields][:4] == ["doc_id", "page_num", "seq", "kind"]
    assert len({f.name for f in schemas.FIGURES.fields}) == len(schemas.FIGURES.fields)
