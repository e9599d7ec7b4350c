from tessera.operators import triangles
from tessera.streaming import edges as stream


def test_stream_follows_batches(spark, tmp_path):
    pairs = sorted({(a, (a * a + 5 * k) % 17) for a in range(17) for k in range(1, 6)})
    for i in range(3):
        spark.createDataFrame(pairs[i::3], "src bigint, dst bigint").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    source = spark.readStream.schema("src bigint, dst bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream.follow(source, f"{tmp_path}/graph", f"{tmp_path}/state")
    assert q.awaitTermination(120) and q.exception() is None
    want = triangles.triangle_count(spark.createDataFrame(pairs, "src bigint, dst bigint"), undirected=True).first()[0]
    assert stream.triangle_total(spark, f"{tmp_path}/graph") == want
    stream.add_batch(spark.createDataFrame(pairs[:4], "src bigint, dst bigint"), 9, f"{tmp_path}/graph")
    assert stream.triangle_total(spark, f"{tmp_path}/graph") == want
