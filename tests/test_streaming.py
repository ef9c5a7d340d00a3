from engramlake.streaming.ingest import ingest
from tests.test_operators import nodes


def test_stream_of_nodes(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    nodes(spark, ("a", "x", 1, None, "Active")).write.parquet(at("nodes/start"))
    nodes(spark, ("a", "y", 1, None, "Active"), ("b", "z", 1, None, "Active")).coalesce(1).write.parquet(at("in"))
    stream = spark.readStream.schema(spark.read.parquet(at("in")).schema).parquet(at("in"))
    ingest(stream, at("nodes"), at("check"), 7, lambda: 50).awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(at("nodes")).collect()
    assert sorted((r["node_id"], r["revision"], r["tenant"]) for r in out) == [("a", 1, 0), ("a", 2, 7), ("b", 2, 7)]
