"""The memory model's tables as DataFrames, and the supplied tables mapped onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engramlake.functions.expressions import fields_of

CONTENT = "struct<type:string,text:string,json:string,hash:string,size:bigint,mime:string,inline:binary>"
NODES = (
    "node_id string, tenant bigint, kind string, created_at_ms bigint, updated_at_ms bigint, "
    f"content {CONTENT}, metadata map<string,string>, revision bigint, state string, valid_from_ms bigint, valid_to_ms bigint"
)
EMBEDDINGS = "tenant bigint, model string, node_id string, vector array<float>"
EDGES = (
    "tenant bigint, src string, dst string, label string, weight float, created_at_ms bigint, metadata map<string,string>, "
    "revision bigint, valid_from_ms bigint, valid_to_ms bigint, evidence array<string>"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_content(text: Column) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("json"), null.cast("string").alias("hash"),
        null.cast("bigint").alias("size"), null.cast("string").alias("mime"), null.cast("binary").alias("inline"),
    )


def json_string(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', "$1")


def _nodes(df: DataFrame, node_id: Column, kind: Column, at: Column, text: Column, metadata: dict[str, Column]) -> DataFrame:
    null = F.lit(None).cast("bigint")
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v)]
    return df.select(
        node_id.alias("node_id"), F.lit(0).cast("bigint").alias("tenant"), kind.alias("kind"),
        at.cast("bigint").alias("created_at_ms"), at.cast("bigint").alias("updated_at_ms"), text_content(text).alias("content"),
        F.create_map(*pairs).alias("metadata"), F.lit(1).cast("bigint").alias("revision"), F.lit("Active").alias("state"),
        null.alias("valid_from_ms"), null.alias("valid_to_ms"),
    )


def fact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    of = {"lang": json_string(F.col("lang")), "source": json_string(F.col("source")), "n_chars": F.col("n_chars").cast("string")}
    return _nodes(d, F.concat(F.lit("doc:"), F.col("doc_id")), F.lit("Fact"), F.col("doc_id") * 1000, F.col("text"), of)


def episode_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    of = {"role": json_string(F.col("role")), "conv_id": F.col("conv_id").cast("string")}
    return _nodes(c, F.concat(F.lit("conv:"), F.col("conv_id"), F.lit(":"), F.col("turn")), F.lit("Episode"), F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), of)


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    of = {"mktsegment": json_string(F.col("c_mktsegment")), "nation": F.col("c_nationkey").cast("string")}
    return _nodes(c, F.concat(F.lit("cust:"), F.col("c_custkey")), F.lit("Entity"), F.col("c_custkey") * 1000, F.col("c_name"), of)


def artifact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return _nodes(pages, F.concat(F.lit("page:"), F.col("page_id")), F.lit("Artifact"), F.col("page_id") * 1000, F.col("url"), {"format": F.lit('"html"')})


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Episode", "Fact", "Entity", "Artifact")]), (F.col("label") % 4 + 1).cast("int"))
    return _nodes(v, F.concat(F.lit("vec:"), F.col("vec_id")), kind, F.col("vec_id") * 1000, F.lit(None).cast("string"), {"label": F.col("label").cast("string")})


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir) for f in (fact_nodes, episode_nodes, entity_nodes, artifact_nodes, vector_nodes)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.lit(0).cast("bigint").alias("tenant"), F.lit("text").alias("model"), F.concat(F.lit("vec:"), F.col("vec_id")).alias("node_id"), F.col("embedding").alias("vector"))


def _edges(src: Column, dst: Column, label: str, at: Column) -> list[Column]:
    null = F.lit(None).cast("bigint")
    return [
        F.lit(0).cast("bigint").alias("tenant"), src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), F.lit(1.0).cast("float").alias("weight"),
        at.cast("bigint").alias("created_at_ms"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(1).cast("bigint").alias("revision"),
        null.alias("valid_from_ms"), null.alias("valid_to_ms"), F.array().cast("array<string>").alias("evidence"),
    ]


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each turn of a conversation to the turn after it."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    name = lambda t: F.concat(F.lit("conv:"), F.col("conv_id"), F.lit(":"), t)
    return c.join(after, ["conv_id", "turn"]).distinct().select(*_edges(name(F.col("turn")), name(F.col("turn") + 1), "contains", F.col("conv_id") * 1000))


def related_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers to the parts they ordered."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    return pairs.select(*_edges(F.concat(F.lit("cust:"), F.col("o_custkey")), F.concat(F.lit("part:"), F.col("l_partkey")), "related", F.lit(0)))


def records(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """Nodes as query records: headers, score 0 and the map of fields."""
    from engramlake.functions.expressions import content_text

    content = content_text(F.col("content")) if text is None else text
    return nodes.select("node_id", "tenant", "kind", "created_at_ms", "updated_at_ms", F.lit(0.0).cast("float").alias("score"), fields_of(content, F.col("metadata")).alias("fields"))
