"""What the text operators share: input columns, chunk coding, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
_WORD = re.compile(r"\w+")


def columns(df: DataFrame, wanted: tuple[tuple[str, str], ...] = DOCUMENT_COLUMNS) -> DataFrame:
    """Just the wanted columns, cast; one that is missing is null, and any other column is left out."""
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """df with rid, a number for each row that is the same however often and in whatever splits df is computed.

    Rows that only come from Parquet files have the place in their file, in the order of the files' paths. Any other
    frame is first written to the shared folder with its numbers: computed again it could have its rows in other places.
    """
    if not _plain_scan(df):
        return stored(df.select(F.monotonically_increasing_id().alias("rid"), "*"), "numbered")
    path = F.col("_metadata.file_path")
    paths = sorted(r[0] for r in df.select(path.alias("path")).distinct().collect())  # constant in a file; no column is read
    at = F.col("_metadata.row_index")
    if len(paths) < 2:
        return df.select(at.alias("rid"), "*")
    files = df.sparkSession.createDataFrame([(p, i << 40) for i, p in enumerate(paths)], "_path string, _file bigint")
    return df.select(path.alias("_path"), at.alias("_row"), "*").join(small(files), "_path").select((F.col("_file") + F.col("_row")).alias("rid"), *df.columns)


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is a table of Parquet files with nothing but deterministic selections and projections on it."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().apply(0)
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's; one of this machine only where all runs on it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="engramlake-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read more than once and by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; else as it is, for a shuffled join. df is to be cut or stored."""
    part = df.limit(rows + 1)
    wide = [F.octet_length(c) if t in ("string", "binary") else F.size(c) * 16 for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "map"))]
    n, held = part.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 * len(df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def slices(texts, size: int = 1 << 20):
    """Slices (from, to) of the texts with about so many characters each, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_code(word: str) -> bytes:
    """A word's 64-bit code."""
    return xxhash.xxh3_64_digest(word.encode("utf-8", "surrogatepass"))


def word_codes(chunk: str) -> bytes:
    return b"".join(map(word_code, words(chunk)))


def words(text: str) -> list[str]:
    low = text.lower()
    return [low] if low.isalnum() else _WORD.findall(low)


class ChunkCoder(dict):
    """Bytes for each white-space-free chunk, kept for the chunks that come again.

    encode gets a chunk and returns bytes; coder.array(text, dtype) is what its chunks give, in order.
    """

    #: Bytes of chunks and codes that are kept, and what an entry takes beside them.
    LIMIT, ENTRY = 64 << 20, 200

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.left = self.LIMIT

    def __missing__(self, chunk: str) -> bytes:
        value = self.encode(chunk)
        if self.left > 0:
            self.left -= len(chunk) + len(value) + self.ENTRY
            self[chunk] = value
        return value

    def bytes(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""

    def array(self, text: str | None, dtype) -> np.ndarray:
        return np.frombuffer(self.bytes(text), dtype)


def keep_heap() -> None:
    """Lets a worker of numpy steps take its temporaries from memory that it has, where the C library can be told to.

    Otherwise each larger one is mapped anew, which costs more time than what is done with it.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Lets the system have the freed memory that Arrow and the C library keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run, for mapInPandas or mapInArrow, after which its worker gives back what it doesn't need any more.

    An executor has more workers than cores and they stay for later tasks, where what they keep counts as the executor's.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64, on unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
