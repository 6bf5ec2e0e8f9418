"""Shared folder, intermediate tables and text helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and \x09-\x0D, which is what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of ids that are broadcast at most; more are joined by a shuffle.
FEW = 1_000_000
#: Spark's setting for deleting a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one will do for a session on one
    machine; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cladeforge-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete what they have shuffled when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cladeforge/{tag}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cf_path = path
    return out


def is_empty(df: DataFrame) -> bool:
    with tidied(df.sparkSession):
        return df.isEmpty()


def small(table: DataFrame) -> DataFrame:
    """A table of ``materialise``, for a join with texts: broadcast where it has up to ``FEW`` rows, so that texts aren't shuffled for it."""
    return F.broadcast(table) if table.count() <= FEW else table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cf_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame) -> DataFrame:
    """The same, after Arrow batches of the session are set to some megabytes at most, so that long texts don't fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words as UTF-8 bytes; only A-Z are lower-cased."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """word -> 64-bit hash; emptied at ``limit`` entries so that a worker's memory is bounded."""

    def __init__(self, seed: int = 0, limit: int = 1 << 17):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes; of the whole sequence where it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return out
