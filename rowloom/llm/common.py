"""Helpers that the corpus operators share: shared storage, row keys and skew-safe lookups."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch of texts, at most.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application that the driver and every executor see, below `spark.checkpoint.dir`.

    Without that setting a local master gets a temporary folder, since all its
    threads are on one machine; any other master is refused, because executors
    wouldn't see each other's files.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"rowloom-{os.getuid()}")
    return f"{path.rstrip('/')}/rowloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete every table that this application has written to the shared folder; results that still read them end with it."""
    jvm, path = spark.sparkContext._jvm, shared_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once into the shared folder and return it as read back.

    Cuts the lineage with a file that outlives a lost executor, and fixes
    whatever was not deterministic in the plan above it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering its session's Arrow batches to rows and bytes that a Python worker can hold several times over."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


class Memo(dict):
    """Answers by key, of at most so many bytes (keys, answers and about 100 for each entry); long keys are not kept."""

    LONG, OVERHEAD = 256, 100

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def answers(self, keys: list, make) -> list:
        """The answer of every key; `make` gives those that aren't known."""
        found = [*map(self.get, keys)]
        if None in found:
            if self.held > self.most:
                self.clear()
                self.held = 0
            own: dict = {}
            for i, v in enumerate(found):
                if v is None:
                    key = keys[i]
                    v = own.get(key)
                    if v is None:
                        v = own[key] = make(key)
                        if len(key) <= self.LONG:
                            self[key] = v
                            self.held += self.OVERHEAD + 2 * len(key) + (len(v) if isinstance(v, bytes) else 8)
                    found[i] = v
        return found


def text_of(column: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_crc(column: str = "doc_id") -> Column:
    """crc32 of the identifier written as text; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def skewed_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, share: int = 256) -> DataFrame:
    """Left join of `rows` with `table` (one row per key; `weight` = rows that carry the key).

    Keys of at least total/share rows are looked up by a broadcast of at most
    `share` rows; every other key by a shuffle in which no key is large. The
    weight column goes away. Null keys find nothing and are spread over tasks.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    is_hot = F.col(weight) * F.lit(share) >= F.lit(max(total, 1))
    hot = table.filter(is_hot).select(F.col(key).alias("__hot_key"), F.struct(*values).alias("__hot"))
    cold = table.filter(~is_hot).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("__key"), F.struct(*values).alias("__cold"))
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot_key")) & F.col(key).isNotNull(), "left")
    # a hot or null row must not meet the others at one key: it gets a key of its own that finds nothing
    own = F.concat(F.lit("s"), F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if not t.startswith("map")]).cast("string"))
    plain = F.when(F.col("__hot_key").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(own)
    joined = marked.withColumn("__key", plain).join(cold, "__key", "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[found[v].alias(v) for v in values])
