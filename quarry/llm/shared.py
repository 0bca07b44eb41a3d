"""Helpers that several operators share: scratch tables and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's hash cache; more are hashed again each time.
CACHE_WORDS = 150_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset in local mode."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to a new table in the shared folder and returns what is read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of texts that a Python worker gets at a time; texts can be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of_texts(df: DataFrame, key: str, text: str, columns: str, start: Callable) -> DataFrame:
    """key and further columns (name type, ...) of the rows that a task's run = start() makes of each batch of texts.

    run(texts) yields (place of the text in the batch, values ...).  The key never leaves Arrow, so ids of any size stay what they are.
    """
    names = [x.split()[0] for x in columns.split(", ")]
    schema = df.sparkSession.createDataFrame([], columns).schema
    types = [ARROW[f.dataType.simpleString()] for f in schema]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = start()
        for b in batches:
            rows = list(run(b.column(1).to_pylist()))
            at = pa.array([x[0] for x in rows], pa.int64())
            made = [pa.array([x[k + 1] for x in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *made], names=[key, *names])

    return df.select(key, text).mapInArrow(each, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def sample_rows(df: DataFrame, key, about: int) -> DataFrame:
    """About so many rows at any input size, chosen by a hash of key."""
    every = max(1, df.count() // about)
    return df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)


class WordHashes(dict):
    """word bytes -> 64-bit hash, cached up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_array(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each window of n words; with fewer words, one hash of the whole sequence; none without words."""
    if not len(w):
        return w
    m = max(1, len(w) - n + 1)
    out = np.full(m, np.uint64(min(n, len(w))))
    for k in range(min(n, len(w))):
        out += w[k : k + m] * ODD[k]
    return mixed(out)
