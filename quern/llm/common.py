"""Small helpers that several operators share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where the public vocabulary files are; every operator takes a path of its own.
TOKENIZERS = "/opt/tokenizers"
#: Texts that keep_rows judges at a time.
AT_ONCE = 1024
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus == remainder, F.lit(False))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes.lower and bytes.split do just that."""
    return text.lower().split()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one has a temporary folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, folder: str) -> DataFrame:
    """df, written to the folder and read from there; its shuffles' files go as soon as it is written, since nothing reads them again."""
    spark = df.sparkSession
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(folder)
    return spark.read.parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes (multiply, xor and shift rounds)."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return x


def pieces_of(path: str) -> list[tuple[str, int, float]]:
    """(piece, id, score) of the ordinary pieces of a SentencePiece model file, read on the driver.

    A vocabulary file is a fixed parameter of well under a megabyte, so its list may be broadcast.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)]


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterator of row tuples."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), schema)], schema=schema)


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows of docs whose text a mask keeps, all columns as they are, without a shuffle.

    ``judge`` is called once in each task and gives the function from texts to the mask.  It sees AT_ONCE texts at a
    time, and rows go on as they are judged, so that a batch's texts and kept rows aren't held whole beside it.
    """
    at = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = judge()
        for batch in rows:
            for k in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(k, AT_ONCE)
                yield some.filter(pa.array(np.asarray(mask(texts(some.column(at))), bool)))
        batch = some = None
        pa.default_memory_pool().release_unused()  # idle workers would hold it

    return docs.mapInArrow(run, docs.schema)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; what the process hasn't removed by its end goes then."""
    if not _written:
        atexit.register(lambda: [remove(*w) for w in list(_written)])
    _written.append((spark, f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"))
    return _written[-1][1]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of shared_dir, if the session still runs."""
    _written[:] = [w for w in _written if w[1] != folder]
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def least_hashed(rows: DataFrame, by: str, most: Callable[[object], int]) -> list[tuple]:
    """rows: (by, doc_id).  (by, doc_id) of the ``most(value)`` ids of each value of ``by`` that have the least hash.

    A bound on the hash, from the rows' number for each value, goes before the shuffle: a value's window then sees
    about five times what is taken, however many rows it has.  ``by`` has few values.
    """
    share = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    bounds = {r[by]: min(1.0, (5 * most(r[by]) + 100) / r["count"]) for r in rows.groupBy(by).count().collect()}
    if not bounds:
        return []
    near = rows.where(reduce(lambda a, b: a | b, [(F.col(by) == v) & (share < b) for v, b in bounds.items()])).select(by, "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(share, "doc_id"))
    limit = reduce(lambda c, v: c.when(F.col(by) == v, most(v)), bounds, F.when(F.lit(False), 0))
    return [(r[by], r["doc_id"]) for r in near.withColumn("k", rank).where(F.col("k") <= limit).select(by, "doc_id").collect()]
