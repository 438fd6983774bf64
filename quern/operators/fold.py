"""Log to state: committed rows, the latest of each key, and bounds in time or place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.log import BEGIN, COMMIT, DELETE, DROP, EXPIRY, INSERT


OPEN = 64  # keys that rows outside a transaction share in the semi-join, so that no single one is hot


def committed(log: DataFrame) -> DataFrame:
    """Rows outside a transaction, and those of transactions that were committed: one reading of the log, one of its commits."""
    outside = F.concat(F.lit("none-"), F.pmod("ord", F.lit(OPEN)).cast("string"))
    done = log.where(F.col("cmd") == COMMIT).select(F.col("tx_id").alias("_tx")).distinct()
    done = done.unionByName(log.sparkSession.range(OPEN).select(F.concat(F.lit("none-"), F.col("id").cast("string")).alias("_tx")))
    rows = log.where(~F.col("cmd").isin(BEGIN, COMMIT) | F.col("tx_id").isNull()).withColumn("_tx", F.coalesce("tx_id", outside))
    return rows.join(done, "_tx", "left_semi").select(*log.columns)


def fold(log: DataFrame, now_ms: int | None = None) -> DataFrame:
    """(collection, key, value, v, seq, created, modified) of the documents that live at the end of the log.

    A key's rows are reduced in each task before the shuffle.  A drop, or an
    expiry that lies before now_ms, clears what a collection held before it.
    """
    rows = committed(log)
    ends = rows.where(F.col("cmd").isin(DROP, EXPIRY)).groupBy("collection").agg(F.max(F.when(F.col("cmd") == DROP, F.col("ord"))).alias("dropped"), F.max(F.when(F.col("cmd") == EXPIRY, F.struct("ord", "value"))).alias("expiry"))
    expired = F.when(F.col("expiry.value").cast("long") <= (now_ms if now_ms is not None else -(1 << 62)), F.col("expiry.ord"))
    cleared = ends.select("collection", F.greatest("dropped", expired).alias("cleared"))
    entry = F.struct("cmd", "value", "v", "seq", "created", "_t", "ord")
    latest = rows.where(F.col("cmd").isin(INSERT, DELETE)).groupBy("collection", "key").agg(F.max_by(entry, "ord").alias("e"))
    live = latest.where(F.col("e.cmd") == INSERT).join(cleared, "collection", "left").where("cleared is null or e.ord > cleared")
    return live.select("collection", "key", "e.value", "e.v", "e.seq", "e.created", F.col("e._t").alias("modified"))


def until(log: DataFrame, to_time: int | None = None, to_seq: int | None = None) -> DataFrame:
    """The log before the first row later than to_time, or its first to_seq rows; an open transaction doesn't count."""
    if to_time is not None:
        first = log.where(F.col("_t") > to_time).agg(F.min("ord").alias("o")).first()["o"]
        log = log if first is None else log.where(F.col("ord") < first)
    if to_seq is not None:
        log = log.orderBy("ord").limit(to_seq)
    return log


def capped(state: DataFrame, max_size: int) -> DataFrame:
    """The newest max_size documents."""
    return state.orderBy(F.desc("seq")).limit(max_size)


def embed(docs: DataFrame, refs: str, source: DataFrame, alias: str, key: str = "key", value: str = "value") -> DataFrame:
    """Insert-time embedding for frames: ``refs`` holds "collection.key"; the document found goes under ``alias``, or null."""
    found = source.select(F.col(key).alias("__key"), F.col(value).alias(alias))
    at = F.instr(F.col(refs), F.lit("."))
    return docs.withColumn("__ref", F.when(at > 0, F.substring(F.col(refs), at + 1, F.length(refs)))).join(found, F.col("__ref") == F.col("__key"), "left").drop("__ref", "__key", refs)


def merge(base, patch):
    """A shallow merge of two JSON texts: the patch's members replace the base's."""
    kind = "map<string,variant>"
    b, p = F.variant_get(F.parse_json(base), "$", kind), F.variant_get(F.parse_json(patch), "$", kind)
    return F.to_json(F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(p), k)), p))
