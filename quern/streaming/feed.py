"""Change events from the log, batch or streaming, and idle expiry.

The feed reads the log itself, so a slow reader misses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import COLUMNS, DELETE, DROP, EXPIRY, INSERT, SCHEMA


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The rows that are appended to a Parquet log's folder."""
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def events(log: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """(event, collection, key, new_v, ord): a change for each write; new_v is null for a delete, the key "*" for a drop."""
    cmd = F.col("cmd")
    kind = F.when(cmd.isin(INSERT, DELETE, DROP), "change").when(cmd == EXPIRY, "ttl_expiry").when(cmd == SCHEMA, "SCHEMA_SET")
    rows = log.select(kind.alias("event"), "collection", F.when(cmd == DROP, "*").otherwise(F.col("key")).alias("key"), F.when(cmd == INSERT, F.col("v")).alias("new_v"), "ord").where("event is not null")
    return rows if collections is None else rows.where(F.col("collection").isin(collections))


def as_json(feed: DataFrame) -> DataFrame:
    """Each event as one JSON text, an explicit null for new_v."""
    return feed.select(F.to_json(F.struct("event", "collection", "key", "new_v"), {"ignoreNullFields": "false"}).alias("value"))


def idle_expiry(writes: DataFrame, ttl: str, lateness: str = "0 seconds", at: str = "at", collection: str = "collection") -> DataFrame:
    """(collection, expires_at, writes): when a collection expires that isn't written to for ttl.

    A run of writes with smaller gaps is one session; its end is the expiry.
    As a stream, a row comes once the watermark passes it.
    """
    if writes.isStreaming:
        writes = writes.withWatermark(at, lateness)
    session = F.session_window(at, ttl)
    return writes.groupBy(collection, session.alias("s")).agg(F.count(F.lit(1)).alias("writes")).select(F.col(collection).alias("collection"), F.col("s.end").alias("expires_at"), "writes")


def rate_limited(requests: DataFrame, window_seconds: int, most: int, who: str = "user_id", at: str = "ts") -> DataFrame:
    """Adds ``limited``: were ``most`` requests or more already made in the window before this one?

    A user's time is cut into spans of the window's length, and each request goes
    to its own span and, as an earlier one, to the next.  So a busy user is dealt
    out over tasks by time.
    """
    from pyspark.sql import Window

    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.floor(micros / (window_seconds * 1_000_000)).cast("long")
    both = requests.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_late")).withColumn("_span", span + F.col("_late"))
    before = Window.partitionBy(who, "_span").orderBy(micros).rangeBetween(-window_seconds * 1_000_000 + 1, -1)
    return both.withColumn("limited", F.count(F.lit(1)).over(before) >= most).where("_late = 0").select(*requests.columns, "limited")
