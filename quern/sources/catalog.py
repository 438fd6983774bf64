"""The registry of collections.

A collection is a DataFrame with the system columns ``_key``, ``_v``, ``_seq``,
``_createdAt`` and ``_modifiedAt`` and either typed document columns or one
VARIANT column ``doc``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound
from ..plans import validation as v


@dataclass
class Collection:
    name: str
    load: Callable[[], DataFrame]
    #: A native column that the key is the text of, so that lookups by key reach the scan.
    native_key: str | None = None
    expires_at: int | None = None
    ttl_ms: int | None = None
    max_size: int | None = None
    schema: dict | None = None

    def documents(self) -> DataFrame:
        return self.load()

    def expired(self, now_ms: int | None = None) -> bool:
        return self.expires_at is not None and (int(time.time() * 1000) if now_ms is None else now_ms) >= self.expires_at

    def with_keys(self, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """The documents of some keys; over about a thousand keys, by a semi-join."""
        if self.native_key in df.columns if self.native_key else False:
            kind = df.schema[self.native_key].dataType
            if isinstance(kind, T.IntegralType):
                whole = [int(k) for k in keys if k.lstrip("-").isdigit() and str(int(k)) == k]
                return df.where(F.col(self.native_key).isin(whole)) if whole else df.where(F.lit(False))
        if len(keys) > v.MAX_KEYS:
            return df.join(df.sparkSession.createDataFrame([(k,) for k in keys], "_key string"), "_key", "left_semi")
        return df.where(F.col("_key").isin(list(keys)))


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._collections: dict[str, Collection] = {}

    def __getitem__(self, name: str) -> Collection:
        if name not in self._collections:
            raise NotFound(f"Collection not found: {name}")
        return self._collections[name]

    def __contains__(self, name: str) -> bool:
        return name in self._collections

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._collections))

    def register(self, collection: Collection) -> Collection:
        self._collections[v.collection_name(collection.name)] = collection
        return collection

    def settle(self, name: str, **changes) -> Collection:
        """Change what the catalog knows of a collection: expires_at, ttl_ms, max_size, schema."""
        return self.register(replace(self[name], **changes))

    def forget(self, name: str) -> None:
        self._collections.pop(name, None)

    def typed(self, name: str, df: DataFrame, key: Column, seq: Column | None = None, native_key: str | None = None, created_ms: int = 0) -> Collection:
        """A table as a collection: a key, an order, version 1."""
        whole = df.select(key.cast("string").alias("_key"), F.lit(1).cast("long").alias("_v"), (seq if seq is not None else F.monotonically_increasing_id()).cast("long").alias("_seq"), F.lit(created_ms).cast("long").alias("_createdAt"), F.lit(created_ms).cast("long").alias("_modifiedAt"), *[F.col(f"`{c}`") for c in df.columns])
        return self.register(Collection(name, lambda: whole, native_key))

    def variant(self, name: str, df: DataFrame, key: Column, doc: Column, seq: Column, created_ms: int = 0) -> Collection:
        """Rows of JSON text as a schemaless collection."""
        whole = df.select(key.cast("string").alias("_key"), F.lit(1).cast("long").alias("_v"), seq.cast("long").alias("_seq"), F.lit(created_ms).cast("long").alias("_createdAt"), F.lit(created_ms).cast("long").alias("_modifiedAt"), F.parse_json(doc).alias("doc"))
        return self.register(Collection(name, lambda: whole))


#: The primary key of each table.
TABLE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}
#: String twins of foreign keys, as a lookup join needs a string.
TWINS = {"orders": {"customer_ref": "o_custkey"}, "customer": {"nation_ref": "c_nationkey"}, "supplier": {"nation_ref": "s_nationkey"}, "nation": {"region_ref": "n_regionkey"}, "documents": {"label_ref": "doc_id"}, "lineitem": {"order_ref": "l_orderkey", "part_ref": "l_partkey", "supplier_ref": "l_suppkey"}}


def tables(spark: SparkSession, folder: str) -> Catalog:
    """The Parquet tables of a folder as typed collections, and events' JSON as the schemaless one ``props``."""
    catalog = Catalog(spark)

    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        return df.withColumns({twin: F.col(c).cast("string") for twin, c in TWINS.get(name, {}).items()})

    class Lazy(dict):
        """Tables are only opened when a request names them."""

        def __missing__(self, name: str) -> Collection:
            if name == "props":
                e = spark.read.parquet(f"{folder}/events.parquet")
                catalog.variant("props", e, F.col("event_id"), F.col("props"), F.col("event_id"))
            elif name == "lineitem":
                catalog.typed(name, read(name), F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
            elif name == "conversations":
                catalog.typed(name, read(name), F.concat_ws("-", "conv_id", "turn"), F.col("conv_id") * 1000 + F.col("turn"))
            elif name in TABLE_KEYS:
                key = TABLE_KEYS[name]
                catalog.typed(name, read(name), F.col(key), F.col(key), key)
            else:
                raise KeyError(name)
            return self[name]

        def __contains__(self, name) -> bool:
            return dict.__contains__(self, name) or name in TABLE_KEYS or name in ("props", "lineitem", "conversations")

    catalog._collections = Lazy()
    return catalog
