"""A database of schemaless collections over a log: the request interface.

Reads are lazy DataFrames (``find``); ``request`` collects at the edge and
answers with JSON values or an error envelope.  Writes append to the log in one
batch each; sequence numbers, versions and times are set by joining the batch
with the state.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import access
from .errors import Conflict, NotFound, RequestError
from .functions.jsonschema import valid
from .functions.paths import Resolver
from .functions.predicates import where_column
from .operators import fold as f
from .operators import metrics
from .plans import planner
from .plans import spec as s
from .plans import validation as v
from .sources.catalog import Catalog, Collection
from .sources.log import BEGIN, COLUMNS, COMMIT, DELETE, DROP, EXPIRY, INSERT, SCHEMA, Log, MemoryLog

INVALID = "Document does not match the collection's schema"


def uuid7(now_ms: int) -> str:
    """A time-ordered key: 48 bits of time, version 7, then random bits."""
    n = (now_ms << 80) | (7 << 76) | (int.from_bytes(os.urandom(2), "big") >> 4 << 64) | (2 << 62) | (int.from_bytes(os.urandom(8), "big") >> 2)
    return str(uuid.UUID(int=n))


def uuid7_column(now_ms: int) -> Column:
    """The same for the rows of a frame."""
    t, u = f"{now_ms:012x}", F.expr("uuid()")
    return F.concat(F.lit(f"{t[:8]}-{t[8:]}-7"), F.substring(u, 16, 3), F.substring(u, 19, 18))


class Database:
    def __init__(self, spark: SparkSession, log: Log | None = None, clock=lambda: int(time.time() * 1000)):
        self.spark, self.clock = spark, clock
        self.log = log or MemoryLog(spark)
        self.catalog = Catalog(spark)
        self.open()

    # state

    def open(self) -> None:
        """Learn collections, counters, schemas and expiries from the log."""
        rows = self.log.read()
        top = rows.agg(F.max("ord").alias("o")).first()["o"]
        self.next_ord = 0 if top is None else max(0, top + 1)
        self.next_seq: dict[str, int] = {}
        for r in self.state().groupBy("collection").agg(F.max("seq").alias("s")).collect():  # one row for each collection
            self._register(r["collection"])
            self.next_seq[r["collection"]] = r["s"] + 1
        settings = rows.where(F.col("cmd").isin(SCHEMA, EXPIRY)).groupBy("collection", "cmd").agg(F.max_by("value", "ord").alias("value")).collect()
        for r in settings:
            if r["cmd"] == SCHEMA:
                known = json.loads(r["value"])
                self._register(r["collection"])
                self.catalog.settle(r["collection"], schema=known.get("schema"), ttl_ms=known.get("ttl_ms"), max_size=known.get("max_size"))
        for r in settings:
            if r["cmd"] == EXPIRY and r["collection"] in self.catalog:
                self.catalog.settle(r["collection"], expires_at=int(r["value"]))

    def state(self, collection: str | None = None) -> DataFrame:
        rows = self.log.read()
        if collection is not None:
            rows = rows.where((F.col("collection") == collection) | F.col("cmd").isin(BEGIN, COMMIT))
        return f.fold(rows, self.clock())

    def _register(self, name: str) -> Collection:
        if name in self.catalog:
            return self.catalog[name]

        def load() -> DataFrame:
            return self.state(name).select(F.col("key").alias("_key"), F.col("v").alias("_v"), F.col("seq").alias("_seq"), F.col("created").alias("_createdAt"), F.col("modified").alias("_modifiedAt"), F.parse_json("value").alias("doc"))

        return self.catalog.register(Collection(name, load))

    def _append(self, rows: DataFrame, count: int) -> None:
        """One batch: rows (cmd, collection, key, value, v, seq, created, at), at being their order."""
        now, tx, base = self.clock(), str(uuid.uuid4()), self.next_ord
        body = rows.select((F.col("at") + base + 1).alias("ord"), F.lit(tx).alias("tx_id"), "cmd", "collection", "key", "value", "v", "seq", "created", F.lit(now).cast("long").alias("_t"))
        ends = self.spark.createDataFrame([(base, tx, BEGIN, None, None, None, None, None, None, now), (base + count + 1, tx, COMMIT, None, None, None, None, None, None, now)], COLUMNS)
        self.log.append(body.unionByName(ends))
        self.next_ord = base + count + 2

    def _note(self, cmd: str, collection: str, value: str | None = None) -> None:
        self.log.append(self.spark.createDataFrame([(self.next_ord, None, cmd, collection, None, value, None, None, None, self.clock())], COLUMNS))
        self.next_ord += 1

    # writes

    def set(self, body: dict) -> dict:
        b = v.request("set", body)
        name, data = b["collection"], b.get("data")
        if isinstance(data, dict):
            items = [(v.key_name(k), d) for k, d in sorted(data.items())]
        elif isinstance(data, list):
            items = [(uuid7(self.clock()), d) for d in data]
        else:
            raise RequestError("data must be an object or an array")
        for _, d in items:
            if not isinstance(d, dict):
                raise RequestError("A document must be an object")
            if any(k.startswith("_") for k in d):
                raise RequestError("Field names that begin with _ are reserved")
        if any("extends" in d for _, d in items):
            items = self._extended(items)
        if "ttl" in b or "maxSize" in b:
            self.schema({k: b[k] for k in ("collection", "ttl", "maxSize") if k in b})
        frame = self.spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False), n) for n, (k, d) in enumerate(items)], "key string, value string, at long")
        self.insert(name, frame, len(items))
        return {"count": len(items), "keys": [k for k, _ in items]}

    def _extended(self, items: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
        """Embed the documents that extends names by "collection.key"; what isn't found is left out.  One job for each collection named."""
        wanted: dict[str, set[str]] = {}
        refs = [{a: str(r).partition(".")[::2] for a, r in d["extends"].items()} if isinstance(d.get("extends"), dict) else {} for _, d in items]
        for source, key in (x for r in refs for x in r.values()):
            if source in self.catalog and key:
                wanted.setdefault(source, set()).add(key)
        found = {(source, r["key"]): json.loads(r["value"]) for source, keys in wanted.items() for r in self.state(source).where(F.col("key").isin(sorted(keys))).select("key", "value").collect()}  # what the request names
        return [(k, {n: x for n, x in d.items() if n != "extends"} | {a: found[x] for a, x in r.items() if x in found}) for (k, d), r in zip(items, refs)]

    def insert(self, name: str, frame: DataFrame, count: int) -> None:
        """frame: (key, value, at), keys distinct, at from 0 to count - 1."""
        v.collection_name(name)
        if name in self.catalog and self.catalog[name].expired(self.clock()):
            self.drop(name)
        collection = self._register(name)
        if collection.schema is not None and frame.where(~valid(F.parse_json("value"), collection.schema)).head(1):
            raise RequestError(INVALID)
        first, now = self.next_seq.get(name, 0), self.clock()
        before = self.state(name).select("key", F.col("v").alias("v0"), F.col("seq").alias("s0"), F.col("created").alias("c0"))
        rows = frame.join(before, "key", "left").select(F.lit(INSERT).alias("cmd"), F.lit(name).alias("collection"), "key", "value", (F.coalesce("v0", F.lit(0)) + 1).cast("long").alias("v"), F.coalesce("s0", F.col("at") + first).cast("long").alias("seq"), F.coalesce("c0", F.lit(now)).cast("long").alias("created"), "at")
        self._append(rows, count)
        self.next_seq[name] = first + count
        if collection.max_size is not None:
            self._evict(name, collection.max_size)
        if collection.ttl_ms is not None:
            self.catalog.settle(name, expires_at=self.clock() + collection.ttl_ms)
            self._note(EXPIRY, name, str(self.clock() + collection.ttl_ms))

    def _evict(self, name: str, max_size: int) -> None:
        over = self.state(name).count() - max_size
        if over > 0:
            self._remove(name, self.state(name).orderBy("seq").limit(over).select("key", "seq"))

    def _remove(self, name: str, gone: DataFrame) -> int:
        """gone: (key, seq), appended as they are, however many; their places follow their sequence numbers."""
        some = gone.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).first()
        if some["n"]:
            null = F.lit(None)
            rows = gone.select(F.lit(DELETE).alias("cmd"), F.lit(name).alias("collection"), "key", null.cast("string").alias("value"), *[null.cast("long").alias(c) for c in ("v", "created")], (F.col("seq") - some["first"]).alias("at"))
            self._append(rows.withColumn("seq", null.cast("long")), some["last"] - some["first"] + 1)
        return some["n"]

    def update(self, body: dict) -> dict:
        """A shallow merge for each key, in order, in one batch; a key that isn't there is passed over; the first error (a wrong _v guard is a conflict) ends it, earlier keys stay applied."""
        b = v.request("update", body)
        name, data = b["collection"], b.get("data")
        if not isinstance(data, dict):
            raise RequestError("data must be an object")
        if any(not isinstance(p, dict) for p in data.values()):
            raise RequestError("A patch must be an object")
        collection = self.catalog[name]
        now = {r["key"]: r for r in self.state(name).where(F.col("key").isin([v.key_name(k) for k in data])).collect()}  # at most MAX_KEYS
        rows, failure = [], None
        for key, patch in sorted(data.items()):
            if any(k.startswith("_") and k != "_v" for k in patch):
                failure = RequestError("Field names that begin with _ are reserved")
            elif key in now and "_v" in patch and patch["_v"] != now[key]["v"]:
                failure = Conflict(f"{key} is at version {now[key]['v']}")
            if failure:
                break
            if key in now:
                r = now[key]
                rows.append((key, r["value"], json.dumps({k: x for k, x in patch.items() if k != "_v"}, ensure_ascii=False), r["v"] + 1, r["seq"], r["created"], len(rows)))
        if rows:
            merged = self.spark.createDataFrame(rows, "key string, base string, patch string, v long, seq long, created long, at long").withColumn("value", f.merge(F.col("base"), F.col("patch")))
            if collection.schema is not None:
                bad = merged.where(~valid(F.parse_json("value"), collection.schema)).agg(F.min("at")).first()[0]
                if bad is not None:
                    rows, failure = rows[:bad], RequestError(INVALID)
            if rows:
                self._append(merged.where(F.col("at") < len(rows)).select(F.lit(INSERT).alias("cmd"), F.lit(name).alias("collection"), "key", "value", "v", "seq", "created", "at"), len(rows))
        if failure:
            raise failure
        return {"count": len(rows)}

    def delete(self, body: dict) -> dict:
        """Drop, then where, then count, then keys: the first that the request has."""
        b = v.request("delete", body)
        name = b["collection"]
        if b.get("drop") is True:
            self.drop(name)
            return {"dropped": name}
        ascending = b.get("order", "asc") != "desc"
        n = v.whole(b.get("count"), None)
        if n is not None and n > v.MAX_COUNT:
            raise RequestError(f"count must be at most {v.MAX_COUNT}")
        docs = self.catalog[name].documents()
        order = F.col("_seq").asc() if ascending else F.col("_seq").desc()
        if "where" in b:
            docs = docs.where(where_column(b["where"], Resolver(docs), *planner.EVALUATORS[s.Route.DELETE]))
            return {"count": self._remove(name, docs.orderBy(order).limit(v.DEFAULT_COUNT if n is None else n).select(F.col("_key").alias("key"), F.col("_seq").alias("seq")))}
        if "keys" in b:
            keys = [b["keys"]] if isinstance(b["keys"], str) else b["keys"]
            self._remove(name, docs.where(F.col("_key").isin([v.key_name(k) for k in keys])).select(F.col("_key").alias("key"), F.col("_seq").alias("seq")))
            return {"count": len(keys)}
        if n is None:
            raise RequestError("One of keys, where, count and drop is needed")
        return {"count": self._remove(name, docs.orderBy(order).limit(n).select(F.col("_key").alias("key"), F.col("_seq").alias("seq")))}

    def drop(self, name: str) -> None:
        self._note(DROP, name)
        kept = self.catalog[name] if name in self.catalog else None
        self.catalog.forget(name)
        self.next_seq.pop(name, None)
        if kept is not None and (kept.ttl_ms or kept.max_size or kept.schema):
            self._register(name)
            self.catalog.settle(name, ttl_ms=kept.ttl_ms, max_size=kept.max_size, schema=kept.schema)

    def clear(self) -> dict:
        """Every collection with its schema, expiry and cap, in one append."""
        names = list(self.catalog)
        if names:
            rows = [(self.next_ord + 2 * n + k, None, cmd, name, None, value, None, None, None, self.clock()) for n, name in enumerate(names) for k, (cmd, value) in enumerate(((DROP, None), (SCHEMA, "{}")))]
            self.log.append(self.spark.createDataFrame(rows, COLUMNS))
            self.next_ord += 2 * len(names)
        for name in names:
            self.catalog.forget(name)
        self.next_seq.clear()
        return {"cleared": len(names)}

    def sweep(self) -> list[str]:
        """Drop the collections that have expired; their names.  To be called when the next expiry, or a timer, is due."""
        gone = [n for n in self.catalog if self.catalog[n].expired(self.clock())]
        for name in gone:
            self.drop(name)
        return gone

    def next_expiry(self) -> int | None:
        """When the first collection expires."""
        return min((self.catalog[n].expires_at for n in self.catalog if self.catalog[n].expires_at is not None), default=None)

    def schema(self, body: dict) -> dict:
        b = v.request("schema", body)
        if not {"schema", "ttl", "maxSize"} & set(b):
            raise RequestError("One of schema, ttl and maxSize is needed")
        name = b["collection"]
        known = self._register(name)
        if b.get("schema") is not None:
            valid(F.parse_json(F.lit("{}")), b["schema"])  # refuses what it doesn't know
        changes = {"schema": b.get("schema", known.schema), "ttl_ms": int(b["ttl"] * 1000) if "ttl" in b else known.ttl_ms, "max_size": b.get("maxSize", known.max_size)}
        self.catalog.settle(name, **changes)
        self._note(SCHEMA, name, json.dumps(changes))
        return {"collection": name}

    # reads

    def find(self, body: dict, scopes: list[str] | None = None) -> DataFrame:
        if scopes is not None:
            body = access.restrict(body, scopes)
        spec = s.read(body)
        if self.catalog[spec.collection].expired(self.clock()):
            raise NotFound(f"Collection not found: {spec.collection}")
        return planner.plan(spec, self.catalog, self.clock())

    def get(self, body: dict, scopes: list[str] | None = None) -> Any:
        """The documents as JSON values: an array, or for a single key the document alone; nothing is not found."""
        df = self.find(body, scopes)
        rows = [_flat(json.loads(x)) for x in df.toJSON().collect()]  # at most MAX_COUNT
        if not rows:
            raise NotFound()
        return rows[0] if isinstance(body.get("keys"), str) else rows

    def many(self, bodies: list[dict]) -> DataFrame:
        """Scans of one collection in one pass: ``request`` is the number of the body that a row answers."""
        return planner.together([s.read(b) for b in bodies], self.catalog, self.clock())

    def page(self, collection: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """A page of a collection, as the paged scan of an HTTP front end: the newest first."""
        return self.find({"collection": collection} | {k: x for k, x in (("count", limit), ("offset", offset)) if x is not None})

    def stats(self, body: dict) -> DataFrame:
        b = v.request("stats", body)
        if "collection" in b:
            c = self.catalog[b["collection"]]
            return metrics.stats_one(c.documents(), c.name, c.expires_at, c.max_size, c.expired(self.clock()))
        frames = {n: self.catalog[n].documents() for n in self.catalog}
        return metrics.stats_all({n: df.where(F.lit(not self.catalog[n].expired(self.clock()))) for n, df in frames.items()})

    def request(self, endpoint: str, body: dict, scopes: list[str] | None = None) -> Any:
        """An endpoint's answer, or the envelope of its error."""
        try:
            if endpoint == "get":
                return self.get(body, scopes)
            if endpoint == "stats":
                return [r.asDict(True) for r in self.stats(body).collect()]
            return getattr(self, endpoint)(body)
        except RequestError as e:
            return e.envelope()

    # snapshots and recovery

    def snapshot(self) -> None:
        """A new generation of the log that begins with the state, settings and expiries."""
        # before everything that the log holds or will hold, in the order of collection and sequence number
        names = sorted(self.next_seq)
        number = F.element_at(F.create_map(*[x for n, c in enumerate(names) for x in (F.lit(c), F.lit(n))]), F.col("collection")) if names else F.lit(0)
        rows = self.state().select((number.cast("long") * (1 << 40) + F.col("seq") - (1 << 61)).alias("ord"), F.lit(None).cast("string").alias("tx_id"), F.lit(INSERT).alias("cmd"), "collection", "key", "value", "v", "seq", "created", F.col("modified").alias("_t"))
        kept = f.committed(self.log.read()).where(F.col("cmd").isin(SCHEMA, EXPIRY))
        self.log.replace(rows.unionByName(kept.select(*rows.columns)))
        top = self.log.read().agg(F.max("ord").alias("o")).first()["o"]
        self.next_ord = max(self.next_ord, (top or 0) + 1)

    def recover(self, to_time: int | None = None, to_seq: int | None = None) -> DataFrame:
        """The state at a time, or after the first to_seq rows of the log."""
        return f.fold(f.until(self.log.read(), to_time, to_seq))


def _flat(row: dict) -> dict:
    """The document's own members beside the result's."""
    doc = row.pop("doc", None)
    return row | doc if isinstance(doc, dict) else row
