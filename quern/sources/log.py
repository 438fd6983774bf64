"""The append-only log that collections are folded from, and where it is kept.

A log row: ord (its place), tx_id, cmd, collection, key, value (JSON text),
v, seq, created, _t (epoch milliseconds).  A batch is one atomic append of
TX_BEGIN, its rows and TX_COMMIT; rows of a transaction without a commit don't
count.  State is always derived from the log, never changed in place.
"""

from __future__ import annotations

import hashlib
import logging
import os
import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RequestError

INSERT, DELETE, DROP, BEGIN, COMMIT, EXPIRY, SCHEMA = "INSERT", "DELETE", "DROP", "TX_BEGIN", "TX_COMMIT", "TTL_EXPIRY", "SCHEMA_SET"
SALT, SEALED, ENTRY = "KEY_SALT", "SEALED", ("cmd", "collection", "key", "value")
COLUMNS = "ord long, tx_id string, cmd string, collection string, key string, value string, v long, seq long, created long, _t long"


class Log(Protocol):
    def read(self) -> DataFrame: ...

    def append(self, rows: DataFrame) -> None: ...

    def replace(self, rows: DataFrame) -> None: ...


def held(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint, in the folder that the cluster names, without their lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"/tmp/checkpoints/{sc.applicationId}")
    return df.checkpoint(eager=True)


class MemoryLog:
    """No files of its own: the log is the union of what was appended, put together again as it gets long."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.parts = spark, spark.createDataFrame([], COLUMNS), 0

    def read(self) -> DataFrame:
        return self.rows

    def append(self, rows: DataFrame) -> None:
        kept = held(rows.select(*self.rows.columns))  # taken now, as its plan reads the log before it
        self.rows = self.rows.unionByName(kept)
        self.parts += 1
        if self.parts >= 8:
            self.replace(self.rows)

    def replace(self, rows: DataFrame) -> None:
        self.rows, self.parts = held(rows.select(*self.rows.columns).coalesce(4)), 0


def _mark(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and a checksum that their order doesn't change."""
    return tuple(rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0))).first())


class ParquetLog:
    """Generations of Parquet folders under one path, each begun by a snapshot; the newest complete one counts.

    A snapshot carries its number of rows and a checksum.  One that can't be read
    whole is passed over: its generation is left as it is, and the log of the
    generations before it and its own log are read together instead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = sorted(self._generations(), reverse=True)
        self.generation = found[0] if found else 0
        self.base = next((g for g in found if self._whole(g)), 0)

    def _whole(self, generation: int) -> bool:
        if not generation:
            return True
        try:
            folder = f"{self.path}/g{generation}"
            said = self.spark.read.schema("n long, mark long").parquet(f"{folder}/manifest").first()
            return said is not None and tuple(said) == _mark(self.spark.read.schema(COLUMNS).parquet(f"{folder}/snapshot"))
        except Exception as e:  # whatever a damaged file makes a reader raise
            logging.getLogger(__name__).warning("snapshot %s passed over: %s", generation, type(e).__name__)
            return False

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path

    def _generations(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return [int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and (n == "g0" or fs.exists(path(f"{self.path}/{n}/manifest/_SUCCESS")))]

    @property
    def folder(self) -> str:
        return f"{self.path}/g{self.generation}"

    def read(self) -> DataFrame:
        fs, path = self._fs()
        parts = [f"g{self.base}/snapshot", *(f"g{g}/log" for g in range(self.base, self.generation + 1))]
        out = self.spark.createDataFrame([], COLUMNS)
        for p in parts:
            if fs.exists(path(f"{self.path}/{p}")):
                out = out.unionByName(self.spark.read.schema(COLUMNS).parquet(f"{self.path}/{p}"))
        return out

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/log")

    def replace(self, rows: DataFrame) -> None:
        """A new generation begins with these rows; older ones stay as backups."""
        following = self.generation + 1
        rows.write.parquet(f"{self.path}/g{following}/snapshot")
        mark = _mark(self.spark.read.schema(COLUMNS).parquet(f"{self.path}/g{following}/snapshot"))
        self.spark.createDataFrame([mark], "n long, mark long").write.parquet(f"{self.path}/g{following}/manifest")
        self.generation = self.base = following


class BufferedLog:
    """Batches are held, readable at once, and go to the inner log together: one append for each ``most`` batches, or at flush.

    When an append fails the log is read-only from then on: writes are refused with 503, and what is held stays readable.
    """

    def __init__(self, inner: Log, most: int = 16):
        self.inner, self.most, self.held, self.broken = inner, most, [], False

    def read(self) -> DataFrame:
        out = self.inner.read()
        for rows in self.held:
            out = out.unionByName(rows)
        return out

    def append(self, rows: DataFrame) -> None:
        self._usable()
        self.held.append(held(rows))
        if len(self.held) >= self.most:
            self.flush()

    def flush(self) -> None:
        self._usable()
        if not self.held:
            return
        rows = self.held[0]
        for more in self.held[1:]:
            rows = rows.unionByName(more)
        try:
            self.inner.append(rows)
        except Exception as e:
            self.broken = True
            raise RequestError("The log can't be written; it is read-only now", 503) from e
        self.held = []

    def replace(self, rows: DataFrame) -> None:
        self._usable()
        kept = held(rows)
        self.inner.replace(kept)
        self.held = []

    def _usable(self) -> None:
        if self.broken:
            raise RequestError("The log is read-only", 503)


class EncryptedLog:
    """Whole entries (command, collection, key, value) are encrypted (AES, GCM); rows that another key wrote are skipped.

    The key is stretched from a password (PBKDF2, HMAC of SHA-256) with a random salt, which is the log's only open row.
    """

    def __init__(self, inner: Log, password: str, rounds: int = 200_000):
        self.inner = inner
        row = inner.read().where(F.col("cmd") == SALT).select("value").head()
        self.salt = row["value"] if row else os.urandom(16).hex()
        if row is None:
            inner.append(self._salted(inner.read().sparkSession))
        self.secret = F.lit(bytearray(hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(self.salt), rounds)))

    def _salted(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(-(1 << 62), None, SALT, None, None, self.salt, None, None, None, 0)], COLUMNS)

    def _seal(self, rows: DataFrame) -> DataFrame:
        whole = F.to_json(F.struct(*ENTRY))
        sealed = F.regexp_replace(F.base64(F.aes_encrypt(whole.cast("binary"), self.secret, F.lit("GCM"))), r"\s", "")
        null = F.lit(None).cast("string")
        return rows.withColumns({"value": sealed, "cmd": F.lit(SEALED), "collection": null, "key": null}).select(*rows.columns)

    def read(self) -> DataFrame:
        rows = self.inner.read().where(F.col("cmd") == SEALED)
        opened = F.try_aes_decrypt(F.unbase64("value"), self.secret, F.lit("GCM")).cast("string")
        rows = rows.withColumn("_entry", F.from_json(opened, ", ".join(f"{c} string" for c in ENTRY))).where("_entry.cmd is not null")
        return rows.withColumns({c: F.col(f"_entry.{c}") for c in ENTRY}).drop("_entry")

    def append(self, rows: DataFrame) -> None:
        self.inner.append(self._seal(rows))

    def replace(self, rows: DataFrame) -> None:
        self.inner.replace(self._seal(rows).unionByName(self._salted(rows.sparkSession)))
