"""Language-model scoring with a log-frequency Bloom filter.

Tokens: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``, then one end of text,
which is a token and also stands before the first word.  Tokens are known by
the XXH64 of their bytes.

Counting: each task reduces its words and word pairs to sorted (key, count)
arrays, cut by leading bits of the key into shards; the shards, whose number
follows the size of the text, are shuffled and merged.  A pair's key is 34 bits
of its first and 30 of its second token's hash, with SPREAD leading bits of the
second added to those of the first, so that the pairs of a common word don't
meet in one shard; contexts are summed over those shards.  Every count is kept,
those of one included.

Filter: counts are quantised to levels, each its own whole number at first and
then wider by a factor.  A count enters its level and all below, each with its
own hash functions; reading one probes level 1, 2, ... until a probe misses.
Three filters are kept in this way: words, pairs, and for each context u the
tokens after it for each distinct one, c(u) / T(u) (level 0, about 1, isn't
stored).  A shard's part of a filter has BITS bits an entry, so filters grow with
the corpus and their error rate doesn't rise.  Filters of up to ``max_mb`` in all
are broadcast.  Larger ones stay dealt out in groups of shards: the texts are
packed into blocks, a block's distinct keys are shuffled to their groups, and
their levels, once written, back to the block.  Both ways give the same scores.

Model (absolute discounting by D, interpolated):

    P(w | u) = max(c(u,w) - D, 0) / c(u) + left(u) P(w),   left(u) = D T(u) / c(u)
    P(w)     = (1 - p0) c(w) / sum of c,  or p0 / U for each word that the filter lacks

with counts as the filter gives them, a pair's at most its words'.  After an
unknown word, P(w).  p0 is the share of tokens seen once (Good and Turing), one
half at most; U estimates how many unseen words there are, once^2 / (2 twice)
(Chao), one at least.  So the probabilities of all seen words and U unseen ones
add up to 1, but for what quantisation and false hits change.

Base score: exact counts.  The commonest words (at most ``HEAD``, a bound) are
broadcast with their counts; the other words of the texts are joined with the
table of counts and summed for each text.

Null and empty texts hold only the end; texts of any length are read whole.  Each row gives one row; repeated and
null ids are kept (a null id is learned from; ids are whole numbers); with nothing to learn from, N and
V are zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLEANUP, checkpointed, held_out, mix, partitions, remove, settings, shared_dir, table, texts, words, written

END = np.uint64(0xE05D_E05D_E05D_E05D)
D = 0.75
HEAD = 300_000
BITS, PROBES, LEAST = 10, 7, 1 << 13
BASES = {1: 1.4, 2: 1.5, 3: 1.1}  # words, pairs, contexts: the factor between levels
SHARD = 64 << 20  # bytes of text for each shard of the counts
LOW = np.uint64(30)
SPREAD = 5  # bits: a context's pairs lie in up to 2^SPREAD shards
#: While it runs: a task holds a batch of rows several times, in the JVM and in its worker, and the tasks of an executor share little beside the heap.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), CLEANUP: "true"}
FLUSH, MERGE = 3_000_000, 1_000_000  # tokens and keys held before they are reduced
REMEMBERED = 200_000
MAX_MB = 112  # filters that are broadcast: each worker holds them whole, two in an executor
TOGETHER, HIGH = 1 << 16, 3  # keys probed together, so that they stay in the processor's cache; the least level that is remembered
BLOCK, GROUP = 4 << 20, 8 << 20  # bytes: texts scored together, filters in a group
TOLD = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("others", pa.list_(pa.int64()))])
TOLD_DDL = "doc_id long, held_out boolean, n_tokens long, n_head long, logs double, score double, others array<long>"
FILTERS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("size", pa.int64()), ("bits", pa.binary())])
FILTERS_DDL = "kind int, shard int, size long, bits binary"
SHARDS = pa.schema([*FILTERS, *((x, pa.int64()) for x in ("n", "distinct", "once", "twice")), ("mass", pa.float64()), ("above", pa.list_(pa.int64())), ("keys", pa.binary()), ("counts", pa.binary())])
SHARDS_DDL = FILTERS_DDL + ", n long, distinct long, once long, twice long, mass double, above array<long>, keys binary, counts binary"
BLOBS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


class Hashes:
    """XXH64 of words, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        values = list(map(known.get, found))
        if None in values:
            if len(known) > REMEMBERED:
                known.clear()
            digest = xxhash.xxh64_intdigest
            for k, v in enumerate(values):
                if v is None:
                    values[k] = known[found[k]] = digest(found[k])
        return np.array(values, np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The leading bits of the second token's hash change those of the first's, so that the pairs of a common word are spread over shards."""
    return ((first ^ (second >> np.uint64(64 - SPREAD) << np.uint64(64 - SPREAD))) >> LOW << LOW) | (second >> np.uint64(34))


def contexts_of(pairs: np.ndarray) -> np.ndarray:
    """The keys of the first tokens: 34 bits of their hashes."""
    return (pairs ^ (pairs >> LOW - np.uint64(SPREAD) << np.uint64(64 - SPREAD))) >> LOW << LOW


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, all leading bytes first and then all second ones, which compresses better."""
    return np.diff(keys, prepend=np.uint64(0)).byteswap().view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).ravel().byteswap(), dtype=np.uint64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys; keys come out sorted."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(c, starts)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and end."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(values))[: len(starts)]


def row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def count(docs: DataFrame, shard_bits: int) -> DataFrame:
    """docs: (text).  Rows of SHARDS: for each shard of the words (kind 1) its filter, sums, sorted keys and their counts; for each shard of the pairs (kind 2) its filter.

    Beside a shard of the pairs, by shards of their contexts (kind 3): the contexts, and their c(u) and then their T(u) within it.
    Counts of pairs aren't kept: they are several times the text's size on disk.
    """
    shift = np.uint64(64 - shard_bits)

    def shards(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        own = keys >> shift
        starts, ends = runs_of(own)
        some, cuts = own[starts].astype(np.int32), list(zip(starts.tolist(), ends.tolist()))
        counts = counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some), pa.array([packed(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())], schema=BLOBS)

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = np.concatenate(held)
            held.clear()
            for kind in (1, 2):
                yield shards(kind, *np.unique(t if kind == 1 else pair_keys(np.concatenate([[END], t[:-1]]), t), return_counts=True))

        for text in (t for batch in rows for k in range(0, batch.num_rows, 500) for t in texts(batch.column(0).slice(k, 500))):
            held.append(np.append(hashes.of(words(text)), END))
            size += len(held[-1])
            if size >= FLUSH:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by kind and shard, so that one shard is held at a time."""
        at, held, size, least = None, [], 0, MERGE

        def finish() -> Iterator[pa.RecordBatch]:
            k, c = merged(*zip(*held))
            held.clear()
            own = {"kind": at[0], "shard": at[1]} | dict(zip(("size", "bits"), LogBloom.build(at[0], k, c.astype(np.float64))))
            if at[0] == 1:
                mass = float(value_of(1, levels(1, c.astype(np.float64))).sum())
                above = [int((c >= 1 << j).sum()) for j in range(48)]
                yield row(SHARDS, **own, n=int(c.sum()), distinct=len(k), once=int((c == 1).sum()), twice=int((c == 2).sum()), mass=mass, above=above, keys=packed(k), counts=c.tobytes())
                return
            yield row(SHARDS, **own)
            k = contexts_of(k)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            starts, ends = runs_of(k)
            k, c, t = k[starts], np.add.reduceat(c, starts), (ends - starts).astype(np.uint64)
            for a, b in zip(*(x.tolist() for x in runs_of(k >> shift))):
                yield row(SHARDS, kind=3, shard=int(k[a] >> shift), keys=packed(k[a:b]), counts=c[a:b].tobytes() + t[a:b].tobytes())

        for batch in rows:
            for kind, shard, k, c in zip(*(batch.column(n) for n in range(4))):
                if (kind.as_py(), shard.as_py()) != at:
                    if at:
                        yield from finish()
                    at, size, least = (kind.as_py(), shard.as_py()), 0, MERGE
                held.append((unpacked(k), np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64)))
                size += len(held[-1][0])
                if size >= least:
                    held[:] = [merged(*zip(*held))]
                    size = len(held[0][0])
                    least = size + max(size, MERGE)
        if at:
            yield from finish()

    names = "kind int, shard int, keys binary, counts binary"
    return docs.select("text").mapInArrow(gather, names).repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(merge, SHARDS_DDL)


def contexts(counts: DataFrame) -> DataFrame:
    """counts: rows of SHARDS.  The filter of each shard of the contexts, by the millionths of c(u) / T(u)."""

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finish() -> pa.RecordBatch:
            k = np.concatenate([x for x, _ in held])
            order = np.argsort(k, kind="stable")
            k, sums = k[order], np.concatenate([x for _, x in held], axis=1)[:, order]
            held.clear()
            starts, _ = runs_of(k)
            c, t = np.add.reduceat(sums, starts, axis=1)
            size, bits = LogBloom.build(3, k[starts], np.round(c / t * 1e6))
            return row(FILTERS, kind=3, shard=at, size=size, bits=bits)

        for batch in rows:
            for shard, k, c in zip(*(batch.column(n) for n in range(3))):
                if shard.as_py() != at:
                    if held:
                        yield finish()
                    at = shard.as_py()
                held.append((unpacked(k), np.frombuffer(c.as_buffer(), np.uint64).reshape(2, -1)))
        if held:
            yield finish()

    return counts.where("kind = 3").select("shard", "keys", "counts").repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, FILTERS_DDL)


@cache
def steps(kind: int) -> np.ndarray:
    """The least count of each level from 1 on."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(out[-1] * BASES[kind])))
    return np.array(out, np.float64)


def levels(kind: int, values: np.ndarray) -> np.ndarray:
    """The quantised level: of counts 1 at least, of a context's millionths 0 at least."""
    if kind == 3:
        return np.floor(np.log(np.maximum(values / 1e6, 1)) / np.log(BASES[3]) + 1e-9).astype(np.int64)
    return np.searchsorted(steps(kind), values, side="right")


def value_of(kind: int, level: np.ndarray) -> np.ndarray:
    """The middle (geometric) of the values of a level, of 1 or more for counts."""
    if kind == 3:
        return np.where(level > 0, BASES[3] ** (level + 0.5), 1.0)
    first, last = steps(kind)[level - 1], steps(kind)[np.minimum(level, len(steps(kind)) - 1)] - 1
    return np.sqrt(first * np.maximum(first, last))


def places(h: np.ndarray, probe: int, m: np.ndarray | np.uint64) -> np.ndarray:
    """The place among m < 2^32 bits of one probe; h hashes a key with its level, and steps by its own halves, exchanged."""
    with np.errstate(over="ignore"):
        x = h + ((h << np.uint64(32)) | (h >> np.uint64(32)) | np.uint64(1)) * np.uint64(probe)
        return ((x >> np.uint64(32)) * m) >> np.uint64(32)


class LogBloom:
    """A log-frequency Bloom filter of shards: bits, and each shard's offset and size in bits."""

    def __init__(self, kind: int, shard_bits: int, parts: dict[int, tuple[int, bytes]]):
        self.kind, self.shift = kind, np.uint64(64 - shard_bits)
        self.size = np.ones(1 << shard_bits, np.uint64)
        self.offset = np.zeros(1 << shard_bits, np.uint64)
        blobs, at = [b"\0" * 8], 64
        for s in sorted(parts):
            self.size[s], self.offset[s] = parts[s][0], at
            blobs.append(parts[s][1])
            at += 8 * len(parts[s][1])
        self.bits = np.frombuffer(b"".join(blobs), np.uint8)

    @staticmethod
    def build(kind: int, keys: np.ndarray, values: np.ndarray) -> tuple[int, bytes]:
        level = levels(kind, values)
        m = max(LEAST, BITS * int(level.sum()))
        bits = np.zeros(-(-m // 8) * 8, bool)
        for n in range(1, int(level.max(initial=0)) + 1):
            h = mix(keys[level >= n], np.uint64(n))
            for probe in range(PROBES):
                bits[places(h, probe, np.uint64(m)).astype(np.int64)] = True
        return m, np.packbits(bits, bitorder="little").tobytes()

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Probe level after level until one misses; 0 is absence.  Sorted keys read the bits shard by shard."""
        return np.concatenate([self._level(keys[k : k + TOGETHER]) for k in range(0, len(keys), TOGETHER)]) if len(keys) else np.zeros(0, np.int64)

    def _level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        shard = keys >> self.shift
        m, offset, n = self.size[shard], self.offset[shard], 1
        while len(at):
            x = mix(keys, np.uint64(n))
            step = (x << np.uint64(32)) | (x >> np.uint64(32)) | np.uint64(1)  # see places
            for probe in range(PROBES):
                p = ((((x >> np.uint64(32)) * m) >> np.uint64(32)) + offset).view(np.int64)
                hit = (self.bits.take(p >> 3) >> (p & 7).astype(np.uint8) & 1).view(bool)
                if not hit.all():
                    hit = np.flatnonzero(hit)
                    keys, at, x, step, m, offset = keys[hit], at[hit], x[hit], step[hit], m[hit], offset[hit]
                if not len(at):
                    break
                x += step
            out[at] = n
            n += 1
        return out


class Remembered:
    """Levels in a filter, the same as the filter's: each distinct key is probed once and in order, and those of high levels are remembered."""

    def __init__(self, bloom: LogBloom):
        self.bloom, self.keys, self.levels = bloom, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        out, fresh = np.zeros(len(distinct), np.int64), distinct[~known]
        out[known], out[~known] = self.levels[at[known]], self.bloom.level(fresh)
        high = ~known & (out >= HIGH)
        if len(self.keys) > REMEMBERED:
            self.keys, self.levels = self.keys[:0], self.levels[:0]
        found = np.concatenate([self.keys, distinct[high]])
        order = np.argsort(found, kind="stable")
        self.keys, self.levels = found[order], np.concatenate([self.levels, out[high]])[order]
        return out[place]


class Model:
    """filters: empty where they are too large to be broadcast."""

    def __init__(self, filters: dict[int, LogBloom], shard_bits: int, totals: dict[str, float], head: tuple[np.ndarray, np.ndarray]):
        self.filters, self.shard_bits, self.head = filters, shard_bits, head
        self.n, self.distinct, self.mass = int(totals["n"]), int(totals["distinct"]), max(totals["mass"], 1.0)
        once, twice = totals["once"], totals["twice"]
        self.p0 = min(max(once, 1) / (self.n + 1), 0.5) if self.n else 1.0
        self.unseen = max(once * once / (2 * twice) if twice else once * (once - 1) / 2, 1.0)

    def word_values(self, keys: np.ndarray) -> np.ndarray:
        """Columns: filter's count, P(w), left(u), exact count of a common word or -1."""
        return self.values_of(keys, self.filters[1].level(keys), self.filters[3].level(keys >> LOW << LOW))

    def values_of(self, keys: np.ndarray, level: np.ndarray, context: np.ndarray) -> np.ndarray:
        """word_values, by the levels of the words and of their contexts."""
        c = np.where(level > 0, value_of(1, np.maximum(level, 1)), 0.0)
        p = np.where(level > 0, (1 - self.p0) * c / self.mass, self.p0 / self.unseen)
        left = D / value_of(3, context)
        exact = np.full(len(keys), -1.0)
        k, n = self.head
        if len(k):
            at = np.searchsorted(k, keys).clip(max=len(k) - 1)
            exact[k[at] == keys] = n[at][k[at] == keys]
        return np.stack([c, p, left, exact], axis=1)

    def log10(self, keys: np.ndarray, values: np.ndarray, end: np.ndarray, pairs: Remembered) -> np.ndarray:
        """log10 P of each token after the one before; the first comes after an end, whose values are ``end``."""
        return self.log10_of(pairs.level(pair_keys(np.concatenate([[END], keys[:-1]]), keys)), values, end)

    def log10_of(self, level: np.ndarray, values: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10, by the levels of the pairs."""
        count = np.concatenate([end[:, 0], values[:-1, 0]])
        p = np.where(count > 0, np.concatenate([end[:, 2], values[:-1, 2]]), 1.0) * values[:, 1]
        at = np.flatnonzero((level > 0) & (count > 0))
        pair = np.minimum(value_of(2, level[at]), np.minimum(count[at], values[at, 0]))
        p[at] += np.maximum(pair - D, 0) / count[at]
        return np.log10(np.clip(p, 1e-300, 1))


def train(docs: DataFrame, max_mb: int = MAX_MB) -> tuple[Model, DataFrame, DataFrame, int]:
    """docs: (text).  The model, its filters' table (kind, shard, size, bits), the table (key, c) of the words outside its head, and the head's least count."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shard_bits = (max(15, 2 * partitions(spark) - 1, size // SHARD)).bit_length()
    folder = shared_dir(spark, "lm")
    counts = written(count(docs, shard_bits), folder)
    own = counts.where("kind = 1")
    sums = ("n", "distinct", "once", "twice", "mass")
    totals = own.agg(*(F.sum(x).alias(x) for x in sums), F.array(*(F.sum(F.get("above", F.lit(j))) for j in range(48))).alias("above")).first().asDict()
    if totals["n"] is None:
        totals = {"n": 0, "distinct": 0, "once": 0, "twice": 0, "mass": 0.0, "above": [0] * 48}
    built = checkpointed(counts.where("kind < 3").select(*FILTERS.names).union(contexts(counts)))
    counted = checkpointed(own.select("keys", "counts"))
    remove(spark, folder)
    filters = {}
    if (built.agg(F.sum("size").alias("bits")).first()["bits"] or 0) <= max_mb << 23:  # the bound of what is broadcast
        for kind in (1, 2, 3):  # kind by kind and part by part, so that the driver holds them about once
            own = built.where(F.col("kind") == kind).select("shard", "size", "bits").toLocalIterator()
            filters[kind] = LogBloom(kind, shard_bits, {r["shard"]: (r["size"], bytes(r["bits"])) for r in own})
    least = 1 << int(np.flatnonzero(np.array(totals["above"]) <= HEAD)[0])

    def unpack(common: bool):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for k, c in zip(batch.column(0), batch.column(1)):
                    keys, values = unpacked(k).view(np.int64), np.frombuffer(c.as_buffer(), np.int64)
                    take = (values >= least) == common
                    yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(values[take])], names=["key", "c"])

        return counted.mapInArrow(run, "key long, c long")

    head = unpack(True).toArrow()  # at most HEAD rows
    keys, exact = head.column("key").to_numpy().view(np.uint64), head.column("c").to_numpy().astype(float)
    order = np.argsort(keys)
    return Model(filters, shard_bits, totals, (keys[order], exact[order])), built, unpack(False), least


def runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows in a row, until their texts have BLOCK bytes or more."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        size += n + 64
        if size >= BLOCK or k == len(sizes) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def told_batch(ids: pa.Array, held: pa.Array, sizes: list[int], t: np.ndarray, v: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    """The rows of texts of so many tokens each, from all tokens' keys, word values and log10 P."""
    starts, out = np.concatenate([[0], np.cumsum(sizes)]), []
    exact = v[:, 3]
    common = exact >= 0
    totals = [np.add.reduceat(x, starts[:-1]) for x in (common.astype(np.int64), np.where(common, np.log10(np.maximum(exact, 0) + 1), 0.0), logs)]
    for n, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        out.append((b - a, int(totals[0][n]), float(totals[1][n]), float(totals[2][n]), t[a:b][~common[a:b]].view(np.int64)))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), held, *(pa.array([o[x] for o in out], TOLD[x + 2].type) for x in range(5))], schema=TOLD)


def dealt(docs: DataFrame, model: Model, filters: DataFrame, folder: str) -> DataFrame:
    """docs: (doc_id, held_out, text).  The rows of told_batch by shuffling each block's distinct keys to the filters' groups.

    They read the folder, where the blocks are and their levels, which are written first so that the keys' shuffle is gone when texts are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most HEAD words
    bounds = filters.groupBy("kind").agg(F.sum(F.length("bits")).alias("bytes")).collect()
    shard_bits = model.shard_bits
    group_bits = min(shard_bits, max(max(b["bytes"] for b in bounds) // GROUP, partitions(spark) // 3).bit_length())

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = ([], [], []), 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in zip(block, (pa.int64(), pa.bool_(), pa.binary()))], names=["ids", "held", "bodies"])

        for batch in rows:
            for one in (x for k in range(0, batch.num_rows, 500) for x in zip(batch.column(0).slice(k, 500).to_pylist(), batch.column(1).slice(k, 500).to_pylist(), texts(batch.column(2).slice(k, 500)))):
                for held, x in zip(block, one):
                    held.append(x)
                size += len(one[2]) + 64
                if size >= BLOCK:
                    yield row()
                    block, size = ([], [], []), 0
        if size:
            yield row()

    docs.select("doc_id", "held_out", "text").mapInArrow(pack, "ids array<long>, held array<boolean>, bodies array<binary>").withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")

    def tokens(bodies: list[bytes], hashes: Hashes) -> tuple[np.ndarray, list[int], np.ndarray, dict[int, np.ndarray]]:
        """Token keys, tokens of each text, the place of each token's key among the distinct ones, and the keys of each kind, of distinct tokens but for the pairs."""
        each = [np.append(hashes.of(words(b)), END) for b in bodies]
        t = np.concatenate(each)
        own, place = np.unique(t, return_inverse=True)
        return t, [len(x) for x in each], place, {1: own, 2: pair_keys(np.concatenate([[END], t[:-1]]), t), 3: own >> LOW << LOW}

    probes = pa.schema([("kind", pa.int32()), ("group", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in rows:
            for block, bodies in zip(batch.column(0).to_pylist(), batch.column(1)):
                for kind, keys in tokens(bodies.as_py(), hashes)[3].items():
                    keys = np.unique(keys)
                    own = keys >> np.uint64(64 - group_bits) if group_bits else np.zeros(len(keys), np.uint64)
                    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    n, cuts = len(starts), zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([kind] * n, own[starts].tolist(), [block] * n, [0] * n, [0] * n, [packed(keys[a:b]) for a, b in cuts]), probes)], schema=probes)

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by kind and group, the filter's first; several blocks' keys are probed together."""
        at, parts, bloom, asked, size = None, {}, None, [], 0

        def told() -> pa.RecordBatch:
            level = bloom.level(np.concatenate([keys for _, keys in asked])).astype(np.uint16)
            cuts = np.cumsum([len(keys) for _, keys in asked])[:-1]
            n = len(asked)
            return pa.RecordBatch.from_arrays([pa.array([block for block, _ in asked]), pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int32()), pa.array([x.tobytes() for x in np.split(level, cuts)], pa.binary())], names=["block", "kind", "group", "data"])

        for batch in rows:
            for kind, group, block, shard, bits, data in zip(*batch.columns):
                if (kind.as_py(), group.as_py()) != at:
                    if asked:
                        yield told()
                    at, parts, bloom, asked, size = (kind.as_py(), group.as_py()), {}, None, [], 0
                if block.as_py() < 0:
                    parts[shard.as_py()] = bits.as_py(), data.as_py()
                    continue
                bloom = bloom or Remembered(LogBloom(at[0], shard_bits, parts))
                asked.append((block.as_py(), unpacked(data)))
                size += len(asked[-1][1])
                if size >= MERGE:
                    yield told()
                    asked, size = [], 0
        if asked:
            yield told()

    def tell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = shared.value, Hashes()

        def finish(ids: list, held: list, bodies: list[bytes], found: dict[int, list[bytes]]) -> pa.RecordBatch:
            t, sizes, place, keys = tokens(bodies, hashes)
            level = {k: np.frombuffer(b"".join(found[k]), np.uint16).astype(np.int64)[np.unique(keys[k], return_inverse=True)[1]] for k in keys}
            v = model.values_of(keys[1], level[1], level[3])[place]
            return told_batch(pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), sizes, t, v, model.log10_of(level[2], v, v[sizes[0] - 1 : sizes[0]]))

        block = None
        for batch in rows:
            for kind, data, *texts_of in zip(*(batch.column(x) for x in ("kind", "data", "ids", "held", "bodies"))):
                if kind.as_py() == 0:  # it comes first, and then the levels by groups
                    if block:
                        yield finish(*block)
                    block = (*(x.as_py() for x in texts_of), {1: [], 2: [], 3: []})
                else:
                    block[3][kind.as_py()].append(data.as_py())
        if block:
            yield finish(*block)

    asked = blocks.select("block", "bodies").mapInArrow(ask, "kind int, group int, block long, shard int, size long, data binary")
    own = filters.select("kind", F.shiftright("shard", shard_bits - group_bits).alias("group"), F.lit(-1).cast("long").alias("block"), "shard", "size", F.col("bits").alias("data"))
    levels = own.union(asked).repartition("kind", "group").sortWithinPartitions("kind", "group", "block").mapInArrow(answer, "block long, kind int, group int, data binary")
    levels = written(levels, f"{folder}/levels")
    both = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("group"), F.lit(None).cast("binary").alias("data"), "ids", "held", "bodies").unionByName(levels, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "group").mapInArrow(tell, TOLD_DDL)


def score(docs: DataFrame, model: Model, filters: DataFrame, rest: DataFrame) -> DataFrame:
    """docs: (doc_id, held_out, text).  Adds n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # filters of max_mb or none, and at most HEAD words

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[bytes, int] = {}
        end, pairs = model.word_values(np.array([END])), Remembered(model.filters[2])
        keys, values = np.full(4096, END), np.repeat(end, 4096, axis=0)  # row 0: the end
        for batch in rows:
            for start, upto in runs(batch.column(2)):
                some = [words(b) for b in texts(batch.column(2).slice(start, upto - start))]
                new = list({w for ws in some for w in ws if w not in known})
                if len(known) + len(new) > REMEMBERED:
                    known = {}
                    new = list({w for ws in some for w in ws})
                if new:
                    fresh = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
                    order = np.argsort(fresh)
                    fresh, new = fresh[order], [new[k] for k in order.tolist()]
                    first = len(known) + 1
                    while len(keys) < first + len(new):
                        keys, values = np.concatenate([keys, keys]), np.concatenate([values, values])
                    keys[first : first + len(new)], values[first : first + len(new)] = fresh, model.word_values(fresh)
                    known.update(zip(new, range(first, first + len(new))))
                ids = np.concatenate([np.fromiter((*map(known.__getitem__, ws), 0), np.int64, len(ws) + 1) for ws in some])
                t, v = keys[ids], values[ids]
                logs = model.log10(t, v, end, pairs)
                yield told_batch(batch.column(0).slice(start, upto - start), batch.column(1).slice(start, upto - start), [len(ws) + 1 for ws in some], t, v, logs)

    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    with settings(spark, LEAN):
        told = docs.select("doc_id", "held_out", "text").mapInArrow(run, TOLD_DDL) if model.filters else dealt(docs, model, filters, folder)
        told = checkpointed(told.withColumn("row", F.monotonically_increasing_id()))
    remove(spark, folder)
    shared.unpersist()  # the executors' copies; the rows are written
    found = told.select("row", F.explode("others").alias("key")).join(rest, "key").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1)).alias("logs_rest"))
    whole = F.log10(F.lit(float(model.n + model.distinct + 1)))
    return told.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("logs_rest", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"), "score",
    )


def score_all(docs: DataFrame, modulus: int = 7, remainder: int = 2, max_mb: int = MAX_MB) -> DataFrame:
    """Learn from the documents whose crc32 remainder differs, and score all of them."""
    out = held_out("doc_id", modulus, remainder)
    with settings(docs.sparkSession, LEAN):
        model, filters, rest, _ = train(docs.where(~out).select("text"), max_mb)
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model, filters, rest)


def op2_lm(spark, sf_dir: str) -> DataFrame:
    return score_all(table(spark, sf_dir, "documents"))
