"""SentencePiece encoding and decoding over a relational lattice.

Pieces, ids and scores come from a public model file.  Encoding maximises the
sum of the pieces' scores over all segmentations of the text with one space in
front (spaces stand for the model's word marks); a character that is no piece
falls back to the model's byte pieces at a score below every piece's.  Of equal
sums the one whose last piece is longest wins, place by place.

A text is cut into chunks between any two characters that no piece has side by
side.  No piece can cross such a cut, so the best segmentation is the chunks'
best ones in a row.

    1  the distinct chunks are counted, in each task before the shuffle
    2  lattice: each chunk's substrings of at most the longest piece's length
       are exploded and joined with the piece table on equality; the edges are
       grouped by chunk and a higher-order aggregate folds Viterbi over them in
       order of their ends.  Its state is flat: as many last scores as the longest
       piece reaches back, and one character for each place, the last piece's
       length.  Chunks of any length go this way (the aggregate copies its
       state, so one of n characters copies about 16 n^2 bytes)
    3  the ``head`` commonest chunks, a bound, are broadcast with their ids; the
       other chunks of each text are joined with the lattice's result and meet
       the text, which travels compressed, under a hash of its row
    4  ids are put together and decoded again; ``round_trip`` tells whether the
       decoded text is the source, byte for byte

Decoding joins the pieces' bytes and takes off the space in front.  It is exact
for every text, with any white space, literal word marks and unknown characters.

A null text is encoded like an empty one: the space's piece alone, which decodes
to the empty text.  Each row gives one row; repeated and null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TOKENIZERS, partitions, pieces_of, remove, shared_dir, table, texts, written

BLOCK = 256  # ends of pieces exploded from a row
HEAD = 400_000
FLUSH = 600_000  # counts that a task merges at a time
TOGETHER = 3_000_000  # bytes of texts looked up at a time, about
AT_ONCE = 400_000  # characters cut at a time, about
GROUPS = 12_000  # chunks of a task of the lattice, about
ROWS = 100  # texts whose ids are put together at a time
FALLBACK = -1e6


class Vocabulary:
    """Pieces with spaces for marks, their ids and scores, the ids of the bytes, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [(p.replace("▁", " "), i, s) for p, i, s in pieces_of(path)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        bytes_of = [b""] * sp.get_piece_size()
        for p, i, _ in self.pieces:
            bytes_of[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            bytes_of[i] = bytes([b])
        self.bytes_of = pa.array(bytes_of, pa.binary())
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if self.longest > 200:
            raise ValueError("pieces of over 200 characters")
        self.id_of = {p: i for p, i, _ in self.pieces}
        pairs = sorted({p[k : k + 2] for p, _, _ in self.pieces for k in range(len(p) - 1)})
        before, after = (sorted({q[k] for q in pairs}) for k in (0, 1))
        if (len(before) + 1) * (len(after) + 1) > 100_000_000:
            raise ValueError("pieces join too many kinds of characters")
        # joined[before[x] + after[y]]: whether a piece has x and y side by side; 0 stands for all other characters
        self.before, self.after = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        self.before[[ord(x) for x in before]] = np.arange(1, len(before) + 1) * (len(after) + 1)
        self.after[[ord(y) for y in after]] = np.arange(1, len(after) + 1)
        self.joined = np.zeros((len(before) + 1) * (len(after) + 1), bool)
        self.joined[[self.before[ord(q[0])] + self.after[ord(q[1])] for q in pairs]] = True

    def chunks(self, text: str) -> list[str]:
        return self.cut([text])[0].to_pylist()

    def cut(self, some: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The chunks of the texts, one text or more, in a row, a space in front of each text; and how many each has."""
        parts, start, size = [], 0, 0
        for k, text in enumerate(some):
            size += len(text) + 1
            if size >= AT_ONCE or k == len(some) - 1:
                parts.append(self._cut(some[start : k + 1]))
                start, size = k + 1, 0
        return pa.concat_arrays([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _cut(self, some: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        joined = "".join([x for text in some for x in (" ", text)])
        points, data = np.frombuffer(joined.encode("utf-32-le"), np.uint32), joined.encode()
        sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
        heads = np.cumsum(sizes) - sizes
        cut = np.ones(len(points), bool)
        np.logical_not(self.joined[self.before[points[:-1]] + self.after[points[1:]]], out=cut[1:])
        cut[heads] = True
        at = np.flatnonzero(cut)
        starts = at if len(data) == len(points) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[at]
        offsets = np.append(starts, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
        return found, np.diff(np.append(np.searchsorted(at, heads), len(at)))

    def decode(self, ids: np.ndarray) -> bytes:
        found = self.bytes_of.take(pa.array(ids, pa.int32()))
        return found.buffers()[2].to_pybytes()[1 : pc.sum(pc.binary_length(found)).as_py()] if len(found) else b""

    def ids(self, chunk: str, ways: str) -> bytes:
        """The ids, as int32, along the ways back that the fold found: the length of the last piece into each place, as a character from "0" on."""
        out, at = [], len(chunk)
        while at:
            start = at - ord(ways[at]) + 48
            piece = chunk[start:at]
            i = self.id_of.get(piece)
            out += (i,) if i is not None else [self.byte_ids[b] for b in reversed(piece.encode("utf-8", "replace"))]
            at = start
        return np.array(out[::-1], np.int32).tobytes()


def groups(bodies: Iterable[bytes]) -> Iterator[tuple[int, list[bytes], list[str]]]:
    """(index of the first, bodies, texts) of bodies in a row, until they have TOGETHER bytes or more."""
    some, start, size = [], 0, 0
    for k, body in enumerate(bodies):
        some.append(body)
        size += len(body)
        if size >= TOGETHER:
            yield start, some, [x.decode("utf-8", "replace") for x in some]
            some, start, size = [], k + 1, 0
    if some:
        yield start, some, [x.decode("utf-8", "replace") for x in some]


def chunk_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs: (text).  (chunk, n) over all texts; a task's are put in order, so that they pack well in the shuffle."""
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed file

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("chunk", use_threads=False).aggregate([("n", "sum")]).select(["chunk", "n_sum"]).rename_columns(schema.names)

        for batch in rows:
            for _, _, some in groups(texts(batch.column(0))):
                counts = shared.value.cut(some)[0].value_counts()
                parts.append(pa.table([counts.field(0), counts.field(1)], schema=schema))
                if sum(map(len, parts)) > FLUSH:
                    parts[:] = [merged()]
                    if 2 * len(parts[0]) > FLUSH:
                        yield from parts.pop().sort_by("chunk").to_batches(50_000)
        if parts:
            yield from merged().sort_by("chunk").to_batches(50_000)

    return docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def segmentations(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """chunks: (cid, chunk, n), cid different for each, dealt out by it.  (chunk, n, ways): the best segmentation of each chunk, for Vocabulary.ids."""
    spark = chunks.sparkSession
    pieces = spark.createDataFrame(pa.table({"piece": [p for p, _, _ in vocabulary.pieces], "score": [s for _, _, s in vocabulary.pieces]}))
    longest, col = vocabulary.longest, F.col
    # a row for each BLOCK of ends, with the characters before it that a piece may begin with; one for each end; one for each piece's length
    starts = F.sequence(F.lit(0), F.length("chunk") - 1, F.lit(BLOCK))
    first = lambda o: F.greatest(o - longest + 1, F.lit(0))
    blocks = chunks.select("cid", F.inline(F.transform(starts, lambda o: F.struct(o.alias("o"), F.substring(col("chunk"), first(o) + 1, o + BLOCK - first(o)).alias("body")))))
    blocks = blocks.select("cid", "o", "body", first(col("o")).alias("base"))
    ends = blocks.select("cid", "base", "body", F.explode(F.sequence(col("o") + 1, col("base") + F.length("body"))).alias("b"))
    reach = F.least(col("b"), F.lit(longest))
    ends = ends.select("cid", "b", F.substring(col("body"), col("b") - col("base") - reach + 1, reach).alias("tail"), reach.alias("reach"))
    spans = ends.select("cid", "b", "tail", "reach", F.explode(F.sequence(F.lit(1), col("reach"))).alias("k"))
    spans = spans.select("cid", "b", "k", F.substring(col("tail"), col("reach") - col("k") + 1, col("k")).alias("piece"))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where(col("score").isNotNull() | (col("k") == 1))  # the vocabulary is a fixed file
    edge = F.struct("b", "k", F.coalesce("score", F.lit(FALLBACK)).alias("score"))
    grouped = edges.select("cid", edge.alias("e")).groupBy("cid").agg(F.sort_array(F.collect_list("e")).alias("edges"))

    def step(state, e):
        """score and k: of the best way into place at so far; best: the scores of the places before it; ways: the k of all places before it.

        The aggregate copies its state at each step, so it is flat and small.
        """
        at, best, ways = state["at"], state["best"], state["ways"]
        a = e["b"] - e["k"]
        score = F.when(a == at, state["score"]).otherwise(F.get(best, a - at + F.size(best))) + e["score"]
        recent = F.slice(best, F.greatest(F.size(best) - longest + 1, F.lit(1)), F.lit(longest))
        on = F.struct(e["b"].alias("at"), score.alias("score"), e["k"].alias("k"), F.concat(recent, F.array(state["score"])).alias("best"), F.concat(ways, F.char(48 + state["k"])).alias("ways"))
        # lengths come in ascending order, so of equal sums the longest stays
        better = F.struct(at.alias("at"), score.alias("score"), e["k"].alias("k"), best.alias("best"), ways.alias("ways"))
        return F.when(at < e["b"], on).when(score >= state["score"], better).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("k"), F.array().cast("array<double>").alias("best"), F.lit("").alias("ways"))
    folded = grouped.select("cid", F.aggregate("edges", start, step, lambda s: F.concat(s["ways"], F.char(48 + s["k"]))).alias("ways"))
    return chunks.join(folded, "cid").select("chunk", "n", "ways")


def lattice(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The segmentations of all chunks of the texts, as a table in the shared folder."""
    spark = docs.sparkSession
    # written once, so that a chunk's number is the same in every reading
    chunks = written(chunk_counts(docs, vocabulary).withColumn("cid", F.monotonically_increasing_id()), counted := shared_dir(spark, "chunks"))
    chunks = chunks.repartition(max(partitions(spark), -(-chunks.count() // GROUPS)), "cid")
    cut = written(segmentations(chunks, vocabulary), shared_dir(spark, "lattice"))
    remove(spark, counted)
    return cut


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Head:
    """The broadcast chunks, in a row, and their ids, flat."""

    def __init__(self, vocabulary: Vocabulary, common: pa.Table):
        self.chunks = common.column("chunk").cast(pa.string()).combine_chunks()
        ids = [vocabulary.ids(c, w) for c, w in zip(self.chunks.to_pylist(), common.column("ways").to_pylist())]
        self.sizes = np.array([len(x) // 4 for x in ids], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.ids = np.frombuffer(b"".join(ids), np.int32)

    def places(self, chunks: pa.StringArray) -> np.ndarray:
        """Each chunk's place in the head, -1 if it is outside."""
        coded = chunks.dictionary_encode()
        return pc.index_in(coded.dictionary, value_set=self.chunks).fill_null(-1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]

    def fill(self, places: np.ndarray, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, flat, and how many each has; own: the ids of those outside, in their order."""
        out, extra = places < 0, np.array([len(x) // 4 for x in own], np.int32)
        sizes, starts = np.zeros(len(places), np.int32), np.zeros(len(places), np.int32)
        sizes[~out], starts[~out] = self.sizes[places[~out]], self.starts[places[~out]]
        sizes[out], starts[out] = extra, len(self.ids) + np.cumsum(extra) - extra
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        ids, apart = np.empty(len(at), np.int32), at >= len(self.ids)
        ids[~apart], ids[apart] = self.ids[at[~apart]], np.frombuffer(b"".join(own), np.int32)
        return ids, sizes


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/piece_bpe_32k.model", head: int = HEAD) -> DataFrame:
    """docs: (doc_id, text).  (doc_id, ids, n_pieces, round_trip)."""
    spark: SparkSession = docs.sparkSession
    vocabulary = Vocabulary(path)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = lattice(docs, vocabulary)
    band = F.floor(F.log2("n") * 8).cast("int")  # counts within a twelfth of each other
    tallies = cut.select(band.alias("b")).groupBy("b").count().collect()  # at most 504 rows
    least = 1 + max((r["b"] for r in tallies if sum(x["count"] for x in tallies if x["b"] >= r["b"]) > head), default=-1)
    common = cut.where(band >= least).select("chunk", "ways").toArrow()  # at most ``head`` rows
    known = spark.sparkContext.broadcast(Head(vocabulary, common))
    shared = spark.sparkContext.broadcast(vocabulary)
    key = F.xxhash64("doc_id", "text")

    def rest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for start, _, some in groups(texts(batch.column(1))):
                chunks, counts = shared.value.cut(some)
                out = np.flatnonzero(known.value.places(chunks) < 0)
                row = np.repeat(np.arange(len(some)), counts)[out]
                place = np.arange(len(out)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([pa.array(keys[start + row]), pa.array(place, pa.int32()), chunks.take(pa.array(out))], names=["key", "place", "chunk"])

    keyed = docs.select(key.alias("key"), "doc_id", "text")
    sample = [r["text"].encode() for r in docs.where(F.length("text").between(500, 20_000)).select("text").limit(400).collect()]  # shapes the packing alone
    packing = spark.sparkContext.broadcast(zstandard.train_dictionary(1 << 17, sample).as_bytes() if len(sample) >= 100 else b"")

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3, dict_data=dictionary(packing.value))
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array([codec.compress(t) for t in texts(batch.column(2))], pa.binary())], names=["key", "doc_id", "packed"])

    others = keyed.select("key", "text").mapInArrow(rest, "key long, place int, chunk string").join(cut.where(band < least).select("chunk", "ways"), "chunk")
    # bounded by the text; a key that comes twice has its places twice, with equal ways
    others = others.select("key", "place", "ways").groupBy("key").agg(F.collect_list(F.struct("place", "ways")).alias("others"))
    bodies = keyed.mapInArrow(packed, "key long, doc_id long, packed binary")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("round_trip", pa.bool_())])

    def put_together(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, head = shared.value, known.value
        codec = zstandard.ZstdDecompressor(dict_data=dictionary(packing.value))
        for batch in rows:
            for start, sources, some in groups(map(codec.decompress, batch.column(1).to_pylist())):
                chunks, counts = vocabulary.cut(some)
                places = head.places(chunks)
                out = np.flatnonzero(places < 0)
                row = np.repeat(np.arange(len(some)), counts)[out]
                place = np.arange(len(out)) - np.searchsorted(row, row)
                tails = batch.column(2).slice(start, len(some)).to_pylist()
                ways = [{o["place"]: o["ways"] for o in tail or ()} for tail in tails]
                own = [vocabulary.ids(c, ways[r][k]) for c, r, k in zip(chunks.take(pa.array(out)).to_pylist(), row.tolist(), place.tolist())]
                upto = np.append(0, np.cumsum(counts))
                for r in range(0, len(some), ROWS):
                    to = min(r + ROWS, len(some))
                    first, last = np.searchsorted(row, [r, to])
                    ids, sizes = head.fill(places[upto[r] : upto[to]], own[first:last])
                    bounds = np.append(0, np.cumsum(sizes))[upto[r : to + 1] - upto[r]]
                    fits = [vocabulary.decode(ids[a:b]) == source for a, b, source in zip(bounds[:-1], bounds[1:], sources[r:to])]
                    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start + r, to - r), listed, pa.array(np.diff(bounds), pa.int64()), pa.array(fits)], schema=schema)

    return bodies.join(others, "key", "left").select("doc_id", "packed", "others").mapInArrow(put_together, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_pieces", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"), "round_trip")
