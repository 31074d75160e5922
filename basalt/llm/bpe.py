"""Byte-level BPE by a global shuffle of distinct words.

Encoding: the texts are cut into chunks of whole texts. Each chunk's pre-tokens are exploded into
its distinct words and, for each position, the number of the word there. The words alone travel:
each goes to the bucket of its hash, where every distinct word is encoded once, and
its ids are joined back to the chunks that asked for it. A chunk then puts the ids in the order of
its positions. Words travel in blocks, one for each chunk and hash bucket, so that a word found in
every text costs one entry a chunk, never a row an occurrence. Buckets are as many as the bytes of
the texts need, so the words of one fit a task at every size of the input.

Decoding joins ids with the table of token bytes, a table of the vocabulary's size, in each worker: of any table
by decode(), or in the workers that encode.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import byte_groups, lean, lean_group, saved, ship, utf8_offsets
from basalt.llm.pretokens import pretokens_of

CHUNK_BYTES = 4 << 20
SLICE_TOKENS = 1 << 18
#: Bytes of text for each bucket of words, and for each task that puts chunks together.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: Bytes of ids that are decoded at a time.
DECODE_BYTES = 1 << 20


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: token bytes and their ids, from a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Unsigned 32-bit arrays, a byte plane at a time, and a tail of bytes, compressed."""
    parts = [np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*parts, tail]))


def unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", n, 4).tolist()
    at, out = 4 + 4 * n, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").reshape(size))
        at += 4 * size
    return out, raw[at:]


def ragged(lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The positions begins[i], begins[i] + 1, ... of lengths[i] entries each, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(begins - (ends - lengths), lengths)


def chunks(batches, first: int):
    """Groups of whole texts of about CHUNK_BYTES: chunk number, ids and texts (Arrow arrays)."""
    number, ids, texts, size = first, [], [], 0
    for batch in batches:
        column = pc.fill_null(batch.column(1), "")
        at = utf8_offsets(column) if len(column) else np.zeros(1, np.int64)
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(at, at[start] + CHUNK_BYTES - size, "right")) - 1
            stop = min(max(stop, start if texts else start + 1), len(column))
            if stop > start:
                ids.append(batch.column(0).slice(start, stop - start))
                texts.append(column.slice(start, stop - start))
                size += int(at[stop] - at[start])
            if stop < len(column) or size >= CHUNK_BYTES:
                yield number, pa.chunked_array(ids), pa.chunked_array(texts)
                number, ids, texts, size = number + 1, [], [], 0
            start = stop
    if texts:
        yield number, pa.chunked_array(ids), pa.chunked_array(texts)


def ranked(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words by falling frequency, the number of the word at each position, bounds of the texts."""
    words, index, bounds = pretokens_of(texts)
    order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words.take(pa.array(order)).to_pylist(), rank[index], bounds


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, decoded_col: str | None = None) -> DataFrame:
    """One row for each input row: the id and `ids`, the token ids as little-endian unsigned 32-bit
    integers in one binary value.

    path: a .tiktoken file of ranks that each worker can open; pattern: the pre-token pattern the
    array rules of `pretokens` stand for, used for encoding each word. Null and empty texts have
    no ids (an empty value); null ids and repeated rows stay; an empty table gives an empty one;
    other columns are ignored. A text is never cut: a chunk holds at least one whole text.

    Two shuffles: blocks of distinct words by hash bucket, and their ids and the positions by chunk.
    buckets: the number of hash buckets; if not given, one for each BUCKET_BYTES of the texts, and at least
    spark.sql.shuffle.partitions. A bucket's distinct words are held in a worker while it is encoded.
    decoded_col: a column for what decode() makes of the ids, in the worker that has them: a second worker beside
    it, and ids on their way there, take memory of the executor.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if "Exchange" in source._jdf.queryExecution().executedPlan().toString():
        source = saved(source, "bpe-texts")  # both branches must see the same partitions
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, tasks = buckets or max(least, -(-size // BUCKET_BYTES)), max(least, -(-size // TASK_BYTES))
    kind = source.schema[0].dataType.simpleString()
    at = f"chunk long, ids array<{kind}>, bounds array<long>, positions binary, words binary"

    def split(batches):
        for number, _, texts in chunks(batches, TaskContext.get().partitionId() << 32):
            words, _, _ = ranked(texts)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            present, cuts = np.unique(bucket[order], return_index=True)
            rows = []
            for b, own in zip(present.tolist(), np.split(order, cuts[1:]) if words else (), strict=True):
                part = [words[i] for i in own]
                rows.append((b, number, pack(own, np.fromiter(map(len, part), np.int64, len(part)), tail=b"".join(part))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "words"])

    def encoded(batches):
        encode_word = encoder(path, pattern)
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            for bucket, number, blob in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                if bucket != last:  # a bucket's blocks follow each other, and no other bucket has its words
                    known, last = {}, bucket
                (own, sizes), tail = unpack(blob)
                ends = np.cumsum(sizes).tolist()
                ids, begin = [], 0
                for end in ends:
                    word = tail[begin:end]
                    begin = end
                    got = known.get(word)
                    if got is None:
                        known[word] = got = encode_word(word.decode("utf-8"))
                    ids.append(got)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(own, lengths, flat)], pa.binary())], names=["chunk", "words"])

    def positions(batches):
        for number, ids, texts in chunks(batches, TaskContext.get().partitionId() << 32):
            _, index, bounds = ranked(texts)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([bounds.tolist()], pa.list_(pa.int64())), pa.array([pack(index)], pa.binary()), pa.array([None], pa.binary())], names=["chunk", "ids", "bounds", "positions", "words"])

    def reassemble(table: pa.Table) -> pa.Table:
        whole = table.filter(pc.is_valid(table.column("positions")))
        ids = whole.column("ids").combine_chunks().flatten()
        bounds = whole.column("bounds").combine_chunks().flatten().to_numpy()
        (index,), _ = unpack(whole.column("positions")[0].as_py())
        own, lengths, flat = [], [], []
        for blob in table.column("words"):
            if blob.is_valid:
                (a, b, c), _ = unpack(blob.as_py())
                own.append(a)
                lengths.append(b)
                flat.append(c)
        sizes = np.zeros(sum(map(len, own)), np.int64)
        begins = np.zeros(len(sizes), np.int64)
        if own:
            own, lengths, flat = map(np.concatenate, (own, lengths, flat))
            sizes[own] = lengths
            begins[own] = np.cumsum(lengths, dtype=np.int64) - lengths
        parts = []
        for i in range(0, len(index), SLICE_TOKENS):
            part = index[i : i + SLICE_TOKENS]
            parts.append(flat[ragged(sizes[part], begins[part])])
        out = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes[index])])[bounds] * 4
        column = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out.astype("<u4").tobytes())])
        found = pa.table([ids, column], names=[id_col, "ids"])
        if decoded_col is None:
            return found
        return pa.Table.from_batches(decoded(found.to_batches(), token_bytes(path), 1, [id_col, "ids", decoded_col]))

    words = source.mapInArrow(lean(split), "bucket int, chunk long, words binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = words.mapInArrow(lean(encoded), "chunk long, words binary")
    order = source.mapInArrow(lean(positions), at)
    both = order.unionByName(answers, allowMissingColumns=True)
    return both.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(lean_group(reassemble), f"`{id_col}` {kind}, ids binary" + (f", `{decoded_col}` binary" if decoded_col else ""))


def decoded(batches, table: list[bytes], where: int, names: list[str]):
    """The batches, in parts of DECODE_BYTES of ids, with the bytes of the ids in column `where` as last column."""
    for batch in batches:
        for a, b in byte_groups(batch.column(where), DECODE_BYTES):
            part = batch.slice(a, b - a)
            out = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=names)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of the input and the bytes its ids stand for (null where the ids are null; an
    id outside the vocabulary is an error). out_col replaces a column of that name. Narrow."""
    ship(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != out_col]
    source = encoded.select(*(F.col(f"`{c}`") for c in rest))
    where = rest.index(ids_col)

    def run(batches):
        yield from decoded(batches, token_bytes(path), where, [*rest, out_col])

    from pyspark.sql import types as T

    return source.mapInArrow(lean(run), T.StructType([*source.schema.fields, T.StructField(out_col, T.BinaryType())]))
