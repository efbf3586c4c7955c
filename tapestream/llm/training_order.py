"""Token sequences in training order, in shards of fixed stride.

Documents become sequences of ``stride`` ids, the last one padded.  Sequences are numbered in
the order of doc_id, piece and crc32 of their ids, whatever the partitions of the input, and
a keyed Feistel network over the next even number of bits, walked until it lands below the
number of sequences, gives each a global slot: a permutation that any worker can compute for
any sequence alone.  A shard is a range of slots; its file is its
sequences back to back, so slot s lies at byte (s - first) * stride * width, and a reader
resumes anywhere with one seek.

Between the encoding tasks and the shards, ids are packed: the 224 likeliest in one byte, the
next 7,936 in two, the others in three (``pack``).  Which are likely is asked of the starts of
300 texts; any id can be packed by any ranking, so this decides only the size.

Recovery: ids and their places are written before slots are given, so a lost executor can't
change them; shard files are written aside and renamed, and those already there are left if
size and crc32 are those of the new content.

Defined results: null is an empty text, whose sequence is the end id; null doc_ids stay;
repeated rows are sequences of their own; an empty table gives no sequence and no shard;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import text_batches
from .store import keep
from .tokens import word_tokenizer

#: Pads a sequence; no id of a vocabulary that fits 16 bits.
PAD = 0xFFFF
WIDTH = 2
#: Ids of one byte; the heads from here to 254 are followed by a byte, 255 by two.
ONE = 224
#: Texts, and characters of each, that rank the ids.
RANKED_BY = (300, 3000)
SEQUENCES = "doc_id long, piece int, n_tokens int, ids binary, crc long, part int, place int"
#: Slots of up to so many sequences are broadcast to the tables of ids; beyond, both sides are shuffled by part and place.
BROADCAST_SLOTS = 5_000_000


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of range(n) at the given places."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 2**63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (out >= n).any():
        beyond = out >= n
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def ranked_ids(docs: DataFrame, tokenizer: str) -> np.ndarray:
    """All uint16, those that are frequent in the starts of some texts first."""
    texts, characters = RANKED_BY
    some = [r.text or "" for r in docs.select(F.substring("text", 1, characters).alias("text")).take(texts)]
    ids = word_tokenizer(tokenizer).encode(pa.array(some, pa.string()))[0].astype(np.int64)
    return np.argsort(-np.bincount(ids, minlength=PAD + 1)[: PAD + 1], kind="stable").astype("<u2")


def pack(ids: np.ndarray, ends: np.ndarray, ranked: np.ndarray) -> list[bytes]:
    """Rows of ids, at least one, that end at ``ends``, each as heads (a byte per id), then second bytes, then third ones of the ids that have them."""
    rank = np.empty(PAD + 1, np.int32)
    rank[ranked] = np.arange(PAD + 1)
    two, three = rank >= ONE, rank >= ONE + (255 - ONE) * 256
    heads = np.where(three, 255, np.where(two, ONE + (rank - ONE) // 256, rank)).astype(np.uint8)[ids]
    starts, more, most = np.append(0, ends[:-1]), heads >= ONE, heads == 255
    second = np.where(three, rank & 255, (rank - ONE) & 255).astype(np.uint8)[np.compress(more, ids)]
    third = (rank >> 8).astype(np.uint8)[np.compress(most, ids)]
    a, b = (np.append(0, np.cumsum(np.add.reduceat(x, starts, dtype=np.int64))).tolist() for x in (more, most))
    at = np.append(0, ends).tolist()
    heads, second, third = heads.tobytes(), second.tobytes(), third.tobytes()
    return [heads[at[i] : at[i + 1]] + second[a[i] : a[i + 1]] + third[b[i] : b[i + 1]] for i in range(len(ends))]


def unpack(packed: pa.Array, n: np.ndarray, stride: int, ranked: np.ndarray) -> np.ndarray:
    """The packed rows' n ids, padded: a row of ``stride`` uint16 for each."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    start = offsets[:-1] - offsets[0]

    def part(first: np.ndarray, length: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + length, -1)
        return np.compress(np.cumsum(edge[:-1], dtype=np.int8).view(bool), data)

    heads = part(start, n)
    begins = np.cumsum(n) - n
    more, most = heads >= ONE, heads == 255
    seconds = np.add.reduceat(more, begins, dtype=np.int64)
    second, third = part(start + n, seconds), part(start + n + seconds, np.add.reduceat(most, begins, dtype=np.int64))
    rank = heads.astype(np.uint16)
    at = np.flatnonzero(more)
    tail = (rank[at] - ONE) * np.uint16(256) + ONE + second
    last = np.flatnonzero(most[at])
    tail[last] = second[last] + third.astype(np.uint16) * np.uint16(256)
    rank[at] = tail
    out = np.full((len(n), stride), PAD, "<u2")
    out[np.arange(stride) < n[:, None]] = ranked[rank]
    return out


def sequences(docs: DataFrame, tokenizer: str, stride: int, end_id: int, ranked: np.ndarray) -> DataFrame:
    """doc_id, piece, n_tokens, ids (packed), the crc32 of the ids (little-endian uint16), and where each was written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, place = word_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_batches(whole):
                ids, lengths = words.encode(batch.column(1))
                if len(ids) and ids.max() >= PAD:
                    raise ValueError("the vocabulary doesn't fit 16 bits")
                ends = np.cumsum(lengths)
                ids, ends = np.insert(ids.astype("<u2"), ends, end_id), ends + np.arange(1, len(ends) + 1)
                data, rows, cuts = memoryview(ids.tobytes()), [], []
                for doc, first, last in zip(batch.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    for piece, start in enumerate(range(first, last, stride)):
                        cuts.append(min(start + stride, last))
                        rows.append((doc, piece, cuts[-1] - start, None, zlib.crc32(data[start * WIDTH : cuts[-1] * WIDTH]), part, place))
                        place += 1
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
                columns = list(zip(*rows)) if rows else [()] * len(types)
                columns[3] = pack(ids, np.array(cuts), ranked) if rows else ()
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "n_tokens", "ids", "crc", "part", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SEQUENCES)


def training_order(docs: DataFrame, tokenizer: str, stride: int = 512, end_id: int = 1, shard_rows: int = 16384, key: int = 11) -> DataFrame:
    """slot, shard, byte_offset, doc_id, piece, n_tokens and ids (padded to the stride), in slot order within shards."""
    ranked = ranked_ids(docs, tokenizer)
    rows = keep(sequences(docs, tokenizer, stride, end_id, ranked), "sequences", "zstd")
    keys = rows.select("doc_id", "piece", "crc", "part", "place").repartitionByRange("doc_id", "piece", "crc")
    keys = keep(keys.withColumn("range", F.spark_partition_id()), "sequence-keys")
    ranges = keys.groupBy("range").count()
    before = F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    ranges = keep(ranges.select("range", before.alias("before"), "count"), "ranges")  # a row per sorting task
    n = ranges.agg(F.sum("count")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    index = F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "piece", "crc", "part", "place")) - 1
    slots = keys.join(F.broadcast(ranges), "range").withColumn("index", (F.col("before") + index).cast("long")).select("part", "place", slot("index").alias("slot"))
    if n <= BROADCAST_SLOTS:  # a list per writing task
        lists = slots.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "slot"))).alias("slots")).select("part", F.col("slots.slot").alias("slots"))
        placed = rows.join(F.broadcast(keep(lists, "slots")), "part").withColumn("slot", F.get("slots", "place")).drop("slots")
    else:
        placed = rows.join(slots, ["part", "place"])
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
    shards = max(1, -(-n // shard_rows))
    dealt = placed.select("slot", "shard", "doc_id", "piece", "n_tokens", "ids").repartitionByRange(shards, "shard").sortWithinPartitions("slot")
    offset = (F.col("slot") - F.col("shard").cast("long") * shard_rows) * stride * WIDTH

    def padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = unpack(batch.column(6), batch.column(5).to_numpy().astype(np.int64), stride, ranked)
                ends = pa.py_buffer(np.arange(len(ids) + 1, dtype=np.int32) * stride * WIDTH)
                yield pa.record_batch([*batch.columns[:6], pa.Array.from_buffers(pa.binary(), len(ids), [None, ends, pa.py_buffer(ids)])], batch.schema.names)

    ordered = dealt.select("slot", "shard", offset.alias("byte_offset"), "doc_id", "piece", "n_tokens", "ids")
    return ordered.mapInArrow(padded, ordered.schema)


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """Writes ``{uri}/shard-00000.bin`` and so on; a row per shard: shard, n_sequences, n_bytes, crc32, written.

    Any file system that Arrow opens by uri.  A file of the right size and crc32 is kept, so
    a job that broke off goes on where it was.
    """
    by_shard = ordered.select("shard", "byte_offset", "ids").repartition("shard").sortWithinPartitions("shard", "byte_offset")
    return by_shard.mapInArrow(_writer(uri), "shard int, n_sequences long, n_bytes long, crc32 long, written boolean")


def write_sequences(ordered: DataFrame, uri: str) -> DataFrame:
    """Writes the same files, from the ranges that training_order dealt; the rows of ordered, with crc32
    of the sequence as read from its file at byte_offset instead of ids."""
    rows = ordered.select("shard", "byte_offset", "ids", "slot", "doc_id", "piece", "n_tokens")
    return rows.mapInArrow(_writer(uri, True), "slot long, shard int, byte_offset long, doc_id long, piece int, n_tokens int, crc32 long")


def _writer(uri: str, each: bool = False):
    """Of rows in order of shard and byte_offset: a row per shard, or with ``each`` per sequence."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)

        def file_crc(name: str) -> int:
            crc = 0
            with files.open_input_file(name) as f:
                while data := f.read(1 << 22):
                    crc = zlib.crc32(data, crc)
            return crc

        def shard(rows: pa.Table, number: int) -> pa.RecordBatch:
            name = f"{base}/shard-{number:05d}.bin"
            ids = [memoryview(x.as_buffer()) for chunk in rows.column("ids").chunks for x in chunk]
            size, crc = sum(map(len, ids)), 0
            for x in ids:
                crc = zlib.crc32(x, crc)
            there = files.get_file_info(name)
            kept = there.type == fs.FileType.File and there.size == size and file_crc(name) == crc
            if not kept:
                aside = f"{name}.{TaskContext.get().taskAttemptId()}"
                with files.open_output_stream(aside, buffer_size=1 << 20) as out:
                    for x in ids:
                        out.write(x)
                files.move(aside, name)
            if not each:
                return pa.record_batch([[number], [len(ids)], [size], [crc], [not kept]], pa.schema([("shard", pa.int32()), ("n_sequences", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64()), ("written", pa.bool_())]))
            with files.open_input_file(name) as f:
                data = memoryview(f.read())
            crcs = [zlib.crc32(data[at : at + len(x)]) for at, x in zip(rows.column("byte_offset").to_pylist(), ids)]
            names = ["slot", "shard", "byte_offset", "doc_id", "piece", "n_tokens"]
            return pa.record_batch([*(rows.column(c).combine_chunks() for c in names), pa.array(crcs, pa.int64())], [*names, "crc32"])

        own: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if last > first:
                    if own and numbers[first] != at:
                        yield shard(pa.Table.from_batches(own), at)
                        own = []
                    at = int(numbers[first])
                    own.append(batch.slice(first, last - first))
        if own:
            yield shard(pa.Table.from_batches(own), at)

    return write


def read_slots(uri: str, first: int, stride: int, shard_rows: int) -> Iterator[np.ndarray]:
    """Sequences in slot order from slot ``first`` on."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(uri)
    number, skip = divmod(first, shard_rows)
    while (info := files.get_file_info(f"{base}/shard-{number:05d}.bin")).type == fs.FileType.File:
        with files.open_input_file(info.path) as f:
            f.seek(skip * stride * WIDTH)
            while data := f.read(stride * WIDTH):
                yield np.frombuffer(data, "<u2")
        number, skip = number + 1, 0
