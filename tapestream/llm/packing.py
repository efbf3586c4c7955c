"""Best-fit packing of documents into fixed-length sequences, with certified bounds.

Documents become token pieces of at most one sequence; pieces are dealt by hash into
groups of about ``group_items``, and each group is packed by best-fit decreasing.  Dual
feasible functions bound a group's sequence count from below: a group that meets its bound
is certified optimal.  Groups with a gap, and the loosely filled sequences that any group
ends with, exchange their documents: they are dealt anew into fewer groups and packed
again, until the total meets the bound of all pieces or a round gains nothing.

Defined results: a null or empty text is the end id alone; null doc_ids are kept; repeated
rows are packed as often as they occur; ties go by (doc_id, piece); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep
from .tokens import word_tokenizer

#: Texts encoded at once in a worker, in rows and bytes.
ROWS, BYTES = 1000, 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, filled long, gap long"


def text_batches(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose second column, the text, has about ``size`` bytes at most."""
    step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.column(1).nbytes))))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)
    pa.default_memory_pool().release_unused()  # workers outlive their stage


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document's ids; ``with_ids`` adds them as little-endian uint32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        for whole in batches:
            for batch in text_batches(whole):
                ids, lengths = words.encode(batch.column(1))
                ends = np.cumsum(lengths)
                rows: list[tuple] = []
                for doc, first, last in zip(batch.column(0).to_pylist(), (ends - lengths).tolist(), ends.tolist()):
                    own = np.append(ids[first:last], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        data = own[start : start + capacity].tobytes()
                        rows.append((doc, piece, start, len(data) // 4, zlib.crc32(data)) + ((data,) if with_ids else ()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    A function u on sizes is dual feasible if sizes that fit one bin never sum to more
    than 1 under u.  First family: sizes above capacity - k count as a whole bin, sizes
    below k as nothing, others as they are.  Second: a size x counts as
    floor((k + 1) x) / k, or as x where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    size = np.bincount(lengths, weights=counts * lengths, minlength=capacity + 1).astype(np.int64)
    number = np.bincount(lengths, weights=counts, minlength=capacity + 1).astype(np.int64)
    at_most, many = np.cumsum(size), np.cumsum(number)
    k = np.arange(0, capacity // 2 + 1)
    below = np.where(k > 0, at_most[k - 1], 0)
    first = (many[-1] - many[capacity - k]) * capacity + at_most[capacity - k] - below
    best = int((-(-first // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * lengths
        whole = scaled % capacity == 0
        total = int((counts * np.where(whole, lengths * k, (scaled // capacity) * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in decreasing order), and what each bin holds."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, filled = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            b, left = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        left -= n
        if left:
            if not room[left]:
                mask |= 1 << left
            room[left].append(b)
    return bins, offsets, np.asarray(filled, np.int64)


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, turn: int) -> DataFrame:
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys)).drop_columns(["g"])
        lengths = table.column("length").to_numpy()
        bins, offsets, filled = best_fit_decreasing(lengths, capacity)
        gap = len(filled) - lower_bound(*np.unique(lengths, return_counts=True), capacity)
        ids = (turn << 56) + (key[0].as_py() << 24) + bins
        for name, values in (("sequence_id", ids), ("offset", offsets), ("filled", filled[bins]), ("gap", np.full(len(bins), gap))):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack, PACKED)


def pack(pieces: DataFrame, capacity: int = 4096, group_items: int = 8192, loose: float = 0.98, rounds: int = 6) -> DataFrame:
    """pieces (as of ``token_pieces``) with sequence_id and offset.

    ``group_items`` bounds what one task packs at a time (in expectation); sequences filled
    less than ``loose``, and all unfilled ones of groups with a gap, go into the exchange.
    """
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    sizes = pieces.groupBy("length").count().toPandas()  # one row per length, capacity at most
    bound = lower_bound(sizes["length"].to_numpy(), sizes["count"].to_numpy(), capacity)
    groups = max(1, -(-int(sizes["count"].sum()) // group_items))
    packed = keep(_pack_groups(pieces, groups, capacity, 0), "packed")
    settled: list[DataFrame] = []
    total = packed.where("offset = 0").count()
    for turn in range(1, rounds + 1):
        if total <= bound:
            break
        open_ = (F.col("filled") < capacity) & ((F.col("gap") > 0) | (F.col("filled") < loose * capacity))
        moving = packed.where(open_)
        n, were = moving.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if were < 2:
            break
        again = keep(_pack_groups(moving.select(pieces.columns), max(1, -(-n // group_items)), capacity, turn), "packed")
        now = again.where("offset = 0").count()
        if now >= were:
            forget(again)
            break
        settled.append(packed.where(~open_))
        packed, total = again, total - were + now
    for part in settled:
        packed = packed.unionByName(part)
    return packed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, **options) -> DataFrame:
    """Every piece of every document, with the sequence and offset where it lies."""
    return pack(keep(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, **options)
