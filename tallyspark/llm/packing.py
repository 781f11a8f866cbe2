"""Best-fit packing of token documents with certified bin counts.

Documents longer than a sequence are cut; every piece of less than a whole sequence then goes to one of several
partitions by a hash of its number. Each partition packs its pieces by best-fit decreasing, and a lower bound
from dual-feasible functions certifies its bin count where the two meet. Partitions with a gap between count and
bound exchange the documents of their open bins and are packed again, while certified ones rest. Once no such
exchange saves bins, and the whole count is above the bound of the whole table, the open bins of all partitions are
exchanged likewise: bounds of parts don't add up to that of the table. `certified` tells for each piece whether the
partition that packed it last met its bound; certificates are logged by turn. A partition holds about TARGET pieces,
whatever the table's size.

Defined results: a null or empty text is the end token alone; equal lengths are taken in order of their piece
number; repeated rows are packed as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.bpe import broadcast_vocabulary, default_vocabulary, worker_library
from tallyspark.llm.common import cut, map_slices, ship, table

log = logging.getLogger(__name__)

#: Pieces that one partition packs, on average.
TARGET = 8192
CAPACITY = 1024
END = 2
ROUNDS = 8


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end token, cut so that only the first piece may be short."""
    ship(docs.sparkSession)
    source = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, part, start, length, crc = [], [], [], [], []
        encode = worker_library(source)
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(text or ""), np.uint32(end))
            data = memoryview(ids.astype("<u4").tobytes())
            at, n = 0, len(ids)
            to, j = (n - 1) % capacity + 1, 0
            while at < n:
                row.append(k)
                part.append(j)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(data[4 * at : 4 * to]))
                at, to, j = to, to + capacity, j + 1
        arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(part, pa.int32())]
        arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", 512
    )


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The fewest bins that counts[s] items of each size s can need, by dual-feasible functions.

    Each function maps sizes so that items which share a bin still sum to at most the capacity; hence the
    mapped total over the capacity bounds the bins from below. Used are the identity, the threshold functions
    (large items grow to the capacity, small ones vanish) and the rounding functions of k parts.
    """
    size = np.arange(len(counts), dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        mapped = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
        best = max(best, -(-int((mapped * n).sum()) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * size
        mapped = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((mapped * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, fill of each bin: items by falling size, each into the fullest bin with room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0  # bit r is set if a bin has r free
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = room >> s
        if fitting:
            left = s + (fitting & -fitting).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                room ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        left -= s
        if left:
            free[left].append(b)
            room |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, fill long, bins long, bound long"


def _pack(items: DataFrame, n: int, turn: int, capacity: int, target: int) -> DataFrame:
    parts = max(1, -(-n // target))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32", "uid"]].copy()
        out["sequence_id"] = (turn << 56) + (int(key[0]) << 28) + bins
        out["offset"], out["fill"] = offsets, fill[bins]
        out["bins"], out["bound"] = len(fill), lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return out

    part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts))
    return cut(items.withColumn("part", part).groupBy("part").applyInPandas(run, _OUT))


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, target: int = TARGET, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    items = cut(pieces_df.withColumn("uid", F.monotonically_increasing_id()))
    sizes = items.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    bound, whole = lower_bound(counts, capacity), int(counts[capacity])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    done = items.where(F.col("length") == capacity)
    done = done.withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)}).select(*cols)
    n = int(counts.sum()) - whole
    if not n:
        return done
    sure = (F.col("bins") <= F.col("bound")).alias("certified")

    def census(df: DataFrame, turn: int) -> tuple[int, int, int]:
        """Bins of df, those of them with room, and those of the latter in partitions with a gap."""
        first = df.where(F.col("offset") == 0)  # one row for each bin
        room = (F.col("fill") < capacity).cast("int")
        by = first.groupBy(F.shiftright("sequence_id", 28)).agg(F.count("*").alias("here"), F.sum(room).alias("open"), F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        loose = F.sum(F.when(~sure, F.col("open")).otherwise(0)).alias("loose")
        r = by.agg(F.count("*").alias("n"), F.sum("here").alias("bins"), F.sum("open").alias("open"), loose, F.sum(sure.cast("int")).alias("sure")).collect()[0]
        log.info("Packing, turn %d: %d of %d partitions certified, %d bins", turn, r["sure"] or 0, r["n"], r["bins"] or 0)
        return r["bins"] or 0, r["open"] or 0, r["loose"] or 0

    now = _pack(items.where(F.col("length") < capacity), n, 1, capacity, target)
    total, gaps, loose = census(now, 1)
    every = False  # whether certified partitions take part
    for turn in range(2, rounds + 2):
        every = every or loose < 2
        chosen, count = (now, gaps) if every else (now.where(~sure), loose)
        if whole + total <= bound or count < 2:
            break  # certified, or nothing to exchange
        open_bins = chosen.where(F.col("fill") < capacity)
        again = _pack(open_bins.drop("sequence_id", "offset", "fill", "bins", "bound"), open_bins.count(), turn, capacity, target)
        bins, gaps_, loose_ = census(again, turn)
        if bins >= count:
            if every:
                break
            every = True
            continue
        done = done.unionByName(now.where(F.col("fill") == capacity).withColumn("certified", sure).select(*cols))
        rest = now.where(F.col("fill") < capacity)
        total -= count - bins
        # certified partitions rest, with their open bins
        now, gaps, loose = (again, gaps_, loose_) if every else (cut(again.unionByName(rest.where(sure))), gaps - count + gaps_, loose_)
    return done.unionByName(now.withColumn("certified", sure).select(*cols))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), default_vocabulary()))
