"""Packing documents into training windows by Karmarkar-Karp differencing.

A document becomes the ids of its text and one closing id. Whole windows are cut off its front; what
is left is cut into equal pieces of a quarter window at most, since many small pieces balance far
better than a few large ones. Pieces are packed in blocks of about BLOCK_TOKENS ids
inside the Arrow tasks that made them: every piece starts as a partition of the block's windows in
which all but one are empty, and the two partitions with the widest imbalance are merged, the fullest
window of one onto the emptiest of the other, until one is left. Its windows are near equal. When one
exceeds the capacity, the block gets one more window and is packed anew. What a task has left at its
end, less than a block, is dealt over groups of a block's size and packed in a second round, so that
many small partitions pad no more than a few large ones.

Memory is one block a task; nothing but a sum of lengths reaches the driver. Both rounds are written
to the shared folder before they are read, so a task that runs again changes no other row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cached_tokens import WordTable, as_bytes, batches, read_file, table, words_of
from .common import documents, stored

CAPACITY = 4096
CLOSING_ID = 2
PIECES_A_WINDOW = 4
BLOCK_TOKENS = 1 << 20
#: Bounds the merge tables where pieces are short.
BLOCK_PIECES = 8192

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def differencing(sizes, windows: int) -> np.ndarray:
    """The window of each size, by the largest differencing method over that many windows."""
    sizes = np.asarray(sizes, np.int64)
    n = len(sizes)
    labels = np.zeros(n + max(n - 1, 0) * windows, np.int32)
    if n == 0 or windows == 1:
        return labels[:n]
    # A partition is its sums, fullest window first, and the node that each window stands for.
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), len(heap), i, None))
    heapq.heapify(heap)
    upper = np.full((max(n - 1, 1), windows), -1, np.int32)
    lower = np.full((max(n - 1, 1), windows), -1, np.int32)
    empty_sums, empty_nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int32)

    def opened(entry):
        _, _, item, partition = entry
        if partition is not None:
            return partition
        sums, nodes = empty_sums.copy(), empty_nodes.copy()
        sums[0], nodes[0] = sizes[item], item
        return sums, nodes

    for merge in range(n - 1):
        first, second = opened(heapq.heappop(heap)), opened(heapq.heappop(heap))
        sums = first[0] + second[0][::-1]
        order = np.argsort(-sums, kind="stable")
        upper[merge], lower[merge] = first[1][order], second[1][::-1][order]
        nodes = np.arange(n + merge * windows, n + (merge + 1) * windows, dtype=np.int32)
        nodes[(upper[merge] < 0) & (lower[merge] < 0)] = -1
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n + merge, -1, (sums, nodes)))
    last = opened(heap[0])[1]
    labels[last[last >= 0]] = np.flatnonzero(last >= 0)
    for merge in range(n - 2, -1, -1):
        made = labels[n + merge * windows : n + (merge + 1) * windows]
        for parts in (upper[merge], lower[merge]):
            there = parts >= 0
            labels[parts[there]] = made[there]
    return labels[:n]


def pack_block(sizes, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; the window count rises until no window is above the capacity."""
    sizes = np.asarray(sizes, np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        which = differencing(sizes, windows)
        if np.bincount(which, weights=sizes, minlength=windows).max(initial=0) <= capacity:
            break
        windows += 1
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(sizes[order])
    opens = np.flatnonzero(np.diff(which[order], prepend=-1))
    before = ends - sizes[order]
    offsets = np.empty(len(sizes), np.int64)
    offsets[order] = before - np.repeat(before[opens], np.diff(opens, append=len(sizes)))
    return which, offsets


class _Writer:
    """Collects pieces and gives them out with their windows, a block at a time."""

    def __init__(self, base: int, capacity: int):
        self.next, self.capacity, self.rows, self.size = base, capacity, [], 0

    def add(self, row) -> None:
        self.rows.append(row)
        self.size += row[2]

    def full(self) -> bool:
        return self.size >= BLOCK_TOKENS or len(self.rows) >= BLOCK_PIECES

    def packed(self) -> pa.RecordBatch:
        which, offsets = pack_block([r[2] for r in self.rows], self.capacity)
        made = [(*row, self.next + int(w), int(o)) for row, w, o in zip(self.rows, which, offsets, strict=True)]
        self.next += int(which.max(initial=-1)) + 1
        self.rows, self.size = [], 0
        return to_arrow(made)


def to_arrow(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _tokenised(tables, file):
    """(doc_id, bytes of the ids with the closing one) of each row."""
    words = table(WordTable, file)
    closing = as_bytes([CLOSING_ID])
    for batch in tables:
        rows = zip(batch.column("doc_id"), batch.column("text"), strict=True)
        for some in batches(((i.as_py(), t.as_py() or "") for i, t in rows), lambda row: len(row[1]) + 64):
            parts = [words_of(text) for _, text in some]
            words.learn(set().union(*parts))
            for (doc_id, _), part in zip(some, parts, strict=True):
                yield doc_id, words.encode(part) + closing


def cuts(total: int, capacity: int):
    """(start, length) of whole windows, and of the equal pieces of the rest."""
    rest = total % capacity
    for start in range(0, total - rest, capacity):
        yield start, capacity
    parts = -(-rest * PIECES_A_WINDOW // capacity)
    for i in range(parts):
        yield total - rest + rest * i // parts, rest * (i + 1) // parts - rest * i // parts


def packer(file: bytes, capacity: int):
    """Arrow task: texts to pieces; those of whole windows and full blocks have their place already."""

    def run(tables):
        writer, whole = _Writer(TaskContext.get().partitionId() << 32, capacity), []
        for doc_id, ids in _tokenised(tables, file):
            total = len(ids) // 4
            for start, length in cuts(total, capacity):
                row = (doc_id, start, length, ids[4 * start : 4 * (start + length)], total)
                if length == capacity:
                    whole.append((*row, writer.next, 0))
                    writer.next += 1
                    if len(whole) >= 256:
                        yield to_arrow(whole)
                        whole = []
                else:
                    writer.add(row)
                    if writer.full():
                        yield writer.packed()
        yield to_arrow(whole)
        yield to_arrow([(*row, None, None) for row in writer.rows])

    return run


def finisher(capacity: int):
    """Arrow task: rows sorted by group, as (group, piece); a group is packed as one block, or a few."""

    def run(tables):
        writer, group = None, None
        for batch in tables:
            groups = batch.column("_group").to_pylist()
            rows = zip(*[batch.column(c).to_pylist() for c in _ARROW.names[:5]], strict=True)
            for g, row in zip(groups, rows, strict=True):
                if g != group:
                    if writer is not None:
                        yield writer.packed()
                    # Above every partition of the first round.
                    writer, group = _Writer((1 << 61) + (g << 32), capacity), g
                writer.add(row)
                if writer.size >= 2 * BLOCK_TOKENS or len(writer.rows) >= 2 * BLOCK_PIECES:
                    yield writer.packed()
        if writer is not None:
            yield writer.packed()

    return run


def pack(docs: DataFrame, file: bytes, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: sequence_id, and offset from 0 without gaps.

    `ids` holds a piece's ids as little-endian unsigned 32-bit numbers. A null or empty text has the
    closing id only; a null doc_id stays null; repeated rows are packed once each; further columns are
    not read. An empty table gives no rows. Ties are taken in the order of the rows.
    """
    first = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packer(file, capacity), PIECES))
    left = first.filter("sequence_id is null")
    tokens, pieces = left.agg(F.sum("length"), F.count(F.lit(1))).first()
    if not pieces:
        return first
    groups = max(1, round(tokens / BLOCK_TOKENS), round(pieces / BLOCK_PIECES))
    # A piece has its own hash, and identical pieces may share a group: it is packed in parts then.
    dealt = left.withColumn("_group", F.pmod(F.xxhash64("ids", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    rest = stored(dealt.repartition("_group").sortWithinPartitions("_group").mapInArrow(finisher(capacity), PIECES))
    return first.filter("sequence_id is not null").unionByName(rest)


def padded(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, filled and padding of each sequence; one of a power of two is not padded."""
    filled = lengths.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.withColumn("padding", F.when(power, F.lit(0)).otherwise(capacity - F.col("filled")).cast("long"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with the digest of its ids."""
    import public_tokenizers

    packed = pack(documents(spark, sf_dir), read_file(public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
