"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units: spaces and the letters that follow them. No piece crosses from a letter
to a space, so the best path through a text is the sum of the best paths through its units, and
each distinct unit needs encoding once. A task lists the units of a block of texts, in buckets by
hash, and keeps the texts as places in the list. In its bucket, each distinct unit becomes a
lattice: its substrings up to the longest piece's length are exploded and equi-joined to the piece
table (a vocabulary, of fixed size); the edges of a unit are grouped, and a higher-order fold over
them in order of their ends is Viterbi. The paths go back to the blocks, where texts are put
together. So only lists of distinct units, their paths and the compressed places move.

Scores are the model file's, taken as log probabilities. A character without a piece costs the
least score less 10 and becomes its UTF-8 bytes' pieces. Ties go to the longer last piece. A model
file whose own type is BPE is segmented by its scores all the same, not by its merge order.

A unit costs time with the square of its length (an unbroken word of 100,000 letters: seconds).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, work_partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Below the least score: the cost of a character without a piece.
UNKNOWN = 10.0
#: Buckets of units for each shuffle partition: the edges of a bucket are sorted in memory.
FINER = 8
#: Text that a task gathers in a block, in bytes.
BLOCK_BYTES = 24 << 20
#: Texts that are packed, or put together, at once.
CHUNK = 400
UNITS = re.compile(" *[^ \n]+| +|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with plain spaces, their scores, and the ids of the byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    bytes_ids: tuple[int, ...]
    size: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def unknown(self) -> float:
        return min(self.scores) - UNKNOWN

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.pieces, self.ids, self.scores, strict=True))
        return spark.createDataFrame(rows, "_piece string, _piece_id int, _score double")


@lru_cache(maxsize=4)
def vocabulary(model: str = MODEL) -> Vocabulary:
    """The model file's pieces; control and unknown pieces never match text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    names = [sp.id_to_piece(i).replace("▁", " ") for i in plain]
    if any("\n" in p or " " in p.lstrip(" ") for p in names):
        raise ValueError("units need a vocabulary without line breaks, or spaces after letters, inside pieces")
    codes = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return Vocabulary(tuple(names), tuple(sp.get_score(i) for i in plain), tuple(plain), codes, sp.get_piece_size())


def replayable(docs: DataFrame) -> DataFrame:
    """Rows that come in the same order and partitions each time: a file scan, or a stored table."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return stored(docs) if "Exchange" in plan or not docs.inputFiles() else docs


class _Places(dict):
    """Numbers keys by first appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Blocks:
    """Cuts a task's texts into units, numbered by first appearance in a block.

    A unit is keyed by what follows its first space; one without a space has a line break in front,
    which no unit holds but the line break itself. A block's name is a hash of its partition, its
    number there and its texts: blocks of the same texts stay apart, and a block that is met again
    under the same name has the same units in the same places.
    """

    def __init__(self, kind: pa.DataType, task: int, number: int, listing: bool):
        self.kind, self.listing = kind, listing
        self.places: dict | set = set() if listing else _Places()
        self.rows: list[tuple] = []
        self.size, self.hash = 0, xxhash.xxh3_64(f"{task},{number};")

    def add(self, row_id, text: str | None) -> None:
        self.hash.update(b"\xff" if text is None else text.encode() + b"\xfe")  # bytes that UTF-8 has not
        if text is None:
            if not self.listing:
                self.rows.append((row_id, None))
            return
        if "  " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
            found = [u[1:] if u[0] == " " else "\n" + u for u in UNITS.findall(" " + text)]
        else:
            found = text.replace("\n", " \n\n \n").split(" ") if text else []
        self.size += len(text)
        if self.listing:
            self.places.update(found)
        else:
            self.rows.append((row_id, np.fromiter(map(self.places.__getitem__, found), np.uint32, len(found))))

    @property
    def name(self) -> int:
        return int(np.int64(np.uint64(self.hash.intdigest())))

    def dealt(self, buckets: int) -> Iterator[tuple[int, list[str], list[int]]]:
        """(bucket, its keys in order, their numbers) of each bucket that has any; the empty rest
        that a line break leaves is none."""
        keys = [k for k in self.places if k != "\n"]
        numbers = np.arange(len(keys))
        if not self.listing and "\n" in self.places:
            numbers += numbers >= self.places["\n"]
        to = (np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)) % np.uint64(buckets)).astype(np.int64)
        spots = np.split(np.argsort(to, kind="stable"), np.cumsum(np.bincount(to, minlength=buckets))[:-1])
        for bucket, part in enumerate(spots):
            if len(part):
                order = sorted(part.tolist(), key=keys.__getitem__)
                yield bucket, [keys[i] for i in order], numbers[order]

    def units(self, buckets: int) -> Iterator[tuple[int, str]]:
        """Each bucket's units, sorted by key and joined by line breaks; an empty one stands for a line break."""
        for bucket, keys, _ in self.dealt(buckets):
            yield bucket, "\n".join([k[1:].rstrip("\n") if k[:1] == "\n" else " " + k for k in keys])

    def where(self, buckets: int) -> np.ndarray:
        """By a unit's number, its place in all of `units`; -1 for the empty rest."""
        where, n = np.full(len(self.places), -1, np.int32), 0
        for _, _, numbers in self.dealt(buckets):
            where[numbers] = np.arange(n, n + len(numbers))
            n += len(numbers)
        return where


def _blocks(batches: Iterator[pa.RecordBatch], listing: bool) -> Iterator[Blocks]:
    """Blocks of (id, text, partition) rows; when `listing`, with distinct units only, not the rows."""
    block, number = None, 0
    for batch in batches:
        for row_id, text, task in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            block = block or Blocks(batch.column(0).type, task, number, listing)
            block.add(row_id, text.as_py())
            if block.size >= BLOCK_BYTES:
                yield block
                block, number = None, number + 1
    if block:
        yield block


def _pack(codes: np.ndarray) -> bytes:
    """Places in 7-bit groups, low first: frequent units stand early and take a byte or two."""
    if not len(codes):
        return b""
    groups = np.stack([(codes >> np.uint32(7 * i)) & np.uint32(127) for i in range(5)], 1).astype(np.uint8)
    length = 1 + sum((codes >= np.uint32(1 << 7 * i)).astype(np.int64) for i in range(1, 5))
    used = np.arange(5) < length[:, None]
    more = np.arange(5) < length[:, None] - 1
    return (groups | (more * np.uint8(128)).astype(np.uint8))[used].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), starts)


def lattice_paths(units: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(_bucket, _unit, _where), one row a unit, to the same with _ids: its best path.

    Nothing is shuffled when the input is dealt by _bucket.
    """
    pieces = F.broadcast(vocab.table(units.sparkSession))
    places = F.sequence(F.lit(0), F.length("_unit") - 1)
    lengths = F.sequence(F.lit(1), F.least(F.lit(vocab.longest), F.length("_unit") - F.col("_from")))
    keys = ["_bucket", "_unit", "_where"]
    spans = units.select(*keys, F.explode(places).alias("_from")).select(*keys, "_from", F.explode(lengths).alias("_n"))
    spans = spans.withColumn("_piece", F.expr("substring(_unit, _from + 1, _n)"))
    # a single character always makes an edge, by its bytes if it has no piece
    edges = spans.join(pieces, "_piece", "left").filter("_piece_id is not null or _n = 1").select(
        *keys,
        F.struct(
            (F.col("_from") + F.col("_n")).alias("to"), (-F.col("_n")).alias("back"),
            F.coalesce("_piece_id", F.lit(-1)).alias("id"), F.coalesce("_score", F.lit(vocab.unknown)).alias("score"),
        ).alias("_edge"),
    )
    grouped = edges.groupBy("_bucket", "_unit").agg(F.sort_array(F.collect_list("_edge")).alias("_edges"), F.first("_where").alias("_where"))

    # state: scores of the last places (newest last), and for every place the edge that led there
    zero = F.struct(
        F.array(F.lit(0.0)).alias("scores"), F.array(F.struct(F.lit(0).alias("back"), F.lit(0).alias("id"))).alias("path")
    )

    def fold(s, e):
        at = F.size(s["path"]) - 1
        fresh = e["to"] > at
        # with `to` new, the newest score belongs to the place before it
        score = F.get(s["scores"], F.size(s["scores"]) + e["back"] - F.when(fresh, 0).otherwise(1)) + e["score"]
        step = F.struct(e["back"].alias("back"), e["id"].alias("id"))
        recent = F.when(F.size(s["scores"]) > vocab.longest, F.slice(s["scores"], 2, vocab.longest)).otherwise(s["scores"])
        grown = F.struct(F.array_append(recent, score).alias("scores"), F.array_append(s["path"], step).alias("path"))
        short = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
        better = F.struct(F.array_append(short(s["scores"]), score).alias("scores"), F.array_append(short(s["path"]), step).alias("path"))
        return F.when(fresh, grown).when(score > F.element_at(s["scores"], -1), better).otherwise(s)

    # from the end back to the start; a character without a piece is noted by its place, negated
    def walk(path):
        start = F.struct((F.size(path) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))

        def step(s, _):
            here = F.get(path, s["at"])
            code = F.when(here["id"] >= 0, here["id"]).otherwise(-s["at"])
            moved = F.struct((s["at"] + here["back"]).alias("at"), F.array_append(s["ids"], code).alias("ids"))
            return F.when(s["at"] > 0, moved).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.size(path) - 1), start, step, lambda s: F.reverse(s["ids"]))

    path = F.aggregate("_edges", zero, fold, lambda s: s["path"])
    found = grouped.select(*keys, F.transform(F.array(path), walk)[0].alias("_codes"))
    table = F.array(*[F.lit(i) for i in vocab.bytes_ids])

    def spelled(code):
        # ids as they are; a negative code is the place of a character, spelled by its bytes
        digits = F.hex(F.encode(F.substring("_unit", -code, F.lit(1)), "utf-8"))
        count = (F.length(digits) / 2).cast("int")
        one = lambda i: F.get(table, F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
        return F.when(code > 0, F.array(code)).otherwise(F.transform(F.sequence(F.lit(1), count), one))

    plain = F.forall("_codes", lambda c: c > 0)
    return found.select(*keys, F.when(plain, F.col("_codes")).otherwise(F.flatten(F.transform("_codes", spelled))).alias("_ids"))


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array of int).

    With `decoded`, the ids are also decoded again, in the worker that has them at hand, and that
    text is a further column of this name. Null text gives null ids, empty text none. Repeated rows
    and ids and null ids are fine, and extra columns aren't read. Empty tables give no rows.
    """
    vocab = vocabulary(model)
    rows = replayable(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.withColumn("_task", F.spark_partition_id())
    n = FINER * work_partitions(docs.sparkSession)

    # one block at a time: neither function holds on to a block while the next one is gathered
    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listing(block: Blocks) -> pa.RecordBatch:
            parts = list(block.units(n))
            columns = ([block.name] * len(parts), [b for b, _ in parts], [units for _, units in parts])
            kinds = (pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_block", "_bucket", "_units"])

        return map(listing, _blocks(batches, True))

    def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_block", "_part", "_rows", "_sizes", "_body"]
        press = zstandard.ZstdCompressor(level=3).compress

        def packed(block: Blocks) -> pa.RecordBatch:
            chunks = [(-1, [], [], press(block.where(n).tobytes()))]
            for i in range(0, len(block.rows), CHUNK):
                part = block.rows[i : i + CHUNK]
                full = [c for _, c in part if c is not None]
                body = press(_pack(np.concatenate(full)) if full else b"")
                chunks.append((i, [r for r, _ in part], [-1 if c is None else len(c) for _, c in part], body))
            columns = list(zip(*chunks, strict=True))
            kinds = [pa.int32(), pa.list_(block.kind), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([block.name] * len(chunks), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names
            )

        return map(packed, _blocks(batches, False))

    listed = rows.mapInArrow(unit_rows, "_block long, _bucket int, _units string").repartition(n, "_bucket")
    # a unit's places: one for each block that has it, as pairs of longs in one list
    at = F.array("_block", F.col("_pos").cast("long"))
    spread = listed.select("_bucket", "_block", F.posexplode(F.split("_units", "\n", -1)).alias("_pos", "_unit"))
    units = spread.groupBy("_bucket", F.when(F.col("_unit") == "", "\n").otherwise(F.col("_unit")).alias("_unit")).agg(
        F.flatten(F.collect_list(at)).alias("_where")
    )
    paths = lattice_paths(units, vocab).select("_bucket", "_where", "_ids")
    spots = F.sequence(F.lit(0), F.size("_where") - 2, F.lit(2))
    placed = paths.select("_bucket", "_where", "_ids", F.explode(spots).alias("_i")).select(
        "_bucket", F.get("_where", F.col("_i")).alias("_block"),
        F.struct(F.get("_where", F.col("_i") + 1).alias("pos"), F.col("_ids").alias("ids")).alias("_path"),
    )
    books = placed.groupBy("_bucket", "_block").agg(F.sort_array(F.collect_list("_path")).alias("_paths")).select(
        "_block", "_bucket", F.transform("_paths", lambda p: F.size(p["ids"])).alias("_counts"),
        F.flatten(F.transform("_paths", lambda p: p["ids"])).alias("_ids"),
    )
    texts = rows.mapInArrow(text_rows, f"_block long, _part int, _rows array<{kind}>, _sizes array<int>, _body binary")

    def put_together(texts: pa.Table, books: pa.Table) -> pa.Table:
        order = np.argsort(books.column("_bucket").to_numpy()) if books.num_rows else []
        flat = lambda name: [books.column(name)[int(i)].values.to_numpy(zero_copy_only=False) for i in order]
        counts, values = (np.concatenate(flat(c)) if len(order) else np.empty(0, np.int32) for c in ("_counts", "_ids"))
        starts = np.concatenate([[0], np.cumsum(counts)])  # of one block, so 32 bits hold them
        parts = dict(zip(texts.column("_part").to_pylist(), range(texts.num_rows), strict=True))
        body = lambda i: zstandard.ZstdDecompressor().decompress(texts.column("_body")[i].as_py())
        if not texts.num_rows or (where := np.frombuffer(body(parts.pop(-1)), np.int32)).max(initial=-1) != len(counts) - 1:
            raise ValueError("a block's units were not found: the input gave other rows when it was read again")
        counts, starts = np.append(counts, 0), np.append(starts[:-1], 0)  # the last stands for no unit
        spell = speller(vocab) if decoded else None
        done = []
        for i in parts.values():
            codes, lengths = where[_unpack(body(i))], texts.column("_sizes")[i].values.to_numpy()
            own = counts[codes]
            ends = np.cumsum(own)
            at = np.repeat((starts[codes] - (ends - own)).astype(np.int32), own)
            at += np.arange(len(at), dtype=np.int32)
            edges = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
            offsets = np.concatenate([[0], ends])[edges].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[at], pa.int32()), mask=pa.array(lengths < 0))
            row = [texts.column("_rows")[i].values, lists] + ([spell(lists)] if spell else [])
            done.append(pa.RecordBatch.from_arrays(row, ["doc_id", "ids"] + ([decoded] if spell else [])))
        return pa.Table.from_batches(done)

    schema = f"doc_id {kind}, ids array<int>" + (f", `{decoded}` string" if decoded else "")
    return texts.groupBy("_block").cogroup(books.groupBy("_block")).applyInArrow(put_together, schema)


def speller(vocab: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    """A function from lists of ids to their texts."""
    spelled = [b""] * (vocab.size + 1)  # the last stands for ids outside
    for i, p in zip(vocab.ids, vocab.pieces, strict=True):
        spelled[i] = p.encode()
    for b, i in enumerate(vocab.bytes_ids):
        spelled[i] = bytes([b])
    table, lengths = pa.array(spelled, pa.large_binary()), np.array([len(x) for x in spelled], np.int64)

    def spell(ids: pa.Array) -> pa.Array:
        texts = []
        for at in range(0, len(ids), CHUNK):
            part = ids.slice(at, CHUNK)
            codes = part.flatten().fill_null(vocab.size).to_numpy(zero_copy_only=False)
            codes = np.where((codes < 0) | (codes > vocab.size), vocab.size, codes)
            data = table.take(pa.array(codes)).buffers()[2]
            data = data.to_pybytes() if data else b""
            ends = np.concatenate([[0], np.cumsum(lengths[codes])])
            counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
            rows = zip(part.is_null().to_pylist(), edges, edges[1:])
            texts.append(pa.array([None if null else data[x:y].decode("utf-8", "replace")[1:] for null, x, y in rows], pa.string()))
        return pa.concat_arrays(texts) if texts else pa.array([], pa.string())

    return spell


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The input with the ids' text as a further column; null ids give null.

    Byte pieces that aren't UTF-8 together become replacement characters; ids outside the
    vocabulary and control pieces give nothing.
    """
    vocab = vocabulary(model)

    @F.arrow_udf("string")
    def spell(ids: pa.Array) -> pa.Array:
        return speller(vocab)(ids)

    return tokens.withColumn(text_col, spell(F.col(ids_col)))


def op1(spark, sf_dir):
    """Whole texts to ids and back: doc_id, n_tokens, ids, and a hash of the decoded text."""
    found = encode(documents(spark, sf_dir), decoded="text")
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("text_sha256"))
