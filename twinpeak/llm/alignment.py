"""Cross-tokenizer alignment by diagonal run skipping, and the corpus-wide counts of linked ids.

Both tokenizers give the byte offsets at which their tokens end. Two places walk the two lists of
ends; as long as the ends at the current index shift are equal, exponentially longer slices are
compared and the whole one-to-one stretch is jumped. At the first unequal end the irregular group is
resolved locally: the token that ends first is passed until both end together, which sets the new
shift. Only equal ends are cuts, so a text's cuts are all the places where both tokenizers end.

Both end at the end of every chunk of a text (see `cached_tokens`), so for the counts and digests each
worker aligns the new distinct chunks of a batch, as one text, and puts the texts together from them.

A and B tokens that end together hold the same bytes before that place, so one is a suffix of the
other. All id pairs that can ever be linked are therefore known from the two vocabularies alone: at
most one for each suffix of a vocabulary entry. That list is the proven bound of what is counted,
gathered and broadcast here; the links themselves never leave their rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cached_tokens import MOST_OF_TWO, ByteTable, PieceTable, Table, batches, chunks_of, read_file, slices, table
from .common import documents, stored

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary"
_IDS = pa.list_(pa.int32())
_ALIGNED_TYPES = [pa.int64(), _IDS, _IDS, _IDS, _IDS]
_DIGEST_TYPES = [pa.int64()] * 4 + [pa.string(), pa.binary()]
_GROUPS: dict = {}


def diagonal_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Stretches (i, j, length) in which a[i + k] == b[j + k]; both lists rise strictly.

    Every value that both lists hold lies in exactly one stretch.
    """
    runs, i, j, n, m = [], 0, 0, len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            length, step, most = 1, 1, min(n - i, m - j)
            # Longer and longer slices are equal ...
            while length < most and a[i + length : i + length + step] == b[j + length : j + length + step]:
                length += step
                step *= 2
            length = min(length, most)
            # ... until one is not: the stretch ends within it.
            while step > 1 and length < most:
                step //= 2
                if a[i + length : i + length + step] == b[j + length : j + length + step]:
                    length = min(length + step, most)
            runs.append((i, j, length))
            i += length
            j += length
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return runs


def cut_places(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the last A and the last B token of each group."""
    runs = np.array(diagonal_runs(a, b), np.int64).reshape(-1, 3)
    lengths = runs[:, 2]
    steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(runs[:, 0], lengths) + steps, np.repeat(runs[:, 1], lengths) + steps


class Pairs:
    """All id pairs whose bytes end alike, numbered in order of (b, a)."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        a_of, b_of = _by_bytes(a_bytes), _by_bytes(b_bytes)
        codes = set()
        for one, other, code in ((a_of, b_of, lambda x, y: y << 32 | x), (b_of, a_of, lambda x, y: x << 32 | y)):
            for token, ids in one.items():
                for cut in range(len(token)):
                    for y in other.get(token[cut:], ()):
                        codes.update(code(x, y) for x in ids)
        self.codes = np.array(sorted(codes), np.int64)

    def number(self, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, b_ids.astype(np.int64) << 32 | a_ids.astype(np.int64)).astype("<i4")


def _by_bytes(entries: list[bytes]) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    for i, entry in enumerate(entries):
        if entry:
            found.setdefault(entry, []).append(i)
    return found


class GroupTable(Table):
    """Chunk to its groups: (their part of the digest's text, numbers of the linked pairs, how many A and B tokens).

    Both tokenizers end at the end of a chunk, so the groups of the chunks, put together, are those of the text.
    """

    most = MOST_OF_TWO

    def __init__(self, a_table: ByteTable, b_table: PieceTable):
        super().__init__()
        self.a, self.b = a_table, b_table
        self.pairs = Pairs(a_table.token_bytes, b_table.token_bytes)

    def add(self, fresh) -> None:
        """The fresh chunks are aligned as one text; those whose bytes don't come back are left out of it."""
        for t in (self.a, self.b):
            t.learn(fresh)
        odd = fresh & (self.a.odd | self.b.odd)
        self.odd |= odd
        self.known.update(dict.fromkeys(odd))
        words = list(fresh - odd)
        a, b = ([t.known[w] for w in words] for t in (self.a, self.b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b))
        # They are kept here in their final form.
        for t in (self.a, self.b):
            t.known.clear()
            t.odd.clear()
        a_ids, b_ids = (np.frombuffer(b"".join(x), "<u4") for x in (a, b))
        if not words:
            return
        a_ends, b_ends = group_ends(a_ids, b_ids, self.a, self.b)
        spelled, sizes = _spelled(a_ids, b_ids, a_ends, b_ends)
        spelled = "".join(spelled).encode()
        linked = self.pairs.number(a_ids[a_ends - 1], b_ids[b_ends - 1]).tobytes()
        a_stops, b_stops = np.cumsum(n_a), np.cumsum(n_b)
        texts = slices(spelled, np.cumsum(sizes)[a_stops + b_stops - 1])
        links = slices(linked, 4 * np.searchsorted(a_ends, a_stops, "right"))
        self.known.update(zip(words, zip(texts, links, n_a.tolist(), n_b.tolist(), strict=True), strict=True))


def group_table(a_file: bytes, b_file: bytes) -> GroupTable:
    """This worker's table of two files."""
    key = (hash(a_file), hash(b_file))
    if key not in _GROUPS:
        _GROUPS[key] = GroupTable(table(ByteTable, a_file), table(PieceTable, b_file))
    return _GROUPS[key]


def _chunked(tables):
    """Lists of (doc_id, text, chunks of the text)."""
    for batch in tables:
        rows = zip(batch.column("doc_id"), batch.column("text"), strict=True)
        for some in batches(((i.as_py(), t.as_py() or "") for i, t in rows), lambda row: len(row[1]) + 64):
            yield [(doc_id, text, chunks_of(" " + text) if text else []) for doc_id, text in some]


def _rows(made: list[tuple], schema: str, types: list) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)


def aligner(a_file: bytes, b_file: bytes):
    """Arrow task: (doc_id, text) to the rows of `align`."""

    def run(tables):
        a_table, b_table = table(ByteTable, a_file), table(PieceTable, b_file)
        for some in _chunked(tables):
            every = set().union(*(part for _, _, part in some))
            a_table.learn(every)
            b_table.learn(every)
            yield _rows([(i, *_groups(*_aligned(text, part, a_table, b_table))) for i, text, part in some], ALIGNED, _ALIGNED_TYPES)

    return run


def digester(a_file: bytes, b_file: bytes):
    """Arrow task: (doc_id, text) to rows of DIGESTS; every distinct chunk is aligned once."""

    def run(tables):
        groups = group_table(a_file, b_file)
        for some in _chunked(tables):
            groups.learn(set().union(*(part for _, _, part in some)))
            yield _rows([(i, *_digests(text, part, groups)) for i, text, part in some], DIGESTS, _DIGEST_TYPES)

    return run


def _aligned(text, part, a_table, b_table):
    """Ids by both tokenizers, and for each group how many of each have ended with it."""
    a, b = a_table.encode(part), b_table.encode(part)
    # Parts that give their bytes back give the whole text back.
    if not text or any(not t.odd.isdisjoint(part) and not t.gives_back(ids, " " + text) for t, ids in ((a_table, a), (b_table, b))):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing
    a_ids, b_ids = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    return a_ids, b_ids, *group_ends(a_ids, b_ids, a_table, b_table)


def group_ends(a_ids, b_ids, a_table, b_table):
    """For each group how many A and B tokens have ended with it."""
    a_last, b_last = cut_places(np.cumsum(a_table.lengths[a_ids]).tolist(), np.cumsum(b_table.lengths[b_ids]).tolist())
    return a_last + 1, b_last + 1


def _groups(a_ids, b_ids, a_ends, b_ends):
    return [x.astype(np.int32) for x in (a_ids, b_ids, np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0))]


def _digests(text, part, groups):
    if not part:
        return 0, 0, 0, "", b""
    if not groups.odd.isdisjoint(part):
        every = set(part)
        groups.a.learn(every)
        groups.b.learn(every)
        a_ids, b_ids, a_ends, b_ends = _aligned(text, part, groups.a, groups.b)
        if len(a_ids) == 0:
            return 0, 0, 0, "", b""
        linked = groups.pairs.number(a_ids[a_ends - 1], b_ids[b_ends - 1]).tobytes()
        return len(a_ids), len(b_ids), len(a_ends), groups_digest(a_ids, b_ids, a_ends, b_ends), linked
    texts, links, n_a, n_b = zip(*map(groups.known.__getitem__, part), strict=True)
    linked = b"".join(links)
    return sum(n_a), sum(n_b), len(linked) // 4, hashlib.sha256(b"".join(texts)[:-1]).hexdigest(), linked


def align(docs: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """Per document its ids by both tokenizers, and how many of each every group takes.

    The last tokens of a group are linked. A null or empty text, or one that either tokenizer's bytes
    don't give back, has no tokens. A null doc_id stays null, repeated rows give a row each, other
    columns are not read; an empty table gives no rows. A very long text is one row's work, in time
    with its length.
    """
    return _texts(docs).mapInArrow(aligner(a_file, b_file), ALIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links): how many links hold each pair, summed in the tasks before the exchange."""

    def count(tables):
        totals = np.zeros(0, np.int64)
        for batch in tables:
            for cell in batch.column("pairs"):
                found = np.bincount(np.frombuffer(cell.as_buffer() or b"", "<i4"))
                if len(found) > len(totals):
                    totals = np.concatenate([totals, np.zeros(len(found) - len(totals), np.int64)])
                totals[: len(found)] += found
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(totals[there], pa.int64())], ["pair", "links"])

    return aligned.select("pairs").mapInArrow(count, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))


def describe(docs: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """Counts of each document's alignment, a digest of its groups, and its links' counts over all documents.

    Only the digests and the numbers of the linked pairs (their places in `Pairs`, as little-endian
    32-bit numbers) are kept between the two passes. Input cases are those of `align`.
    """
    aligned = stored(_texts(docs).mapInArrow(digester(a_file, b_file), DIGESTS))
    pairs = Pairs(ByteTable(a_file).token_bytes, PieceTable(b_file).token_bytes)
    # At most one row for each suffix of a vocabulary entry, whatever the input.
    counted = pair_counts(aligned).toArrow()
    counts = np.zeros(len(pairs.codes), np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("links").to_numpy()
    b_ids = pairs.codes >> 32
    most = np.zeros(int(b_ids.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b_ids, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == most[b_ids]))

    def run(tables):
        counts, best = shared.value
        for batch in tables:
            numbers = [np.frombuffer(cell.as_buffer() or b"", "<i4") for cell in batch.column("pairs")]
            sums = ([len(x) for x in numbers], [int(best[x].sum()) for x in numbers], [int(counts[x].sum()) for x in numbers])
            kept = batch.drop_columns(["pairs"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.int64()) for x in sums)], [*kept.schema.names, "n_links", "n_best", "count_sum"])

    made = aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups_digest(a_ids, b_ids, a_ends, b_ends) -> str:
    """SHA-256 of `a1,a2|b1;a3|b2,b3`."""
    return hashlib.sha256("".join(_spelled(a_ids, b_ids, a_ends, b_ends)[0])[:-1].encode()).hexdigest()


def _spelled(a_ids, b_ids, a_ends, b_ends) -> tuple[list[str], np.ndarray]:
    """The parts of `a1,a2|b1;a3|b2,b3;`, a token each, and their lengths."""
    words = _numerals(int(max(a_ids.max(), b_ids.max())) + 1)
    a_sizes, b_sizes = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    out, ids = np.empty(len(a_ids) + len(b_ids), object), np.empty(len(a_ids) + len(b_ids), np.int64)
    # A token stands after all A tokens and all groups' B tokens before it; each brings what follows it.
    a_at = np.arange(len(a_ids)) + np.repeat(b_ends - b_sizes, a_sizes)
    b_at = np.arange(len(b_ids)) + np.repeat(a_ends, b_sizes)
    out[a_at], out[b_at] = words[0][a_ids], words[0][b_ids]
    out[a_at[a_ends - 1]], out[b_at[b_ends - 1]] = words[1][a_ids[a_ends - 1]], words[2][b_ids[b_ends - 1]]
    ids[a_at], ids[b_at] = a_ids, b_ids
    return out.tolist(), np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 2


def _numerals(most: int) -> list[np.ndarray]:
    """Decimal numbers up to the largest id seen, followed by each of the marks."""
    if not _NUMERALS or len(_NUMERALS[0]) < most:
        _NUMERALS[:] = [np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"]
    return _NUMERALS


_NUMERALS: list = []


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a_file, b_file = (read_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return describe(documents(spark, sf_dir), a_file, b_file)
