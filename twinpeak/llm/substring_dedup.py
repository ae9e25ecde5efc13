"""Substring dedup by collinear chaining: passages that repeat, with edits, across documents.

Seeds are k-mers of words, thinned to minimizers: of each run of `WINDOW` k-mers the one with the
smallest hash, so an equal stretch of WINDOW + K - 1 words always shares one. Every seed that two
documents share is matched with the seed's first document; those that no passage covers then are
matched again, with the document before in the seed's order, and what is left after that in twos, with
the first document that holds both. Last, every stretch of LEAST_WORDS words that lies in no passage is
matched with the first document that holds it whole; as that one gives the passage, no other holder is
needed, and no equal passage is lost. The matches of a pair of documents are chained: a chain keeps order in both texts and weighs its seeds less the cost of its gaps, found by
a Fenwick tree of prefix maxima. Good chains are aligned word by word from end to end and grown
outwards, which gives the passage on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, documents, settled, stored, work_partitions
from .jaccard_join import _grouped, _mix

#: Words of a seed, and seeds out of which one is taken.
K, WINDOW = 6, 16
#: Words that a passage has at least on both sides, and matched words per 100 of its longer side.
LEAST_WORDS, LEAST_MATCH = 50, 70
#: Cost of a word of gap in a chain, in words, and the longest gap inside a passage.
GAP_COST, GAP_MOST = 0.2, 60
#: Words that the seeds of a pair of documents must span in both; those of an equal passage of
#: LEAST_WORDS span LEAST_WORDS - K - 2 * (WINDOW - 1) at least.
LEAST_SPAN = LEAST_WORDS - K - 2 * (WINDOW - 1)
#: Words of a run; of each stretch of LEAST_WORDS words one run, that with the smallest hash, is taken.
RUN = LEAST_WORDS - WINDOW + 1
#: A chain that spans LEAST_SPAN has two seeds between LEAST_SPAN and this many words apart.
MOST_APART = LEAST_SPAN + GAP_MOST + K
#: Alignments of gaps stay within this many words of the straight line.
BAND = 12
#: Bytes of the texts whose words are hashed together.
TOGETHER = 200_000
#: Seeds that travel in one row, and what each shuffle partition's range of them is cut into.
CHUNK, BUCKETS = 1 << 18, 2


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The numbers of XXH3 that words of up to 16 bytes need, with seed 0.
_FLIPS = [np.uint64(x) for x in (0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A)]
_P2, _P3, _PM, _PX = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x165667919E3779F9, 0x9FB21C651E98DF25))
_LOW = np.uint64(0xFFFFFFFF)


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _shifted(h: np.ndarray, by: int) -> np.ndarray:
    return h ^ (h >> np.uint64(by))


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit product, by exclusive or."""
    half = np.uint64(32)
    low, x, y = (a & _LOW) * (b & _LOW), (a >> half) * (b & _LOW), (a & _LOW) * (b >> half)
    middle = (low >> half) + (x & _LOW) + y
    return ((a >> half) * (b >> half) + (x >> half) + (middle >> half)) ^ (a * b)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 hashes of the words of texts put together, and the number of words of each text; A-Z are
    lower-cased, words end at ASCII blanks. Words of up to 16 bytes are hashed all at once."""
    body = b" ".join([b" " * 7, *texts, b" " * 8]).lower()
    data = np.frombuffer(body, np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(start, np.cumsum([8, *[len(t) + 1 for t in texts]])))
    eight = np.ndarray((len(data) - 7,), "<u8", body, strides=(1,))
    length, codes = end - start, np.empty(len(start), np.uint64)

    at = np.flatnonzero(length <= 3)
    x, n = start[at], length[at]
    first, middle, last = (data[i].astype(np.uint64) for i in (x, x + (n >> 1), x + n - 1))
    h = ((first << np.uint64(16)) | (middle << np.uint64(24)) | last | (n.astype(np.uint64) << np.uint64(8))) ^ _FLIPS[0]
    codes[at] = _shifted(_shifted(_shifted(h, 33) * _P2, 29) * _P3, 32)

    at = np.flatnonzero((length > 3) & (length <= 8))
    h = ((eight[end[at] - 4] & _LOW) + (eight[start[at]] << np.uint64(32))) ^ _FLIPS[1]
    h = (h ^ _turned(h, 49) ^ _turned(h, 24)) * _PX
    codes[at] = _shifted((h ^ ((h >> np.uint64(35)) + length[at].astype(np.uint64))) * _PX, 28)

    at = np.flatnonzero((length > 8) & (length <= 16))
    low, high = eight[start[at]] ^ _FLIPS[2], eight[end[at] - 8] ^ _FLIPS[3]
    codes[at] = _shifted(_shifted(length[at].astype(np.uint64) + low.byteswap() + high + _folded(low, high), 37) * _PM, 32)

    for i in np.flatnonzero(length > 16).tolist():
        codes[i] = xxhash.xxh3_64_intdigest(body[start[i] : end[i]])
    return codes, sizes


def hashed_together(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, words of each) of runs of texts of about TOGETHER bytes."""
    some, size = [], 0
    for n, text in enumerate(texts, 1):
        some.append((text.as_py() or "").encode())
        size += len(some[-1])
        if size >= TOGETHER or n == len(texts):
            yield n - len(some), *word_codes(some)
            some, size = [], 0


def _each(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(words, np.cumsum(sizes)[:-1])


def smallest(keys: np.ndarray, width: int, last: bool = False) -> np.ndarray:
    """Place of the smallest key of each stretch of that width, the first or last of equal ones, by doubling."""
    at, reach = np.arange(len(keys)), 1
    while reach < width and len(at):
        step = min(reach, width - reach)
        left, right = keys[: max(0, len(keys) - step)], keys[step:]
        at = np.where(right <= left if last else right < left, at[step:], at[: len(left)])
        keys, reach = np.minimum(left, right), reach + step
    return at


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place in texts that are put together: the text, and the place there."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _changes(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


def minimizers_of(words: np.ndarray, sizes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, seed hash, place of its first word) of texts of these sizes, put together.

    Of equal smallest hashes, as in a run of one word, that at a multiple of the window is taken. A
    seed that a text repeats counts its occurrences, so the first meets the first, and so on.
    """
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    h = _mix(h)
    text, place = _places(sizes)
    keys = (h | np.uint64(1)) - (place[:n] % window == 0).astype(np.uint64)
    places = smallest(keys, window, last=True)
    within = place[: len(places)] + window + k - 1 <= sizes[text[: len(places)]]
    places = places[within]
    places = places[_changes(places)]
    short = np.flatnonzero((sizes >= k) & (sizes < window + k - 1))
    if len(short):
        starts, seeds = (np.cumsum(sizes) - sizes)[short].tolist(), (sizes[short] - k + 1).tolist()
        places = np.sort(np.concatenate([places, [x + m - 1 - keys[x : x + m][::-1].argmin() for x, m in zip(starts, seeds, strict=True)]]))
    found, text, place = h[places], text[places], place[places]
    order = np.lexsort((found, text))
    fresh = _changes(found[order]) | _changes(text[order])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(found)), 0))
    times = np.empty(len(found), np.uint64)
    times[order] = (np.arange(len(found)) - start).astype(np.uint64)
    return text, _mix(found + times * np.uint64(0xBF58476D1CE4E5B9)), place


def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes, places of their first words) of one text."""
    return minimizers_of(words, np.array([len(words)]), k, window)[1:]


def span_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k words, by doubling."""
    h, width = _mix(words), 1
    while width < k and len(h):
        step = min(width, k - width)
        h, width = _mix(h[: max(0, len(h) - step)] * np.uint64(0x9E3779B97F4A7C15) + h[step:]), width + step
    return h


def run_places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs, place of the run that is taken in each stretch of LEAST_WORDS words)."""
    h = span_hashes(words, RUN)
    return h, smallest(h, WINDOW)


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place) of the runs that are taken in texts of these sizes, put together, each once a
    text; the place of one that its text repeats is -1."""
    h, places = run_places(words)
    text, place = _places(sizes)
    places = places[place[: len(places)] + LEAST_WORDS <= sizes[text[: len(places)]]]
    places = places[_changes(places)]
    found, text, place = h[places], text[places], place[places]
    order = np.lexsort((found, text))
    first = np.flatnonzero(_changes(found[order]) | _changes(text[order]))
    times = np.diff(first, append=len(order))
    first = order[first]
    return text[first], found[first], np.where(times == 1, place[first], -1)


class Fenwick:
    """Prefix maxima of (score, item)."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def top(self, upto: int) -> tuple[float, int]:
        """Largest value at places 0 to upto - 1."""
        found = (-1e18, -1)
        while upto > 0:
            if self.best[upto] > found:
                found = self.best[upto]
            upto -= upto & -upto
        return found


def chains(x: np.ndarray, y: np.ndarray, k: int = K) -> list[list[int]]:
    """Collinear chains of matches (x[i], y[i]), longest first, each match in one at most.

    A chain's score is k per seed, less for overlap, minus GAP_COST per word of gap on both sides:
    the cost is linear in x + y, so the best predecessor is a prefix maximum over y of
    score + GAP_COST * (x + y). Chains are cut afterwards where a gap is longer than GAP_MOST.
    """
    order = np.lexsort((y, x))
    ranks = {v: i for i, v in enumerate(np.unique(y).tolist())}
    tree = Fenwick(len(ranks))
    score, back = [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    waiting: list[int] = []
    for i in order.tolist():
        # matches at the same x can't follow each other
        while waiting and xs[waiting[0]] < xs[i]:
            j = waiting.pop(0)
            tree.put(ranks[ys[j]], (score[j] + GAP_COST * (xs[j] + ys[j]), j))
        value, j = tree.top(ranks[ys[i]])
        score[i] = float(k)
        if j >= 0:
            step = max(1, min(k, xs[i] - xs[j], ys[i] - ys[j]))
            gained = value - GAP_COST * (xs[i] + ys[i]) + GAP_COST * 2 * step + step
            if gained > k:
                score[i], back[i] = gained, j
        waiting.append(i)
    used, found = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        part: list[int] = []
        for j in reversed(chain):
            if part and max(xs[j] - xs[part[-1]], ys[j] - ys[part[-1]]) > GAP_MOST + k:
                found.append(part)
                part = []
            part.append(j)
        if part:
            found.append(part)
    return sorted(found, key=len, reverse=True)


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Words aligned by a longest common subsequence within BAND of the line from end to end."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    reach = BAND + abs(len(a) - len(b))
    for i, w in enumerate(a):
        mid = i * len(b) // len(a)
        lo, hi = max(0, mid - reach), min(len(b), mid + reach + 1)
        best = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (b[lo:hi] == w))
        row[lo + 1 : hi + 1] = np.maximum.accumulate(np.maximum(best, row[lo]))
        row[hi + 1 :] = np.maximum(row[hi + 1 :], row[hi])
    return int(row[-1])


def _grow(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences start with in common, over single differing words."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    twice = np.flatnonzero(differ[:-1] & differ[1:])
    same = np.flatnonzero(~differ[: twice[0] if len(twice) else n])
    return int(same[-1]) + 1 if len(same) else 0


def _passage(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, chain: list[int], k: int) -> tuple[int, int, int, int, int] | None:
    """The passage that a chain grows to, if it is long and alike enough."""
    a0, b0, a1, b1 = x[chain[0]], y[chain[0]], x[chain[-1]] + k, y[chain[-1]] + k
    back = _grow(a[:a0][::-1], b[:b0][::-1])
    ahead = _grow(a[a1:], b[b1:])
    a0, b0, a1, b1 = a0 - back, b0 - back, a1 + ahead, b1 + ahead
    if min(a1 - a0, b1 - b0) < LEAST_WORDS:
        return None
    # seeds match as they stand; only what lies between them is aligned
    total, pa_, pb_ = 0, a0, b0
    for i in chain:
        if x[i] >= pa_ and y[i] >= pb_:
            total += matched(a[pa_ : x[i]], b[pb_ : y[i]]) + k
            pa_, pb_ = x[i] + k, y[i] + k
        else:
            more = min(x[i] + k - pa_, y[i] + k - pb_)
            if more > 0:
                total, pa_, pb_ = total + more, x[i] + k, y[i] + k
    total += matched(a[pa_:a1], b[pb_:b1])
    if 100 * total < LEAST_MATCH * max(a1 - a0, b1 - b0):
        return None
    return int(a0), int(a1), int(b0), int(b1), int(total)


def passages(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K) -> list[tuple[int, int, int, int, int]]:
    """(start and end in a, start and end in b, matched words) of each fuzzy passage, by place.

    A chain that gives none is cut at its largest gap, and its parts are tried, down to single seeds.
    Of a chain that runs into a better passage, what lies outside is tried; it may grow back into that
    passage, so passages may overlap.
    """
    found: list[tuple[int, int, int, int, int]] = []
    taken = np.zeros(len(x), bool)
    for chain in chains(x, y, k):
        parts = [chain]
        while parts:
            part = parts.pop()
            if (inside := taken[part]).any():
                cuts = np.split(np.arange(len(part)), np.flatnonzero(np.diff(inside)) + 1)
                parts += [[part[i] for i in run] for run in cuts if not inside[run[0]]]
            elif passage := _passage(a, b, x, y, part, k):
                found.append(passage)
                taken |= (x < passage[1]) & (x + k > passage[0])
            elif len(part) > 1:
                gaps = np.maximum(np.diff(x[part]), np.diff(y[part]))
                cut = int(gaps.argmax()) + 1
                parts += sorted([part[:cut], part[cut:]], key=len)  # the longer one first
    return sorted(found)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_print"), text.alias("_text"))


def seed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The minimizers of every whole text, and its runs, each once, with place -1 if the text repeats it.

    A row holds those of many texts as arrays: the texts' _ids and _prints, and, minimizers first (_short
    of them), each one's _text, _seed and _at.
    """
    names = ["_chunk", "_short", "_ids", "_prints", "_text", "_seed", "_at"]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, prints, short, runs = [], [], [], []

        def row() -> pa.RecordBatch:
            columns = [np.array(ids, np.int64), np.array(prints, np.int64), *(np.concatenate(c) for c in zip(*short, *runs, strict=True))]
            head = [pa.array([chunk], pa.int64()), pa.array([sum(len(x[0]) for x in short)], pa.int64())]
            return pa.RecordBatch.from_arrays([*head, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names)

        for batch in batches:
            for at, words, sizes in hashed_together(batch.column(2)):
                for (text, seed, place), held in ((minimizers_of(words, sizes), short), (runs_of(words, sizes), runs)):
                    held.append(((text + len(ids)).astype(np.uint32), seed, place.astype(np.int32)))
                for kept, column in ((ids, 0), (prints, 1)):
                    kept += batch.column(column).slice(at, len(sizes)).to_pylist()
                if sum(len(x[0]) for x in short + runs) >= CHUNK:
                    yield row()
                    ids, prints, short, runs, chunk = [], [], [], [], chunk + 1
        if ids:
            yield row()

    return _rows(docs, id_col, text_col).mapInArrow(seeds, "_chunk long, _short long, _ids binary, _prints binary, _text binary, _seed binary, _at binary")


class _Chunk:
    """A row of `seed_chunks`, its distinct seeds in order (runs are marked, to stay apart), the hash of the
    document that holds each, 0 if several do, and each seed's place among the distinct ones."""

    def __init__(self, short: int, *bodies: bytes):
        kinds = np.int64, np.int64, np.uint32, np.uint64, np.int32
        self.ids, self.prints, self.text, self.seed, self.at = (np.frombuffer(b, k) for b, k in zip(bodies, kinds, strict=True))
        self.run = np.arange(len(self.seed)) >= short
        keys = np.where(self.run, self.seed ^ np.uint64(0xBF58476D1CE4E5B9), self.seed)
        order = np.argsort(keys)
        keys = keys[order]
        head = _changes(keys)
        self.keys = keys[head]
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.cumsum(head) - 1
        holder = _mix(_mix(self.ids.view(np.uint64)) + self.prints.view(np.uint64)) | np.uint64(1)
        self.holders = _one_of_each(holder[self.text[order]], head)


def _one_of_each(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The value of each run of places that begins at a head, 0 if it has several or a 0."""
    if not len(values):
        return values
    starts = np.flatnonzero(head)
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    return np.where(low == high, low, np.uint64(0))


def repeated_seeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_seed, _id, _print, _at, _run: the seeds and runs that two documents at least hold.

    A chunk sends each of its distinct seeds once, by ranges of their hashes, so that a frequent one
    costs a place for each chunk; a task meets one range at a time, and marks go back to the chunks.
    """
    parts = work_partitions(docs.sparkSession)
    bounds = np.array([(j << 64) // (parts * BUCKETS) for j in range(1, parts * BUCKETS)], np.uint64)
    chunks = stored(seed_chunks(docs, id_col, text_col))
    body = ["_short", "_ids", "_prints", "_text", "_seed", "_at"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *row in zip(*batch.columns, strict=True):
                held = _Chunk(*(c.as_py() for c in row))
                ends = [0, *np.searchsorted(held.keys, bounds).tolist(), len(held.keys)]
                sent = [(j, held.keys[x:y].tobytes(), held.holders[x:y].tobytes()) for j, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]
                if sent:
                    j, keys, holders = (list(c) for c in zip(*sent, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(j, pa.int32()), pa.array([chunk.as_py()] * len(j), pa.int64()), pa.array(keys, pa.binary()), pa.array(holders, pa.binary())],
                        ["_bucket", "_chunk", "_keys", "_holders"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _grouped(batches, 1):
            names, keys, holders = zip(*rows, strict=True)
            ends = np.cumsum([len(k) // 8 for k in keys])
            keys, holders = (np.frombuffer(b"".join(c), np.uint64) for c in (keys, holders))
            order = np.argsort(keys)
            head = _changes(keys[order])
            marks = np.empty(len(keys), bool)
            marks[order] = (_one_of_each(holders[order], head) == 0)[np.cumsum(head) - 1]
            marks = pa.array([m.tobytes() for m in np.split(marks, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([bucket] * len(names), pa.int32()), marks], ["_chunk", "_bucket", "_marks"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks, *row in zip(*batch.columns, strict=True):
                held = _Chunk(*(c.as_py() for c in row))
                stay = np.flatnonzero(np.frombuffer(b"".join(marks.values.field(1).to_pylist()), bool)[held.place])
                text = held.text[stay]
                columns = held.seed.view(np.int64)[stay], held.ids[text], held.prints[text], held.at[stay], held.run[stay]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_seed", "_id", "_print", "_at", "_run"])

    sent = chunks.select("_chunk", *body).mapInArrow(send, "_bucket int, _chunk long, _keys binary, _holders binary")
    marks = sent.repartition(parts, "_bucket").sortWithinPartitions("_bucket").mapInArrow(meet, "_chunk long, _bucket int, _marks binary")
    marks = marks.groupBy("_chunk").agg(F.sort_array(F.collect_list(F.struct("_bucket", "_marks"))).alias("_marks"))
    return chunks.join(stored(marks), "_chunk").select("_marks", *body).mapInArrow(kept, "_seed long, _id long, _print long, _at int, _run boolean")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, other_id, other_start, other_end, n_matched: passages of a
    document that an earlier one (by id, then text fingerprint) holds too; ends are exclusive.

    Texts are cut at ASCII blanks and A-Z lower-cased. Each seed is matched with the first document
    that holds it, so a passage of many documents gives one pair per later document, and never
    pairs among all. Where that leaves a seed outside every passage, as when the first document holds
    a part only, it is matched with its holder just before, by id, and if that gives no passage
    either, with the first that also holds a second seed near it. Of every stretch of LEAST_WORDS words
    that an earlier document holds, a passage covers the whole, whoever else holds its seeds.
    Null and short texts have no passage; repeated rows are one document; a null
    id is given back as null. Extra columns aren't read.
    """
    spark, source = docs.sparkSession, (docs, id_col, text_col)
    repeated = settled(spark, lambda: repeated_seeds(*source))
    runs, seeds = (repeated.filter(kind).drop("_run") for kind in ("_run", "not _run"))
    firsts = stored(seeds.groupBy("_seed").agg(F.min(F.struct("_id", "_print", "_at")).alias("_first")))
    matches = seeds.join(firsts, "_seed").select("_id", "_print", "_at", *_other("_first"), F.lit(True).alias("_new"))
    found = settled(spark, lambda: _aligned(matches, *source))

    # a pair whose matches were all tried with the first documents isn't tried again
    new = (F.col("_before._id") != F.col("_first._id")) | (F.col("_before._print") != F.col("_first._print"))
    open_ = settled(spark, lambda: _uncovered(_before(seeds), found).join(firsts, "_seed").withColumn("_new", new))
    again = open_.select("_id", "_print", "_at", *_other("_before"), "_new")
    second = settled(spark, lambda: _aligned(again, *source))

    # a seed with one earlier holder has been matched with it
    left = _uncovered(open_.filter("_new"), second).select("_seed", "_id", "_print", "_at").distinct()
    third = settled(spark, lambda: _matched_anew(*_twos(seeds, left), *source))
    found = found.unionByName(second).unionByName(third)
    found = found.unionByName(settled(spark, lambda: _matched_anew(*_stretches(runs, found, *source), *source)))

    back = lambda c, as_: F.when(F.col(c) != NO_ID, F.col(c)).alias(as_)
    plain = ["start_word", "end_word"], ["other_start", "other_end", "n_matched"]
    return found.select(back("_id", "doc_id"), *plain[0], back("_id0", "other_id"), *plain[1])


def _other(holder: str) -> list:
    return [F.col(f"{holder}._id").alias("_id0"), F.col(f"{holder}._print").alias("_print0"), F.col(f"{holder}._at").alias("_at0")]


def _uncovered(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """The seeds that lie in no found passage of their document."""
    covers = found.groupBy("_id", "_print").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_covers"))
    covered = F.exists("_covers", lambda c: (c["start_word"] <= F.col("_at")) & (F.col("_at") + K <= c["end_word"]))
    return seeds.join(covers, ["_id", "_print"], "left").filter(F.coalesce(~covered, F.lit(True))).drop("_covers")


def _with_first(keyed: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Open places (_id, _print, _at, _end) that an earlier document holds too, and their matches with
    its seeds at the start and `step` words before the end.

    `keyed` has _key, _id, _print, _at, _end and _open; only the first holder of a key is matched.
    """
    keyed = stored(keyed)
    firsts = keyed.groupBy("_key").agg(F.min(F.struct("_id", "_print", "_at", "_end")).alias("_first"))
    open_ = keyed.filter("_open").join(firsts.hint("merge"), "_key").filter("_first._id != _id or _first._print != _print")
    open_ = stored(open_.select("_id", "_print", "_at", "_end", "_first"))
    ends = F.array(
        F.struct("_at", F.col("_first._at").alias("_at0")),
        F.struct((F.col("_end") - step).alias("_at"), (F.col("_first._end") - step).alias("_at0")),
    )
    matches = open_.select("_id", "_print", *_other("_first")[:2], F.inline(ends)).withColumn("_new", F.lit(True))
    return open_.select("_id", "_print", "_at", "_end"), matches


def _matched_anew(open_: DataFrame, matches: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Passages of the matches that hold an open place; the others were found before."""
    places = open_.groupBy("_id", "_print").agg(F.collect_set(F.struct("_at", "_end")).alias("_places"))
    holds = F.exists("_places", lambda p: (F.col("start_word") <= p["_at"]) & (p["_end"] <= F.col("end_word")))
    return _aligned(matches, docs, id_col, text_col).join(places, ["_id", "_print"]).filter(holds).drop("_places")


def _twos(seeds: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open seeds and their matches in twos: with a second seed LEAST_SPAN to MOST_APART words on or back."""
    open_ = stored(open_)
    wanted = open_.select("_seed").distinct().withColumn("_wanted", F.lit(True))
    holder = ["_id", "_print"]
    rows = seeds.join(wanted, "_seed", "left").join(open_.withColumn("_open", F.lit(True)), ["_seed", *holder, "_at"], "left")
    near = Window.partitionBy(*holder).orderBy("_at").rangeBetween(LEAST_SPAN, MOST_APART)
    twos = rows.withColumn("_next", F.collect_list(F.struct("_seed", "_at", "_wanted", "_open")).over(near))
    twos = twos.withColumn("_next", F.explode("_next")).filter("_wanted or _next._wanted")
    _, matches = _with_first(
        twos.select(
            F.xxhash64("_seed", "_next._seed").alias("_key"), *holder, "_at", (F.col("_next._at") + K).alias("_end"),
            F.coalesce(F.col("_open") | F.col("_next._open"), "_open", "_next._open", F.lit(False)).alias("_open"),
        ), K,
    )
    return open_.select(*holder, "_at", (F.col("_at") + K).alias("_end")), matches


def _stretches(runs: DataFrame, found: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stretches of LEAST_WORDS words in no passage that an earlier document holds too, and their matches.

    Two equal stretches take the same run. A run is of no use if all its open places are in its first
    document; one passage around all stretches that may take it closes a run that its text doesn't repeat.
    """
    holder = ["_id", "_print"]
    covers = stored(found.groupBy(*holder).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_covers")))
    around = (F.col("_at") >= 0) & F.exists("_covers", lambda c: (c["start_word"] <= F.greatest(F.col("_at") - WINDOW + 1, F.lit(0))) & (F.col("_at") + LEAST_WORDS <= c["end_word"]))
    runs = stored(runs.join(covers, holder, "left").select("_seed", *holder, F.coalesce(~around, F.lit(True)).alias("_open")))
    useful = runs.groupBy("_seed").agg(
        F.min("_id").alias("_low"), F.max(F.when(F.col("_open"), F.col("_id"))).alias("_high"),
        F.min("_print").alias("_x"), F.max("_print").alias("_y"),
    ).filter("_high > _low or (_high = _low and _x != _y)")
    used = runs.join(useful.select("_seed").hint("merge"), "_seed").groupBy(*holder).agg(F.collect_set("_seed").alias("_runs"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            texts = (x for _, words, sizes in hashed_together(batch.column(2)) for x in _each(words, sizes))
            for n, (codes, used_, covers_) in enumerate(zip(texts, batch.column(3), batch.column(4), strict=True)):
                h, taken = run_places(codes)
                places = np.flatnonzero(np.isin(h[taken], used_.values.to_numpy().view(np.uint64)))
                open_ = np.ones(len(taken), bool)
                for c in covers_.as_py() or ():
                    open_[c["start_word"] : max(0, c["end_word"] - LEAST_WORDS + 1)] = False
                parts.append((span_hashes(codes, LEAST_WORDS)[places], np.full(len(places), n), places, open_[places]))
            if parts:
                key, pick, at, open_ = (np.concatenate(c) for c in zip(*parts, strict=True))
                pick = pa.array(pick)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at, pa.int32()),
                     pa.array(at + LEAST_WORDS, pa.int32()), pa.array(open_)],
                    ["_key", "_id", "_print", "_at", "_end", "_open"],
                )

    texts = _rows(docs, id_col, text_col).join(stored(used), holder).join(covers, holder, "left")
    texts = texts.select(*holder, "_text", "_runs", "_covers")
    return _with_first(texts.mapInArrow(stretches, "_key long, _id long, _print long, _at int, _end int, _open boolean"), K)


def _before(seeds: DataFrame) -> DataFrame:
    """The seeds with _before, the holder ahead of each in its seed's order; those without one go.

    Rows are range-partitioned by seed and holder, so a hot seed spreads over many tasks; each
    partition's first row gets its holder from a table of the partitions' last rows, one a partition.
    """
    order = ["_seed", "_id", "_print", "_at"]
    ranged = stored(seeds.repartitionByRange(work_partitions(seeds.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy("_part").agg(F.max(F.struct(*order)).alias("_high"))
    last = F.max("_high").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_part", last.alias("_last"))
    holder = F.struct(*order[1:])
    ahead = F.lag(holder).over(Window.partitionBy("_part", "_seed").orderBy(*order[1:]))
    carried = F.when(F.col("_last._seed") == F.col("_seed"), F.struct(*[F.col(f"_last.{c}").alias(c) for c in order[1:]]))
    rows = ranged.withColumn("_ahead", ahead).join(F.broadcast(ends), "_part")
    return rows.select(*order, F.coalesce("_ahead", carried).alias("_before")).filter("_before is not null")


def _aligned(matches: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _print, start_word, end_word, _id0, other_start, other_end, n_matched: the passages of
    matched places (_id, _print, _at, _id0, _print0, _at0, _new), of pairs with a new match at least.
    A document's matches with itself don't count."""
    matches = matches.filter("_id != _id0 or _print != _print0")
    pair = ["_id", "_print", "_id0", "_print0"]
    packed = matches.groupBy(*pair).agg(F.sort_array(F.collect_set(F.struct("_at", "_at0"))).alias("_matches"), F.max("_new").alias("_new"))
    span = lambda f: F.array_max(F.transform("_matches", lambda m: m[f])) - F.array_min(F.transform("_matches", lambda m: m[f]))
    packed = stored(packed.filter("_new").drop("_new").filter((span("_at") >= LEAST_SPAN) & (span("_at0") >= LEAST_SPAN)))
    used = packed.select("_id", "_print").unionByName(packed.select(F.col("_id0").alias("_id"), F.col("_print0").alias("_print"))).distinct()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x for _, words, sizes in hashed_together(batch.column(2)) for x in _each(words, sizes))
            body = pa.array([x.astype(np.uint32).tobytes() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], ["_id", "_print", "_words"])

    texts = _rows(docs, id_col, text_col).join(stored(used), ["_id", "_print"], "left_semi").dropDuplicates(["_id", "_print"])
    texts = stored(texts.mapInArrow(coded, "_id long, _print long, _words binary"))
    both = packed.join(texts, ["_id", "_print"]).join(
        texts.select(F.col("_id").alias("_id0"), F.col("_print").alias("_print0"), F.col("_words").alias("_words0")), ["_id0", "_print0"]
    )

    names = ["_id", "_print", "start_word", "end_word", "_id0", "other_start", "other_end", "n_matched"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, p, o, m, a, b in zip(*batch.columns, strict=True):
                spots = m.values
                x, y = (spots.field(f).to_numpy().astype(np.int64) for f in (0, 1))
                for a0, a1, b0, b1, n in passages(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), x, y):
                    rows.append((i.as_py(), p.as_py(), a0, a1, o.as_py(), b0, b1, n))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "_id long, _print long, start_word int, end_word int, _id0 long, other_start int, other_end int, n_matched int"
    dealt = both.select("_id", "_print", "_id0", "_matches", "_words", "_words0").repartition(work_partitions(docs.sparkSession))
    return dealt.mapInArrow(align, schema)


def op3(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir))
