"""N-gram Jaccard join with signature trees.

Equal shingle sets fall into classes first. Candidates are exact: by the pigeonhole rule, two sets
within the threshold differ in at most D shingles, so when the hash range is cut into k parts they
agree in at least k - D of them, also when only some shingles are looked at. Each set sends a key
per part that holds two of its shingles or more; sets that share a key fall into one cluster, and
sets of different clusters can't link. Parts of one shingle would join any two texts with a phrase
in common, which in a large corpus chains most of it into one cluster; only so many of them are
sent, by the shingle's hash, as a set needs to have more than D. Frequent shingles stay out of the
first cut for the same reason; a set that fills too few parts without them sends the keys of further
cuts over all its shingles.

In a cluster, trees stand over the sets in order of size. Its nodes hold the OR of their sets'
token bitmaps (over tokens that two sets of the cluster share) and the range of their sizes. A dual
traversal drops a pair of nodes when the sizes or the bits they share rule out any link, and when
all their sets are connected already; leaves are compared exactly. Runs of sets whose bitmaps would
take too much memory are halved until they fit. Clusters beyond a block's size are cut into blocks,
joined in themselves, then with the next ones, and then with all others that are not connected yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, carried, documents, settled, stored, work_partitions
from .components import components

#: Words of a shingle, and the threshold as percent of the union.
SHINGLE, PERCENT = 4, 85
#: A band of set sizes ends where the next begins: growth from band to band.
BAND = 1.25
#: Cuts: one without frequent shingles, and others over all for sets that fill too few parts; the
#: last also sends the empty parts.
SALTS = 4
#: A shingle is frequent when one set in so many has it: at most this times the mean set size are.
#: They are counted where FLUSH documents hold one LOCAL times, which decides speed, not results.
FREQUENT, LOCAL = 2000, 4
#: A block of a cluster, what a task holds one or two of: sets, and shingles in them.
BLOCK_SETS, BLOCK_TOKENS = 16_384, 2_000_000
#: What one tree stands over, and the room of the bitmaps of a pair of trees.
TREE_SETS, TREE_TOKENS = 2048, 500_000
TREE_BYTES = 32 << 20
LEAF = 8
#: Documents whose keys are merged in a task before they are sent, and how many shingles or keys
#: a task holds for that at most, but for the last document's.
FLUSH, FLUSH_ITEMS = 4000, 1 << 20
#: Keys whose owners are looked for at once, about.
MEET_KEYS = 1 << 20
WORD_MEMORY = 1 << 16
#: Shares of the parts with one shingle that are sent, in sixteenths by the shingle's hash.
SINGLES = (0, 1, 2, 4, 8, 16)
#: Bytes of a set's identity that name it among candidates: 56 bits, so a long holds them. Two sets
#: of one name only make a cluster larger.
NAME_BYTES = 7

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _TWO
    x = (x ^ (x >> np.uint64(29))) * _ONE
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text; A-Z are lower-cased, words end at blanks."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode().lower().split(), self.known
        if len(known) > WORD_MEMORY:
            known.clear()
        codes = []
        for w in words:
            code = known.get(w)
            if code is None:
                known[w] = code = xxhash.xxh3_64_intdigest(w)
            codes.append(code)
        if not codes:
            return np.empty(0, np.uint64)
        h = np.array(codes, np.uint64)
        span = min(self.size, len(h))
        mixed = np.full(len(h) - span + 1, span, np.uint64)
        for j in range(span):
            mixed = mixed * _ONE + h[j : len(h) - span + 1 + j]
        return np.unique(_mix(mixed))


def set_print(tokens: np.ndarray) -> bytes | None:
    """128-bit identity of a set; None for the empty one, which links with nothing."""
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


class Cuts:
    """The bands of set sizes, and each band's allowed difference and number of parts.

    A pair belongs to the band of its smaller set. All numbers are whole, so the test is exact.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent, self.lows = percent, [1]

    def _reach(self, n: int) -> None:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))

    @lru_cache(maxsize=None)  # noqa: B019
    def band(self, g: int) -> tuple[int, int, int]:
        """Largest size, allowed difference D, parts k."""
        self._reach(self.lows[g] if g < len(self.lows) else 1)
        most = self.lows[g + 1] - 1
        partner = 100 * most // self.percent
        # |x ^ y| <= (|x| + |y|) * (100 - percent) / (100 + percent)
        differ = (most + partner) * (100 - self.percent) // (100 + self.percent)
        low = self.lows[g]
        k = np.arange(differ + 1, max(differ + 1, 2 * low + 2) + 1)
        empty = np.exp(-low / k)
        filled, rich = k * (1 - empty), k * (1 - empty) - low * empty  # one shingle or more, two or more
        enough = lambda n: n - 3 * np.sqrt(n * (1 - n / k)) >= differ + 1
        first = lambda fits: int(np.argmax(fits)) if fits.any() else len(k) - 1
        at = first(enough(rich)) if enough(rich).any() else max(int(np.argmax(rich)), first(enough(filled)))
        return most, differ, int(k[at])

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def families(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """(band, D, k) of each band where a set of size n may be in a pair; D = 0 needs none."""
        self._reach(n)
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        found = []
        for g in range(own, -1, -1):
            most, differ, k = self.band(g)
            if 100 * most < self.percent * n:
                break
            if differ:
                found.append((g, differ, k))
        return tuple(found)


@lru_cache(maxsize=512)
def _bounds(k: int) -> np.ndarray:
    return np.array([(j << 64) // k for j in range(1, k)], np.uint64)


def part_keys(tokens: np.ndarray, cuts: Cuts, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys of the parts of a set, in all its bands. Sets within the threshold share one.

    A set sends the parts with two shingles or more, and the least share of those with one that
    makes more than D parts. What share a part needs is seen from its content alone, so of a pair
    the set with the smaller share agrees with the other one in a part that both send. A set that
    fills D parts or fewer sends them all and goes on to the next cut; if both do, they meet there.
    """
    keys, orders = [], {}
    for g, differ, k in cuts.families(len(tokens)):
        for salt in range(SALTS):
            if salt not in orders:
                if salt:
                    orders[salt] = np.sort(_mix(tokens ^ np.uint64(salt)))
                elif frequent is not None and len(frequent):
                    orders[salt] = tokens[frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] != tokens]
                else:
                    orders[salt] = tokens
            order = orders[salt]
            ends = np.concatenate([np.searchsorted(order, _bounds(k)), [len(order)]])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(order + _ONE))])
            total = sums[ends]
            total[1:] -= sums[ends[:-1]]
            held = np.diff(ends, prepend=0)
            filled = held > 0
            safe = filled.sum() > differ
            if safe:
                send = np.flatnonzero(held > 1)
                if len(send) <= differ:
                    single = np.flatnonzero(held == 1)
                    share = _mix(total[single] ^ _TWO) >> np.uint64(60)  # the part's sum is of its one shingle
                    chosen = next(c for c in (single[share < n] for n in SINGLES) if len(send) + len(c) > differ)
                    send = np.concatenate([send, chosen])
            else:
                send = np.flatnonzero(filled if salt < SALTS - 1 else np.ones(k, bool))
            place = (send + (g << 40) + (salt << 36)).astype(np.uint64)
            keys.append(_mix(total[send] ^ _mix(place * _TWO + _ONE)))
            if safe:
                break
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _stars(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first owner of each, and (owner, first owner) pairs of shared keys."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    firsts = owners[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))] if len(keys) else owners
    pairs = np.unique(np.stack([owners, firsts], 1)[owners != firsts], axis=0)
    return keys[head], owners[head], pairs


def set_name(name: bytes) -> int:
    """A set's name among candidates, from its identity; `node_name` is the same in Spark."""
    return int.from_bytes(name[:NAME_BYTES], "big")


def node_name(name: Column) -> Column:
    return F.conv(F.hex(F.substring(name, 1, NAME_BYTES)), 16, 10).cast("long")


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, _text_print, n_shingles and _print (set identity) of every row; and, in rows of
    their own, _token and _times: shingles that stand out among a task's documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_text_print", F.xxhash64("_text"))
    names = ["doc_id", "_text_print", "n_shingles", "_print", "_token", "_times"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, held = Shingles(size), {}, 0

        def counted(kind) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(list(seen.values())), return_counts=True)
            found, times = found[times >= LOCAL], times[times >= LOCAL]
            nulls = [pa.nulls(len(found), t) for t in (kind, pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(found.view(np.int64)), pa.array(times, pa.int64())], names)

        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH):
                part = batch.slice(at, FLUSH)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                prints = [set_print(s) for s in sets]
                none = [pa.nulls(len(sets), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), *none], names
                )
                for name, tokens in zip(prints, sets, strict=True):
                    if name and name not in seen:
                        seen[name], held = tokens, held + len(tokens)
                        if len(seen) >= FLUSH or held >= FLUSH_ITEMS:
                            yield counted(batch.column(0).type)
                            seen.clear()
                            held = 0
                del sets
        if seen:
            yield counted(batch.column(0).type)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(measure, f"doc_id {kind}, _text_print long, n_shingles long, _print binary, _token long, _times long")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that one set in FREQUENT has, as far as tasks saw them often:
    at most FREQUENT times the mean set size."""
    floor = max(2 * LOCAL, sets.filter("_token is null").count() // FREQUENT)
    rows = sets.filter("_token is not null").groupBy("_token").agg(F.sum("_times").alias("n")).filter(F.col("n") >= floor).select("_token")
    return np.sort(np.array([r[0] for r in rows.collect()], np.int64).view(np.uint64))


def candidate_edges(docs: DataFrame, frequent: np.ndarray, text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): names of sets joined as stars under the first set of each shared key.

    A task merges its own documents' keys before it sends one owner per key, so that the rows of a
    key grow with the tasks, not with the copies. Keys travel as arrays, dealt one shuffle partition
    a task; the stars that a task has found itself travel with them.
    """
    parts = work_partitions(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, cuts = Shingles(size), Cuts(percent)

        def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
            names = np.array(sorted(sets), np.int64)
            keys, firsts, pairs = _stars(np.concatenate([sets[n] for n in names.tolist()]), np.repeat(np.arange(len(names)), [len(sets[n]) for n in names.tolist()]))
            to = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.cumsum(np.bincount(to, minlength=parts))
            rows = [(int(pairs[0, 0]) % parts, None, names[pairs].tobytes())] if len(pairs) else []
            for p, own in enumerate(np.split(order, ends[:-1])):
                if len(own):
                    used, local = np.unique(firsts[own], return_inverse=True)
                    rows.append((p, keys[own].tobytes() + local.astype(np.uint32).tobytes(), names[used].tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "body", "names"]
            )

        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py())
                if len(tokens) and (name := set_name(set_print(tokens))) not in sets:
                    sets[name] = part_keys(tokens, cuts, shared.value)
                    held += len(sets[name])
                if len(sets) >= FLUSH or held >= FLUSH_ITEMS:
                    yield flush(sets)
                    sets, held = {}, 0
        if sets:
            yield flush(sets)

    def edges(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, names, n = [], [], [], 0
        for batch in batches:
            for body, own in zip(batch.column(1), batch.column(2), strict=True):
                raw, own = body.as_py(), np.frombuffer(own.as_py(), np.int64)
                if raw is None:
                    yield edges(own.reshape(-1, 2))
                    continue
                m = len(raw) // 12
                keys.append(np.frombuffer(raw, np.uint64, m))
                owners.append(np.frombuffer(raw, np.uint32, m, 8 * m) + np.uint32(n))
                names.append(own)
                n += len(own)
        if keys:
            ids, named = np.unique(np.concatenate(names), return_inverse=True)
            names.clear()
            owner = named.astype(np.uint32)[np.concatenate(owners)]
            owners.clear()
            key = np.concatenate(keys)
            keys.clear()
            # ranges of keys, by their high bits
            bits = max(0, (len(key) // MEET_KEYS).bit_length())
            to = (key >> np.uint64(64 - bits)).astype(np.uint16) if bits else np.zeros(len(key), np.uint16)
            for i in range(1 << bits):
                own = to == i
                yield edges(ids[_stars(key[own], owner[own])[2]])

    sent = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(send, "part int, body binary, names binary")
    return sent.repartitionById(parts, "part").mapInArrow(meet, "a long, b long").distinct()


def shared_places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, place) of each token that two of the sets share, by token, and how many places there are."""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable").astype(np.uint32)
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    head = np.concatenate([[True], ~same])[shared]
    ends = np.cumsum([len(s) for s in sets])
    owner = np.searchsorted(ends, order[shared], side="right").astype(np.int32)
    return owner, np.cumsum(head, dtype=np.int32) - 1, int(head.sum())


def bitmap_bytes(sets: int, places: int) -> int:
    return sets * max(1, -(-places // 64)) * 8


class Forest:
    """Exact links among the sets of one or two runs, as connected labels.

    owner, place: from `shared_places` of the sets.
    """

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, owner: np.ndarray, place: np.ndarray, places: int, percent: int = PERCENT):
        self.percent, self.sizes = percent, sizes
        self.labels = labels.copy()
        self.bits = np.zeros((len(sizes), max(1, -(-places // 64))), np.uint64)
        np.bitwise_or.at(self.bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}

    def node(self, lo: int, hi: int) -> tuple[np.ndarray, int, int]:
        """OR of the bitmaps and the size range of the sets from lo to hi."""
        found = self.nodes.get((lo, hi))
        if found is None:
            if hi - lo <= LEAF:
                bits = np.bitwise_or.reduce(self.bits[lo:hi], axis=0)
            else:
                mid = (lo + hi) // 2
                bits = self.node(lo, mid)[0] | self.node(mid, hi)[0]
            own = self.sizes[lo:hi]
            self.nodes[lo, hi] = found = (bits, int(own.min()), int(own.max()))
        return found

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Traverse two nodes; links merge labels."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            own = np.concatenate([self.labels[a[0] : a[1]], self.labels[b[0] : b[1]]])
            if (own == own[0]).all():
                continue
            if a != b:
                (bits_a, lo_a, hi_a), (bits_b, lo_b, hi_b) = self.node(*a), self.node(*b)
                if 100 * hi_a < self.percent * lo_b or 100 * hi_b < self.percent * lo_a:
                    continue
                most = int(np.bitwise_count(bits_a & bits_b).sum())
                if (100 + self.percent) * most < self.percent * (lo_a + lo_b):
                    continue
            if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
                self._compare(a, b)
            elif a == b:
                mid = (a[0] + a[1]) // 2
                stack += [((a[0], mid), (mid, a[1])), ((mid, a[1]), (mid, a[1])), ((a[0], mid), (a[0], mid))]
            elif a[1] - a[0] >= b[1] - b[0]:
                mid = (a[0] + a[1]) // 2
                stack += [((mid, a[1]), b), ((a[0], mid), b)]
            else:
                mid = (b[0] + b[1]) // 2
                stack += [(a, (mid, b[1])), (a, (b[0], mid))]

    def _compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        both = np.bitwise_count(self.bits[a[0] : a[1], None] & self.bits[None, b[0] : b[1]]).sum(2, dtype=np.int64)
        union = self.sizes[a[0] : a[1], None] + self.sizes[None, b[0] : b[1]] - both
        for i, j in np.argwhere(100 * both >= self.percent * union):
            x, y = self.labels[a[0] + i], self.labels[b[0] + j]
            if x != y:
                self.labels[self.labels == max(x, y)] = min(x, y)


def _cut(sizes: list[int], at: int = 0) -> list[range]:
    """Runs of sets for one tree each."""
    runs, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= TREE_SETS or total + n > TREE_TOKENS):
            runs.append(range(at + start, at + i))
            start, total = i, 0
        total += n
    return [*runs, range(at + start, at + len(sizes))]


def linked_labels(sets: list[np.ndarray], labels: np.ndarray, first: int, percent: int) -> np.ndarray:
    """Labels after all links among the sets, or only between the first ones and the others.

    A tree stands over one or two runs of sets at a time, and runs are halved until their bitmaps
    take TREE_BYTES at most, so that memory doesn't grow with sets times the tokens they share.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if first == len(sets):
        runs = _cut(sizes.tolist())
        pairs = [(a, b) for i, a in enumerate(runs) for b in runs[i:]]
    else:
        pairs = [(a, b) for a in _cut(sizes[:first].tolist()) for b in _cut(sizes[first:].tolist(), first)]
    pairs.reverse()
    while pairs:
        a, b = pairs.pop()
        own = list(a) if a == b else [*a, *b]
        if (labels[own] == labels[own[0]]).all():
            continue
        owner, place, places = shared_places([sets[i] for i in own])
        if bitmap_bytes(len(own), places) > TREE_BYTES and max(len(a), len(b)) > 1:
            del owner, place
            pairs += _halved(a, b)
            continue
        forest = Forest(sizes[own], labels[own], owner, place, places, percent)
        del owner, place
        forest.join((0, len(a)), (0, len(a)) if a == b else (len(a), len(own)))
        for old, new in {(x, y) for x, y in zip(labels[own].tolist(), forest.labels.tolist(), strict=True) if x != y}:
            labels[labels == old] = new
    return labels


def _halved(a: range, b: range) -> list[tuple[range, range]]:
    """The pairs of runs that cover a pair of runs, the longer one or both of them halved."""
    if a == b:
        mid = len(a) // 2
        return [(a[:mid], a[mid:]), (a[mid:], a[mid:]), (a[:mid], a[:mid])]
    if len(a) >= len(b):
        return [(a[len(a) // 2 :], b), (a[: len(a) // 2], b)]
    return [(a, b[len(b) // 2 :]), (a, b[: len(b) // 2])]


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal leading columns in sorted rows."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            row = tuple(v.as_py() for v in row)
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _link_table(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def placed_in_blocks(clusters: DataFrame) -> DataFrame:
    """Adds _block to (_root, _print, _n): a running count by size cuts a cluster into blocks."""
    order = Window.partitionBy("_root").orderBy("_n", "_print")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    block = F.greatest(F.floor((F.row_number().over(order) - 1) / BLOCK_SETS), F.floor(F.coalesce(before, F.lit(0)) / BLOCK_TOKENS))
    return clusters.withColumn("_block", block)


def exact_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect what is within the threshold, as stars by label.

    members: _root (cluster), _block, _n (size), _print, tokens. A task holds one block, or two of
    one cluster.
    """
    parts = work_partitions(members.sparkSession)
    blocks = stored(members.groupBy("_root", "_block").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi")))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 2):
            if len(group) > 1:
                labels = linked_labels([np.frombuffer(t, np.uint64) for _, _, t in group], np.arange(len(group)), len(group), percent)
                links = [(group[i][1], group[r][1]) for i, r in enumerate(labels) if i != r]
                if links:
                    yield _link_table(links)

    sorted_rows = members.select("_root", "_block", "_n", "_print", "tokens").repartition(parts, "_root", "_block").sortWithinPartitions("_root", "_block", "_n", "_print")
    local = stored(sorted_rows.mapInArrow(within, "a binary, b binary"))
    # blocks of one cluster meet where their sizes allow a link; most clusters have one block
    other = blocks.select("_root", F.col("_block").alias("_other"), F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"))
    meets = blocks.join(other, "_root").filter(f"_other > _block and 100 * _hi >= {percent} * _lo2 and 100 * _hi2 >= {percent} * _lo")
    meets = stored(meets.select("_root", "_block", "_other"))
    if meets.isEmpty():
        return local
    # neighbours go first: where that connects all sets of two blocks, these needn't meet
    near = F.col("_other") == F.col("_block") + 1
    found = stored(_met(members, meets.filter(near), components(local), percent))
    labels = stored(components(local.unionByName(found)))
    named = members.join(labels, members["_print"] == labels["node"], "left").select("_root", "_block", F.coalesce("root", "_print").alias("_label"))
    ends = stored(named.groupBy("_root", "_block").agg(F.min("_label").alias("_from"), F.max("_label").alias("_to")))
    far = meets.filter(~near).join(ends, ["_root", "_block"]).withColumnsRenamed({"_from": "_from1", "_to": "_to1"})
    far = far.join(ends.withColumnRenamed("_block", "_other"), ["_root", "_other"])
    far = stored(far.filter("_from1 != _to1 or _from != _to or _from1 != _from").select("_root", "_block", "_other"))
    found = local.unionByName(found)
    return found if far.isEmpty() else found.unionByName(_met(members, far, labels, percent))


def _met(members: DataFrame, meets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the sets of two blocks of a cluster that `labels` (node, root) doesn't connect.

    There are more tasks than pairs of blocks, so that few tasks get several."""
    parts = max(work_partitions(members.sparkSession), 2 * meets.count())
    dealt = meets.select("_root", "_block", "_other", F.explode(F.array("_block", "_other")).alias("_side"))
    wide = members.select("_root", F.col("_block").alias("_side"), "_n", "_print", "tokens")
    wide = wide.join(labels.select(F.col("node").alias("_print"), "root"), "_print", "left")
    wide = dealt.join(wide, ["_root", "_side"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block, _), group in _grouped(batches, 3):
            names = [g[2] for g in group]
            roots = [g[3] or g[2] for g in group]
            first = {r: i for i, r in reversed(list(enumerate(roots)))}
            start = np.array([first[r] for r in roots])
            first = sum(g[0] == block for g in group)
            labels = linked_labels([np.frombuffer(g[4], np.uint64) for g in group], start.copy(), first, percent)
            links = [(names[i], names[r]) for i, r in enumerate(labels) if i != r and start[i] != r]
            if links:
                yield _link_table(links)

    keys = ["_root", "_block", "_other"]
    paired = wide.select(*keys, "_side", "_n", "_print", "root", "tokens").repartition(parts, *keys).sortWithinPartitions(*keys, "_side", "_n", "_print")
    return paired.mapInArrow(across, "a binary, b binary")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and _text_print of the text.

    component_id is the smallest doc_id that links reach. Texts without words, and null ones, have
    an empty set and link with nothing, not even with each other. Repeated rows and ids are fine;
    a null id takes its group's smallest id. Extra columns aren't read.
    """
    found = stored(set_table(docs, id_col, text_col, size))
    frequent, sets = frequent_shingles(found), found.filter("_token is null").drop("_token", "_times")
    classes = stored(
        sets.filter("_print is not null").groupBy("_print").agg(
            F.min("doc_id").alias("_least"), F.min("n_shingles").alias("_n"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_text_print")).alias("_row"),
        )
    )
    # the keys take more room than the texts: they go before the texts are dealt
    clusters = settled(docs.sparkSession, lambda: components(candidate_edges(docs, frequent, text_col, size, percent)))
    chosen = clusters.join(classes, clusters.node == node_name(classes["_print"])).select("_print", F.col("root").alias("_root"), "_n", "_row.*")
    chosen = stored(placed_in_blocks(chosen))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text_print"), text.alias("_text"))
    texts = texts.join(chosen.hint("merge"), ["_id", "_text_print"]).dropDuplicates(["_id", "_text_print"])
    texts = texts.select("_root", "_block", "_n", "_print", "_text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            body = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], body], ["_root", "_block", "_n", "_print", "tokens"])

    members = stored(texts.mapInArrow(tokens, "_root long, _block long, _n long, _print binary, tokens binary"))
    linked = stored(components(exact_links(members, percent)))
    named = classes.join(linked, classes["_print"] == linked.node, "left").select("_print", "_least", F.coalesce("root", "_print").alias("_root"))
    named = stored(named)
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    ids = stored(named.join(least, "_root").select("_print", "component_id"))
    # empty sets have no class; they keep out of the join, where they would share a key
    full = sets.filter("_print is not null").join(ids, "_print").select("doc_id", "n_shingles", "component_id", "_text_print")
    return full.unionByName(sets.filter("_print is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "_text_print"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id, then fingerprint.

    Rows without words all stay, but for repeated ones.
    """
    grouped = lambda: similar_groups(docs, size=size, percent=percent).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    groups = settled(docs.sparkSession, grouped)
    full = groups.filter("n_shingles > 0").groupBy(F.coalesce("component_id", F.lit(NO_ID))).agg(F.min(F.struct("_id", "_text_print")).alias("_row"))
    stay = full.select("_row.*").unionByName(groups.filter("n_shingles = 0").select("_id", "_text_print")).distinct()
    keyed = carried(docs, _id=F.coalesce("doc_id", F.lit(NO_ID)), _text_print=F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(stored(stay).hint("merge"), ["_id", "_text_print"], "left_semi").dropDuplicates(["_id", "_text_print"]).select("_doc.*")


def op4(spark, sf_dir):
    return similar_groups(documents(spark, sf_dir)).drop("_text_print")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * o >= {PERCENT} * (na.n + nb.n - o)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
