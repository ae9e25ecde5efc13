"""Packing, alignment and conversation repair, against plain versions."""

from __future__ import annotations

import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus  # noqa: E402
import plain  # noqa: E402
import public_tokenizers  # noqa: E402

from twinpeak.llm import alignment, cached_tokens, packing, turn_repair  # noqa: E402
from twinpeak.llm.registry import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    " ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "a", "B", "é", "É", "İ", "ß", "Σ", "ς", "́", ".", ",", "'s", "'S", "'", "-", "1",
    "<|endoftext|>", "<s>", "<0x41>", "漢字", "𝄞", "٣", "½", "ǅ", "‍", "\0", ".,", "word", "Word",
]


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_parts_give_the_ids_of_the_whole_text(monkeypatch):
    """Also when the tables of words are emptied all the time."""
    import sentencepiece

    monkeypatch.setattr(cached_tokens.Table, "most", 500)
    for kind in (cached_tokens.ByteTable, cached_tokens.PieceTable):
        monkeypatch.setattr(kind, "most", 300)
    texts = odd_texts(5000)
    files = {n: cached_tokens.read_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}
    words, a, b = cached_tokens.WordTable(files["word_bpe_49k.json"]), cached_tokens.ByteTable(files["byte_bpe_50k.json"]), cached_tokens.PieceTable(files["piece_bpe_32k.model"])
    plain_a = tokenizer("byte_bpe_50k.json")
    plain_a.encode_special_tokens = True
    plain_w, plain_b = tokenizer("word_bpe_49k.json"), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in texts:
        parts, chunks = cached_tokens.words_of(text), cached_tokens.chunks_of(" " + text)
        assert "".join(chunks) == " " + text
        words.learn(set(parts))
        a.learn(set(chunks))
        b.learn(set(chunks))
        assert words.encode(parts) == cached_tokens.as_bytes(plain_w.encode(text, add_special_tokens=False).ids)
        assert a.encode(chunks) == cached_tokens.as_bytes(plain_a.encode(" " + text, add_special_tokens=False).ids)
        assert b.encode(chunks) == cached_tokens.as_bytes(plain_b.encode(text))


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    for n, most, windows in ((900, 1024, 100), (40, 10, 7), (5, 9, 9), (1, 4, 3), (0, 4, 2), (6, 5, 1)):
        sizes = rng.integers(1, most, n)
        which = packing.differencing(sizes, windows)
        sums = np.bincount(which, weights=sizes, minlength=windows)
        assert len(which) == n and sums.sum() == sizes.sum() and (n == 0 or which.max() < windows)
        assert sums.max() - sums.min() <= sizes.max(initial=0)
    # The textbook case: 4, 5, 6, 7, 8 over two windows differ by 2.
    sums = np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]


def test_windows_rise_until_none_is_too_full():
    which, offsets = packing.pack_block([3, 3, 3], 5)
    assert sorted(which) == [0, 1, 2] and list(offsets) == [0, 0, 0]


def check_pieces(pieces, texts, capacity):
    """Pieces are the documents' ids, each id once; sequences hold pieces without gaps."""
    plain_w = tokenizer("word_bpe_49k.json")
    want = sorted((i is None, i, cached_tokens.as_bytes([*plain_w.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts)
    spans: dict = {}
    for r in pieces:
        assert 0 < r.length <= capacity and len(r.ids) == 4 * r.length
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # Repeated documents are told apart by counting the pieces of each start.
    whole: dict = {}
    for r in sorted(pieces, key=lambda r: r.start):
        whole.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(bytes(r.ids))
    got = []
    for (doc_id, tokens), starts in whole.items():
        copies = {len(v) for v in starts.values()}
        assert len(copies) == 1
        for copy in zip(*[sorted(v) for _, v in sorted(starts.items())], strict=True):
            got.append((doc_id is None, doc_id, b"".join(copy)))
            assert len(got[-1][2]) == 4 * tokens
    assert sorted(x[2] for x in got) == sorted(x[2] for x in want)
    return spans


@pytest.mark.parametrize("capacity", [4096, 64, 8])
def test_packing_of_awkward_documents(spark, capacity):
    rows = [*corpus.rows(), *((100 + i, t, None, None, 0, None, None, None, None) for i, t in enumerate(odd_texts(60)))]
    df = corpus.frame(spark, rows)
    file = cached_tokens.read_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(df, file, capacity).collect()
    spans = check_pieces(pieces, [(r[0], r[1]) for r in rows], capacity)
    tokens = sum(r.length for r in pieces)
    assert len(spans) * capacity - tokens <= max(capacity, 0.1 * tokens)
    assert packing.pack(df.limit(0), file).collect() == []


def test_blocks_close_within_a_task(spark, monkeypatch):
    file = cached_tokens.read_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(i, f"word {i} " * (i % 50)) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    rows = [r.asDict() for r in df.collect()]
    made = []
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    import pyarrow as pa

    for batch in packing.packer(file, 256)([pa.RecordBatch.from_pylist(rows)]):
        made += batch.to_pylist()
    placed = [type("R", (), r) for r in made if r["sequence_id"] is not None]
    left = [r for r in made if r["sequence_id"] is None]
    assert placed and sum(r["length"] for r in left) < 5000 and all(r.sequence_id >> 32 == 3 for r in placed)
    assert sum(r["length"] for r in made) == sum(t for t in {r["doc_id"]: r["doc_tokens"] for r in made}.values())


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_packing"][0](spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    plain_w = tokenizer("word_bpe_49k.json")
    ids = {i: [*plain_w.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs.items()}
    for r in got.collect():
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens and len(part) == r.length
    filled, padding = packing.padded(got).groupBy().sum("filled", "padding").first()
    assert filled == sum(map(len, ids.values())) and padding <= 0.02 * filled


def test_runs_meet_every_common_end():
    rng = random.Random(4)
    for _ in range(1500):
        a = sorted(rng.sample(range(100), rng.randint(0, 60)))
        b = sorted(set(a) - set(rng.sample(range(100), rng.randint(0, 12))) | set(rng.sample(range(100), rng.randint(0, 5))))
        i, j = alignment.cut_places(a, b)
        assert [a[x] for x in i] == sorted(set(a) & set(b)) == [b[x] for x in j]
    assert alignment.diagonal_runs(list(range(1000)), list(range(1000))) == [(0, 0, 1000)]
    assert alignment.diagonal_runs([2, 3, 4, 5], [1, 2, 3, 5]) == [(0, 1, 2), (3, 3, 1)]


def test_alignment_equals_plain_version(spark):
    rows = [*corpus.rows(), *((100 + i, t, None, None, 0, None, None, None, None) for i, t in enumerate(odd_texts(200) + ["▁ x", "a▁"]))]
    files = [cached_tokens.read_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    df = corpus.frame(spark, rows)
    got = alignment.describe(df, *files)
    assert sorted(map(tuple, got.collect()), key=repr) == plain.alignments([(r[0], r[1]) for r in rows])
    for r in alignment.align(df, *files).collect():
        assert len(r.a_sizes) == len(r.b_sizes) and sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids)
    empty = df.limit(0)
    assert alignment.describe(empty, *files).collect() == []


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_alignment"][0](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain.alignments(rows)


def test_every_link_is_a_numbered_pair():
    """A pair ends alike exactly when it is in the list."""
    pairs = alignment.Pairs([b"a", b"ba", b"", b"cb"], [b"a", b"b", b"xba", b"a"])
    want = sorted((y << 32 | x) for x, a in enumerate([b"a", b"ba", b"", b"cb"]) for y, b in enumerate([b"a", b"b", b"xba", b"a"]) if a and (a.endswith(b) or b.endswith(a)))
    assert pairs.codes.tolist() == want


TEXTS = ["a.", "b?", "c", "  ", "", None, "d!\n", "e. f", "　", "."]


def conversation_rows(seed, lengths):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unclear", None, ""]
    return [
        (conv, rng.choice([i, i, i, None, i // 2]), rng.choice(roles), rng.choice([*TEXTS, f"{i}.", f"{i}.", f"{i}"]))
        for conv, n in zip([None, *range(len(lengths))], [3, *lengths], strict=True)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,lengths", [(1, [1, 2, 3, 4, 5, 6, 8, 31, 32, 33, 64, 65] * 3), (2, [1500, 40, 2, 1])])
def test_repair_equals_plain_version(spark, seed, lengths):
    """The second table is mostly one conversation, over all partitions and three levels of the tree."""
    rows = conversation_rows(seed, lengths)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, _row long").repartition(3)
    assert sorted(map(tuple, turn_repair.repair(df).collect()), key=repr) == plain.repairs(rows)


def test_repair_of_one_row_many_times_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, "user", "same.")] * 700 + [(2, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, turn_repair.repair(df).collect()), key=repr) == plain.repairs([(1, 1, "user", "same.")] * 700 + [(2, 0, None, None)])
    assert turn_repair.repair(df.limit(0)).collect() == []


def test_prices_after_an_auction_are_the_distances():
    rng = random.Random(9)
    for _ in range(150):
        codes = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randint(1, 9)))
        costs = turn_repair.block_costs(codes)
        arcs, _ = turn_repair.row_arcs(codes)
        for start in range(4):
            far = [turn_repair.FAR] * (len(arcs) + 4)
            far[start] = 0
            for _ in range(len(arcs) + 4):
                for node, out in enumerate(arcs):
                    for _, cost, to in out:
                        far[to] = min(far[to], far[node] + cost)
            assert [min(x, turn_repair.FAR) for x in far[-4:]] == list(costs[4 * start : 4 * start + 4])


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"][0](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain.repairs(rows)


def test_words_that_differ_in_case_are_encoded_once(monkeypatch):
    import public_tokenizers

    from twinpeak.llm import cached_tokens

    words = cached_tokens.WordTable(cached_tokens.read_file(public_tokenizers.path("word_bpe_49k.json")))
    taken, encode = [], cached_tokens.WordTable.split_lower
    monkeypatch.setattr(cached_tokens.WordTable, "split_lower", lambda self, some: taken.extend(some) or encode(self, some))
    letters = "AaÀàÞþÖöØøÿß"
    fresh = {a + b for a in letters for b in letters} | {"Straße", "STRASSE", "strasse"}
    words.learn(fresh)
    assert sorted(taken) == sorted({w.lower() for w in fresh})
    for word in fresh:
        assert words.known[word] == cached_tokens.as_bytes(words.tokenizer.encode(word, add_special_tokens=False).ids)


def test_letters_are_encoded_without_the_rules_of_the_file():
    rng = random.Random(6)
    letters = "aAbezZÀàÉéÞþÖöØøÿß"
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(2000)}
    for kind, name, blank in ((cached_tokens.WordTable, "word_bpe_49k.json", ""), (cached_tokens.ByteTable, "byte_bpe_50k.json", " ")):
        words, whole = kind(cached_tokens.read_file(public_tokenizers.path(name))), tokenizer(name)
        words.tokenizer.pre_tokenizer = None
        words.learn({blank + w for w in made})
        for word in made:
            assert words.known[blank + word] == cached_tokens.as_bytes(whole.encode(blank + word, add_special_tokens=False).ids)


def test_equal_chunks_are_aligned_once(monkeypatch):
    """Over all texts together, and with the groups of the whole texts."""
    files = [cached_tokens.read_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    texts = [(i, t) for i, t in enumerate(["Alignment unbelievably", "Unbelievably odd words, unbelievably", "", None, *odd_texts(60)])]
    taken, runs = [], alignment.diagonal_runs
    monkeypatch.setattr(alignment, "diagonal_runs", lambda a, b: taken.append(len(a)) or runs(a, b))
    monkeypatch.setattr(alignment.GroupTable, "most", 40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in texts[:4] * 20])
    got = [r for b in alignment.digester(*files)([batch]) for r in b.to_pylist()]
    assert len(taken) == 1 and taken[0] < got[0]["n_a"] + 20 and len(got) == 80
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in texts])
    for some in (1 << 20, 100):
        monkeypatch.setattr(cached_tokens, "TOGETHER", some)
        got = [r for b in alignment.digester(*files)([batch]) for r in b.to_pylist()]
        assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in got] == [
            (r[0], r[1], r[2], r[3], r[7]) for r in sorted(plain.alignments(texts))
        ]
