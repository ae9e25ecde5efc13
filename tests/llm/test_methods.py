"""The methods inside the operators, against plain versions."""

from __future__ import annotations

import os
import random
import sys
import tracemalloc

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))

from twinpeak.llm import jaccard_join, language_id, sentencepieces, substring_dedup  # noqa: E402
from twinpeak.llm.common import numbered, stored  # noqa: E402
from twinpeak.llm.components import components  # noqa: E402


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x")
    assert all(r.x == r.n for r in numbered(df, ["x"], "n").collect())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(101, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_within_the_threshold_share_a_part():
    """The pigeonhole cut may lose no pair: sizes from 1 up, at the very edge of the threshold."""
    rng, cuts = np.random.default_rng(1), jaccard_join.Cuts()
    tried = 0
    for n in [*range(1, 60), 75, 100, 150, 333, 700, 1500]:
        for _ in range(12):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop, add = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            both, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
            if 100 * both < 85 * union or (both == union):
                continue
            tried += 1
            for often in (None, np.sort(rng.permutation(base)[: n // 2]), base):
                a, b = (jaccard_join.part_keys(x, cuts, often) for x in (base, other))
                assert np.intersect1d(a, b).size
    assert tried > 150


def test_sets_at_80_percent_share_a_part():
    rng, cuts = np.random.default_rng(2), jaccard_join.Cuts(80)
    for n in [*range(1, 40), 64, 128, 300, 1000]:
        for _ in range(12):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 5 + 1))
            add = n - drop  # what the threshold leaves room for
            while 100 * (n - drop) < 80 * (n + add):
                add -= 1
            if add < 0:
                continue
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            if not drop and not add:
                continue
            for often in (None, np.sort(rng.permutation(base)[: n // 2])):
                a, b = (jaccard_join.part_keys(x, cuts, often) for x in (base, other))
                assert np.intersect1d(a, b).size


@pytest.mark.parametrize("percent", [80, 85])
def test_texts_with_a_phrase_in_common_are_no_candidates(percent):
    """Sets that share single shingles with many others mustn't chain into one cluster."""
    rng, cuts = np.random.default_rng(5), jaccard_join.Cuts(percent)
    common = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    keys, owners = [], []
    for i in range(1500):
        n = int(rng.integers(250, 700))
        own = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.choice(common, 20)]))
        keys.append(jaccard_join.part_keys(own, cuts))
        owners.append(np.full(len(keys[-1]), i))
    _, _, pairs = jaccard_join._stars(np.concatenate(keys), np.concatenate(owners))
    assert len(pairs) < 40


@pytest.mark.parametrize("room", [1 << 20, 500])
def test_candidates_are_joined_by_every_shared_key(spark, monkeypatch, room):
    """Keys are dealt over tasks and met in ranges; the stars reach all sets with a key in common."""
    monkeypatch.setattr(jaccard_join, "MEET_KEYS", room)
    monkeypatch.setattr(jaccard_join, "FLUSH", 7)
    rng = random.Random(8)
    texts = []
    for family in range(40):
        base = [f"w{family}x{i}" for i in range(90)]
        texts += [" ".join(w if rng.random() > 0.02 else f"e{rng.randrange(10**6)}" for w in base) for _ in range(3)]
    found = components(jaccard_join.candidate_edges(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), np.empty(0, np.uint64)))
    got = {r.node: r.root for r in found.collect()}
    shingles, cuts, least = jaccard_join.Shingles(), jaccard_join.Cuts(), {}
    names = [jaccard_join.set_name(jaccard_join.set_print(shingles(t))) for t in texts]
    keys = [set(jaccard_join.part_keys(shingles(t), cuts).tolist()) for t in texts]
    for i in range(len(texts)):
        least[i] = i
        for j in range(i):
            if keys[i] & keys[j] and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    want = {}
    for i, v in least.items():
        want.setdefault(v, set()).add(names[i])
    want = {n: min(group) for group in want.values() if len(group) > 1 for n in group}
    assert want and got == want


@pytest.mark.parametrize("block", [(2048, 1_000_000), (5, 1_000_000), (2048, 400)])
def test_blocks_of_a_cluster_give_the_same_links(spark, monkeypatch, block):
    for name, value in zip(("BLOCK_SETS", "BLOCK_TOKENS"), block, strict=True):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(3)
    data = []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(80)]
        for k in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(80)] = f"edit{rng.randrange(1000)}"
            data.append((family * 20 + k, " ".join(text)))
    from test_small_corpora import groups_by_brute_force

    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.similar_groups(df).drop("_text_print").collect())
    assert got == sorted(groups_by_brute_force(data))


@pytest.mark.parametrize("trees", [(2048, 1_000_000), (3, 1_000_000), (2048, 150)])
def test_trees_of_a_block_give_the_same_labels(monkeypatch, trees):
    monkeypatch.setattr(jaccard_join, "TREE_SETS", trees[0])
    monkeypatch.setattr(jaccard_join, "TREE_TOKENS", trees[1])
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(4):
        base = rng.integers(0, 1 << 60, 50, dtype=np.uint64)
        for _ in range(9):
            keep = rng.permutation(50)[: int(rng.integers(42, 51))]
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 60, int(rng.integers(0, 4)), dtype=np.uint64)])))
    sets.sort(key=len)
    want = np.arange(len(sets))
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i], sets[j]):
                x, y = want[i], want[j]
                want[want == max(x, y)] = min(x, y)
    assert (jaccard_join.linked_labels(sets, np.arange(len(sets)), len(sets), 85) == want).all()
    half = len(sets) // 2
    start = np.array([min(k for k in range(len(sets)) if want[k] == want[i] and (k < half) == (i < half)) for i in range(len(sets))])
    across = jaccard_join.linked_labels(sets, start, half, 85)
    assert len(np.unique(across)) <= len(np.unique(start)) and all(want[across[i]] == want[i] for i in range(len(sets)))


def chained_sets(n, size):
    """Sets that share a half with each neighbour, and near copies of every 20th."""
    rng = np.random.default_rng(7)
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    halves = [new(size // 2) for _ in range(n + 1)]
    sets = [np.unique(np.concatenate(halves[i : i + 2])) for i in range(n)]
    copies = [(sets[i], np.concatenate([sets[i][2:], new(2)])) for i in range(0, n, 20)]
    sets = sorted([*sets, *(np.sort(c) for _, c in copies)], key=lambda s: (len(s), s.tobytes()))
    at = {s.tobytes(): i for i, s in enumerate(sets)}
    want = np.arange(len(sets))
    for a, b in copies:
        x, y = sorted((at[a.tobytes()], at[np.sort(b).tobytes()]))
        want[y] = x
    return sets, want


def test_trees_over_many_shared_tokens_take_little_memory():
    sets, want = chained_sets(2900, 480)
    tracemalloc.start()
    labels = jaccard_join.linked_labels(sets, np.arange(len(sets)), len(sets), 85)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (labels == want).all()
    assert most < 120e6


@pytest.mark.parametrize("room", [1, 600, 4000])
def test_halved_runs_give_the_same_labels(monkeypatch, room):
    monkeypatch.setattr(jaccard_join, "TREE_BYTES", room)
    sets, want = chained_sets(90, 60)
    n, made, own = len(sets), [], jaccard_join.Forest.__init__

    def noted(self, *args):
        own(self, *args)
        made.append(self.bits)

    monkeypatch.setattr(jaccard_join.Forest, "__init__", noted)
    assert (jaccard_join.linked_labels(sets, np.arange(n), n, 85) == want).all()
    assert all(len(bits) <= 2 or bits.nbytes <= room for bits in made)
    across = jaccard_join.linked_labels(sets, np.arange(n), n // 2, 85)
    assert (across == np.where((want < n // 2) & (np.arange(n) >= n // 2), want, np.arange(n))).all()


def test_chains_follow_order_and_cut_at_gaps():
    x = np.array([0, 10, 20, 30, 15, 500, 510])
    y = np.array([100, 110, 120, 130, 5, 600, 610])
    found = [sorted(c) for c in substring_dedup.chains(x, y)]
    assert [0, 1, 2, 3] in found and [5, 6] in found and [4] in found


def test_alignment_counts_common_words():
    a = np.arange(60, dtype=np.uint64)
    b = np.delete(a, [10, 30]).copy()
    b[40] = 999
    assert substring_dedup.matched(a, b) == 57
    assert substring_dedup.matched(a[:0], b) == 0


def test_passages_of_a_shared_quote(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    quote = [word() for _ in range(70)]
    data = [(i, " ".join([word() for _ in range(50 + i)] + quote + [word() for _ in range(40)])) for i in range(12)]
    data += [(100 + i, " ".join(word() for _ in range(200))) for i in range(10)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.other_id) for r in got) == [(i, 0) for i in range(1, 12)]
    for r in got:
        assert (r.start_word, r.end_word, r.other_start, r.n_matched) == (50 + r.doc_id, 120 + r.doc_id, 50, 70)


def test_a_chain_that_fails_is_cut_at_its_gap():
    """Two exact passages that adjoin in one text and stand 50 words apart in the other."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        p, q, other, head = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (50, 50, 50, 20))
        a, b = np.concatenate([head, p, q]), np.concatenate([p, other, q])
        (one, x), (two, y) = substring_dedup.minimizers(a), substring_dedup.minimizers(b)
        _, i, j = np.intersect1d(one, two, return_indices=True)
        assert substring_dedup.passages(a, b, x[i], y[j]) == [(20, 70, 0, 50, 50), (70, 120, 100, 150, 50)]


def test_passages_that_overlap_are_both_found():
    """Two exact passages of 60 words that share 10 in one text and stand apart in the other."""
    for seed in range(50):
        rng = np.random.default_rng(seed)
        a, head, other, tail = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (110, 30, 120, 30))
        b = np.concatenate([head, a[:60], other, a[50:], tail])
        (one, x), (two, y) = substring_dedup.minimizers(a), substring_dedup.minimizers(b)
        _, i, j = np.intersect1d(one, two, return_indices=True)
        assert substring_dedup.passages(a, b, x[i], y[j]) == [(0, 60, 30, 90, 60), (50, 110, 210, 270, 60)]


def test_passages_whose_first_holders_are_others(spark):
    """Halves of a passage stand in two earlier documents; the two that share all of it still meet."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    data = []
    for case in range(20):
        quote, at = [word() for _ in range(60)], 10 * case
        for i, part in enumerate((quote[:30], quote[30:], quote, quote, quote)):
            data.append((at + i, " ".join([word() for _ in range(40)] + part + [word() for _ in range(40)])))
    data += [data[-1], data[-2]]
    got = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect()
    whole = {r.doc_id for r in got if (r.start_word, r.end_word, r.other_start, r.other_end) == (40, 100, 40, 100)}
    assert whole == {10 * case + i for case in range(20) for i in (3, 4)}
    assert all(r.other_id < r.doc_id and r.doc_id // 10 == r.other_id // 10 for r in got)
    assert len(got) == len(set(got))


def test_passages_whose_first_and_last_holders_are_others(spark):
    """The halves of a passage stand alone both before and between the two documents that share all of it."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    data = []
    for case in range(12):
        quote, at = [word() for _ in range(60)], 10 * case
        for i, part in enumerate((quote[:30], quote[30:], quote, quote[:30], quote[30:], quote)):
            data.append((at + i, " ".join([word() for _ in range(40)] + part + [word() for _ in range(40)])))
    data += [data[-1], data[5]]
    got = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end, r.n_matched) for r in got) == [
        (10 * case + 5, 40, 100, 10 * case + 2, 40, 100, 60) for case in range(12)
    ]


def test_an_equal_passage_is_found_whoever_holds_its_seeds(spark):
    """Parts of a passage stand in many other documents, in twos too, before and between the two that share all of it."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    data, pairs = [], []
    for case in range(8):
        quote, at = [word() for _ in range(50 + case)], 100 * case
        parts = [quote[i : i + 40] for i in (0, 5, 10)] + [quote[:20] + [word() for _ in range(20)] + quote[30:]]
        for i, part in enumerate([*parts, *parts, quote, *parts, *parts, quote]):
            data.append((at + i, " ".join([word() for _ in range(40)] + part + [word() for _ in range(40)])))
        pairs.append((at + 17, 40, 90 + case, at + 8, 40, 90 + case, 50 + case))
    got = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect()
    found = {(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end, r.n_matched) for r in got}
    covered = lambda p: any(f[0] == p[0] and f[1] <= p[1] and p[2] <= f[2] for f in found)
    assert all(map(covered, pairs)) and len(found) == len(got)


def test_span_hashes_tell_stretches_apart():
    words = np.random.default_rng(2).integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 6, 35, 50):
        plain = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        hashes = substring_dedup.span_hashes(words, k).tolist()
        assert len(hashes) == len(plain) and len(set(zip(plain, hashes))) == len(set(plain)) == len(set(hashes))
    assert len(substring_dedup.span_hashes(words[:30], 50)) == 0 == len(substring_dedup.run_places(words[:49])[1])


def test_the_holder_before_across_partitions(spark):
    """A seed of most rows, others of few, and repeated rows, against a plain walk in order."""
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 40), rng.randrange(500), 7, rng.randrange(3)) for _ in range(900)]
    rows = [r for r in {r[:2]: r for r in rows}.values() for _ in range(rng.choice((1, 1, 3)))]
    got = substring_dedup._before(spark.createDataFrame(rows, "_seed long, _id long, _print long, _at int")).collect()
    pairs = {(r._seed, r._id, r._before._id) for r in got if r._id != r._before._id}
    plain = sorted({r[:2] for r in rows})
    assert pairs == {(s, i, j) for (t, j), (s, i) in zip(plain, plain[1:]) if s == t}


def test_pair_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (70, language_id.SPAN)).astype(np.uint8)
    net = language_id.train(windows, rng.integers(0, 2, 70), ["a", "b"], epochs=1)
    plain = net.probabilities(net.features(windows)[0])
    assert np.abs(language_id.Scorer(net).windows(windows) - plain).max() < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter(language_id.held_out(found.doc_id)).filter("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_paths_equal_the_library(spark, tmp_path):
    """The same vocabulary as a unigram model; spaces' scores are brought into float's reach."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    proto = model_pb2.ModelProto()
    with open(sentencepieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, "  a  b "), (-2, "ab\n\n\ncd\t \x01𝄞🙂 x"), (-3, ""), (-4, "x" * 900), (-5, "relationship  of 漢字")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sentencepieces.encode(docs, str(path)).collect():
        assert r.ids == library.encode(texts[r.doc_id])


def test_literal_marks_survive(spark):
    df = spark.createDataFrame([(1, "a▁b ▁ c")], "doc_id long, text string")
    assert sentencepieces.decode(sentencepieces.encode(df)).first().text == "a▁b ▁ c"


def test_a_stored_table_needs_a_shared_folder(spark):
    df = stored(spark.range(3))
    assert df.count() == 3 and df.inputFiles()[0].startswith(("file:", "/"))


def test_decoding_beside_encoding_equals_decoding_after(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n"), (None, "漢字 🙂\x00")], "doc_id long, text string"))
    both = {r.doc_id: (r.ids, r.back) for r in sentencepieces.encode(docs, decoded="back").collect()}
    after = {r.doc_id: (r.ids, r.back) for r in sentencepieces.decode(sentencepieces.encode(docs), text_col="back").collect()}
    assert both == after
    assert {i: back for i, (_, back) in both.items()} == {r.doc_id: r.text for r in docs.collect()}


def test_decode_of_odd_ids(spark):
    vocab = sentencepieces.vocabulary()
    text = sentencepieces.encode(spark.createDataFrame([(1, "plain text")], "doc_id long, text string")).first().ids
    odd = [(1, text), (2, None), (3, []), (4, [-1, *text, None, vocab.size, 2**31 - 1]), (5, [vocab.bytes_ids[32], vocab.bytes_ids[255]])]
    back = sentencepieces.decode(spark.createDataFrame(odd, "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "plain text", 2: None, 3: "", 4: "plain text", 5: "�"}


def test_seeds_of_texts_together_are_those_of_each():
    rng = np.random.default_rng(11)
    k, window, stretch = substring_dedup.K, substring_dedup.WINDOW, substring_dedup.LEAST_WORDS
    texts = [rng.integers(0, most, n).astype(np.uint64) for n in (0, 5, 6, 9, 20, 21, 22, 49, 50, 51, 300, 0, 700) for most in (1, 2, 6, 1000)]
    sizes, both = np.array(list(map(len, texts))), np.concatenate(texts)
    seeds, runs = substring_dedup.minimizers_of(both, sizes), substring_dedup.runs_of(both, sizes)
    for i, words in enumerate(texts):
        h = substring_dedup.span_hashes(words, substring_dedup.RUN).tolist()
        taken = [min(range(j, j + window), key=lambda x: (h[x], x)) for j in range(len(words) - stretch + 1)]
        hashes = [h[x] for x in sorted(set(taken))]
        assert sorted(zip(*(c[runs[0] == i].tolist() for c in runs[1:]), strict=True)) == sorted(
            {(h[x], x if hashes.count(h[x]) == 1 else -1) for x in taken}
        )
        alone, places = substring_dedup.minimizers(words)
        assert list(zip(alone, places, strict=True)) == list(zip(*(c[seeds[0] == i] for c in seeds[1:]), strict=True))
        grams = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
        assert set(places.tolist()) <= set(range(len(grams))) and len(set(alone.tolist())) == len(alone)
        for j in range(max(0, len(grams) - window + 1)):
            assert any(j <= p < j + window for p in places)
    assert len(substring_dedup.smallest(np.arange(3), 16)) == 0
    keys = rng.integers(0, 4, 200)
    for width in (1, 2, 5, 16):
        for last in (False, True):
            want = [min(range(j, j + width), key=lambda x: (keys[x], -x if last else x)) for j in range(200 - width + 1)]
            assert substring_dedup.smallest(keys, width, last).tolist() == want


def test_words_hashed_together_have_the_hashes_of_the_library():
    rng = random.Random(2)
    texts = [b"", b" \t\n", b"One two\x0bTHREE\x0c", "é È 漢字 𝄞".encode()]
    texts += [bytes(rng.choice(b"abXYZ\xc3\xa9\x00\xff0123  \n\r") for _ in range(n)) for n in range(1, 200)]
    texts += [bytes(rng.choice(b"abcdXYZ\xc3\x00\xff") for _ in range(n)) for n in range(1, 60) for _ in range(9)]
    codes, sizes = substring_dedup.word_codes(texts)
    assert sizes.tolist() == [len(t.split()) for t in texts]
    assert codes.tolist() == [xxhash.xxh3_64_intdigest(w) for t in texts for w in t.lower().split()]
    assert [len(c) for c in substring_dedup.word_codes([b""])] == [0, 1]


@pytest.mark.parametrize("chunk", [1, 1 << 18])
def test_seeds_of_two_documents_at_least(spark, monkeypatch, chunk):
    """Repeated rows are one document; equal ids with other texts are two."""
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "TOGETHER", 300)
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, twice = text(90), text(70)
    data = [(i, text(40 + i) + " " + common) for i in range(9)] + [(3, common), (None, twice), (20, twice + " end"), (21, None), (22, "")]
    data += [(30, lone := text(120)), (30, lone), (30, lone)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated_seeds(df).collect()
    rows, holders = [], {}
    for i, t in data:
        codes, sizes = substring_dedup.word_codes([(t or "").encode()])
        for run, (_, seeds, places) in enumerate((substring_dedup.minimizers_of(codes, sizes), substring_dedup.runs_of(codes, sizes))):
            for seed, place in zip(seeds.view(np.int64).tolist(), places.tolist(), strict=True):
                rows.append((seed, substring_dedup.NO_ID if i is None else i, place, bool(run)))
                holders.setdefault((seed, bool(run)), set()).add((i, t))
    want = [r for r in rows if len(holders[r[0], r[3]]) > 1]
    assert len(want) > 100 and sorted((r._seed, r._id, r._at, r._run) for r in got) == sorted(want)
