"""Each operator against a brute-force version on a corpus of awkward cases, and on an empty one."""

from __future__ import annotations

import hashlib
import math
import os
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from corpus import frame, rows, words  # noqa: E402

from twinpeak.llm import (  # noqa: E402
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepieces,
    substring_dedup,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def good(spark):
    return spark.createDataFrame([(1,), (4,), (None,)], "doc_id long")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = []
    for r in rows():
        text = (r[1] or "").translate(LOWER)
        keep = max((i for i in groups[text] if i is not None), default=None)
        want.append((r[0], keep, len(groups[text]), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    # small blocks make many naming levels
    same(exact_dedup.exact_groups(docs, block_chars=7), want)
    same(exact_dedup.exact_groups(docs), want)
    assert exact_dedup.exact_groups(none).count() == 0


def shingles(text):
    w = [x.translate(LOWER) if isinstance(x, str) else x.lower() for x in words(text)]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def groups_by_brute_force(data, percent=85):
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(data)]


def test_jaccard_join(docs, none):
    same(jaccard_join.similar_groups(docs).drop("_text_print"), groups_by_brute_force(rows()))
    assert jaccard_join.similar_groups(none).count() == 0
    kept = [tuple(r) for r in jaccard_join.keep_one(docs).select("doc_id", "text", "_id", "_doc").collect()]
    assert Counter(r[0] for r in kept)[16] == 0 and (1, rows()[0][1], "x", "y") in kept
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_pipeline_joins_by_five_words_and_four_fifths(spark):
    """Two of 95 words changed: 81 of 101 five-word shingles are shared, and 84 of 100 four-word ones."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(95)]
    far = [w if i not in (30, 60) else "changed" + w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far)), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()) == [1, 3]
    assert jaccard_join.keep_one(docs).count() == 3


def test_line_dedup(docs, none):
    found = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert (15, "x\nunlike any other line here", 3, 1) in found
    kept = [r for r in found if r[0] == 14]
    # a run that overlaps its own later copies is cut down to what comes before them
    assert kept[0][1].split("\n")[:2] == ["a", "b c d e f g"] and kept[0][1].count("b c d e f g") == 1
    assert {r[1] for r in found if r[0] == 6} == {None} and {r[1:] for r in found if r[0] == 5} == {("", 0, 0)}
    assert sum(r[0] == 16 and r[1] == "" for r in found) == 1  # a later copy of document 1, repeated rows alike
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.keep_first_lines(docs).columns == docs.columns
    left = {r[0] for r in line_dedup.keep_first_lines(docs).select("doc_id").collect()}
    assert 16 not in left and {1, 2, 5, 6, 14, 15} <= left


def test_mixing(docs, none):
    got = [r.asDict() for r in mixing.repetitions(docs).collect()]
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
            left -= target[s]
        open_ -= over or set(open_)
    assert len(got) == len(rows())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["repeats"] <= 2
    for s in order:
        taken = sum(r["size"] * r["repeats"] for r in got if r["source"] == s)
        assert abs(taken - target[s]) <= max(len(words(r[1])) for r in rows() if r[3] == s)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["repeats"]
    assert times == +want
    assert mixing.repetitions(none).count() == 0 and mixing.mix(none).count() == 0


def test_secret_scans(docs, none):
    import re

    want = []
    for r in rows():
        text, spans = r[1] or "", []
        for rank, rule in enumerate(secrets.RULES):
            flags = re.I | re.A if rule.any_case else re.A
            for m in re.finditer(rule.pattern, text, flags):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), rank, rule.kind, m.end()))
        want.append((r[0], sorted(spans)))
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert [s[2] for s in dict(got)[18]] == ["assign", "access", "hex"]
    assert secrets.find_secrets(none).count() == 0


def test_trigram_queries():
    queries = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert queries["hex"] is None and queries["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in queries["assign"] and len(queries["assign"]) == 6


def test_secret_spans_by_code_point(spark):
    text = "𝄞é secret: 'abcdef' token=ab token=token:abcdef TOKEN = xyz-123"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(s.start, s.end) for s in secrets.find_secrets(df).first().spans]
    assert [text[a:b] for a, b in spans] == ["secret: 'abcdef", "TOKEN = xyz-123"]
    assert secrets.redacted(text, [s.asDict() for s in secrets.find_secrets(df).first().spans]).count("<assign>") == 2


def base_by_brute_force(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none, good):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_rules.judge(docs, good)
    same(judged.select("doc_id", *names), [(r[0], *base_by_brute_force(r[1])) for r in rows()])
    for r in judged.collect():
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(none, good).count() == 0
    assert quality_rules.keep_good(docs, good).columns == docs.columns
    assert quality_rules.judge(docs, good.limit(0)).count() == len(rows())


def test_quality_scores(docs, good):
    trusted = {r.doc_id for r in good.collect()} - {None}
    buckets, seen, liked = quality_rules.BUCKETS, Counter(), Counter()

    def grams(text):
        codes = [int(hashlib.md5(w).hexdigest()[:4], 16) for w in words(text or "")]
        return codes + [(a * 40503 + b * 9973) % buckets + buckets for a, b in zip(codes, codes[1:])]

    for r in docs.select("doc_id", "text").collect():
        seen.update(grams(r.text))
        liked.update(grams(r.text) if r.doc_id in trusted else [])
    share, a = liked.total() / seen.total(), quality_rules.SMOOTHING
    ratio = {g: math.log((liked[g] + a) / (n * share + a)) for g, n in seen.items()}
    want = {hash(r.text): [ratio[g] for g in grams(r.text)] for r in docs.select("text").collect()}
    means = sorted(round(sum(x) / len(x), 9) for x in want.values() if x)
    judged = quality_rules.judge(docs, good)
    assert sorted({round(r.score, 9) for r in judged.collect() if r.score is not None}) == sorted(set(means))
    for r in quality_rules.judge(docs, good.limit(0)).collect():
        assert r.score in (None, 0.0) and r.kept == (not r.base_failed)


def test_quality_classifier(docs, none, good):
    got = quality_classifier.resample(docs, good, 0.5).collect()
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len(rows()) // 2
    again = quality_classifier.resample(docs.repartition(2), good, 0.5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert {r.log_weight for r in got if r.doc_id in (5, 6, 7)} == {0.0}
    assert quality_classifier.resample(none, good, 0.5).count() == 0


def test_weights_read_whole_words(spark):
    """Texts that differ only before the words' ends are told apart."""
    ends = ["ing", "tion", "ment", "ness"]
    text = lambda stem: " ".join(stem + str(i) + ends[i % 4] for i in range(80))
    data = [(1, text("good")), (2, text("good") + " tail"), (3, text("spam")), (4, text("spam") + " tail")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    ratios = quality_classifier.log_ratios(quality_classifier.models(docs, docs.filter("doc_id = 1")))
    weight = {r.doc_id: r.log_weight for r in quality_classifier.weights(docs, ratios).collect()}
    assert min(weight[1], weight[2]) > max(weight[3], weight[4]) + 10


def test_language_id(docs, none):
    net = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    assert {got[i].lang_pred for i in (5, 6, 7)} == {"und"} and got[11].lang_pred in net.langs
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.fit(none) is None and language_id.predict(none, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_substring_dedup(docs, none):
    got = {(r.doc_id, r.other_id): r for r in substring_dedup.repeated_passages(docs).collect()}
    first = got[2, 1]
    assert (first.start_word, first.end_word, first.other_start, first.other_end, first.n_matched) == (0, 90, 0, 90, 89)
    assert got[12, 11].end_word == 6000 and got[16, 1].n_matched == 90
    assert substring_dedup.repeated_passages(none).count() == 0


def test_sentencepiece_round_trip(docs, none):
    tokens = sentencepieces.encode(docs)
    back = sentencepieces.decode(tokens, text_col="back").select("doc_id", "back")
    same(back, [(r[0], r[1]) for r in rows()])
    assert sentencepieces.encode(none).count() == 0


def test_blocks_of_the_same_texts_stay_apart(spark, tmp_path):
    """Part files of the same texts, with units or without any, and a text's own NUL after a space."""
    data = [(1, "some words\nof a text"), (2, None), (3, "")]
    for path, part in (("full", data), ("bare", data[1:])):
        for i in range(2):
            some = [(10 * i + r[0], r[1]) for r in part]
            spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / path))
        docs = spark.read.parquet(str(tmp_path / path))
        assert docs.rdd.getNumPartitions() == 2
        back = sentencepieces.decode(sentencepieces.encode(docs), text_col="back").select("doc_id", "back")
        same(back, [(10 * i + r[0], r[1]) for i in range(2) for r in part])
    odd = [(1, "a \x00b"), (2, "a \x00b\nb \x00"), (3, "\n\n \nb"), (4, "\x00")]
    back = sentencepieces.decode(sentencepieces.encode(spark.createDataFrame(odd, "doc_id long, text string")), text_col="back")
    same(back.select("doc_id", "back"), odd)


def test_words_are_hashed_once_for_counts_and_scores(spark):
    docs = spark.createDataFrame([(1, "One two  one"), (None, None), (2, " ")], "doc_id long, text string")
    code = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    assert {r.doc_id: r._codes for r in quality_rules.word_codes(docs).collect()} == {1: [code(w) for w in ("One", "two", "one")], None: [], 2: []}
    judged = quality_rules.judge(docs, docs.filter("doc_id = 1").select("doc_id"))
    assert "md5" not in judged._jdf.queryExecution().optimizedPlan().toString().lower()
