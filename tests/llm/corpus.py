"""Small corpora that hold the awkward cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _print string, _doc string, label string"


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing extra columns."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(90)]
    near = base[:40] + ["changed"] + base[41:]
    far = [word() for _ in range(60)]
    long = " ".join(word() for _ in range(6000))
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (4, " ".join(far)), (5, ""), (6, None), (7, "  \n\t\n "),
        (8, "one"), (9, "one"), (10, "two words"), (11, long), (12, long + " end"), (13, "é È ß 漢字 𝄞"), (None, " ".join(far)),
        (14, "a\n" * 70 + "b c d e f g\nb c d e f g"), (15, "b c d e f g\nx\nunlike any other line here"), (16, " ".join(base)), (16, " ".join(base)),
        (17, " ".join(["same"] * 120)), (18, "password = hunter22 AKIA" + "Q" * 16 + " " + "0af9" * 8),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang, source = (None, "en", "fr")[i % 3], (None, "web", "Web", "books")[i % 4]
        out.append((doc_id, text, lang, source, None if text is None else len(text), "x", None, "y", "z"))
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def words(text):
    return (text or "").encode().split()
