"""Line dedup: later copies of repeated line runs are deleted.

Documents are sequences of line IDs. Prefix doubling ranks the runs of 1, 2, 4 ... lines that
start at each place: a run of twice the length is ranked by the pair of its halves' ranks, in
order, as in a suffix array. All places that share their first L lines (an LCP interval of depth
L) are then named by two overlapping ranks of the largest power of two within L.

A run counts when it has at least `min_words` words. For each place, the shortest such run that
starts there and the shortest that ends there are looked up; every maximal repeat is the union of
those within it. All but the first copy, by (doc_id, text fingerprint, place), are deleted. Lines
that occur once can't be part of a repeat and take part in nothing after the first count, so a
doubling only handles stretches of repeated lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, WORD, carried, documents, let, numbered, stored

#: Fewest words of a run that is worth deleting.
MIN_WORDS = 5
KEY = ["_id", "_print"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return carried(docs, _id=F.coalesce(F.col(id_col), F.lit(NO_ID)), _print=F.xxhash64(text))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that hold a word: key, _pos among all lines, _ord among these, 128-bit _line, _words."""
    text = F.coalesce(F.col(f"_doc.{text_col}"), F.lit(""))
    parts = let(F.split(text, "\n", -1), lambda x: F.transform(x, lambda s, i: F.struct(i.alias("_pos"), s.alias("_text"))))
    full = F.filter(parts, lambda p: p["_text"].rlike(WORD))
    rows = _keyed(docs, id_col, text_col).select(*KEY, F.posexplode(full).alias("_ord", "_row"))
    return rows.select(
        *KEY, "_ord", "_row._pos", F.unhex(F.md5("_row._text")).alias("_line"), F.regexp_count("_row._text", F.lit(WORD)).alias("_words")
    ).distinct()  # a repeated row is one document


def ranked_runs(lines: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Repeated lines with _seg (a stretch of them) and _rank0, _rank1 ...: ranks of the 2^k lines
    from there on, null where that run occurs once or leaves the stretch; and the last k."""
    lines = stored(lines)
    ids = stored(numbered(lines.groupBy("_line").count().filter("count > 1").select("_line"), ["_line"], "_rank0"))
    rows = lines.join(ids, "_line").select(*KEY, "_ord", "_pos", "_words", "_rank0")
    rows = rows.withColumn("_seg", F.col("_ord") - F.row_number().over(Window.partitionBy(*KEY).orderBy("_ord")))
    rows, k = stored(rows), 0
    along = Window.partitionBy(*KEY, "_seg").orderBy("_ord")
    while 2 << k <= longest:
        paired = stored(rows.withColumns({"_a": F.col(f"_rank{k}"), "_b": F.lead(f"_rank{k}", 1 << k).over(along)}))
        pairs = paired.filter("_a is not null and _b is not null").groupBy("_a", "_b").count().filter("count > 1")
        names = stored(numbered(pairs.select("_a", "_b"), ["_a", "_b"], f"_rank{k + 1}"))
        # places without a pair keep out of the join, where they would share one key
        whole = paired.filter("_a is not null and _b is not null").join(names, ["_a", "_b"], "left")
        rest = paired.filter("_a is null or _b is null").withColumn(f"_rank{k + 1}", F.lit(None).cast("long"))
        rows, k = stored(whole.unionByName(rest).drop("_a", "_b")), k + 1
    return rows, k


def _shortest(words: Column, min_words: int) -> Column:
    """How many of the leading counts reach min_words; null if all together don't."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    step = lambda s, x: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["sum"] + x).alias("sum")))
    return F.aggregate(words, start, step, lambda s: F.when(s["sum"] >= min_words, s["n"]))


def repeated_later(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and _pos of every line inside a later copy of a run."""
    rows, top = ranked_runs(line_table(docs, id_col, text_col), min_words)
    along = Window.partitionBy(*KEY, "_seg").orderBy("_ord")
    ahead, behind = along.rowsBetween(0, min_words - 1), along.rowsBetween(1 - min_words, 0)
    # a run of enough words has at most min_words lines, so these lists have at most so many items
    near = rows.select(
        *KEY, "_seg", "_ord",
        F.collect_list("_words").over(ahead).alias("_wa"), F.collect_list("_words").over(behind).alias("_wb"),
        *[F.collect_list(F.coalesce(f"_rank{k}", F.lit(-1))).over(w).alias(f"_{s}{k}") for k in range(top + 1) for s, w in (("a", ahead), ("b", behind))],
    )
    near = near.withColumns({"_la": _shortest(F.col("_wa"), min_words), "_lb": _shortest(F.reverse("_wb"), min_words)})

    def names(side: str, length: Column, first: Column) -> Column:
        """Ranks at the run's first place and at the last place that leaves a power of two."""
        picked = F.lit(None).cast("array<long>")
        for k in range(top + 1):
            ranks = F.col(f"_{side}{k}")
            both = F.array(F.get(ranks, first), F.get(ranks, first + length - (1 << k)))
            picked = F.when((length >= 1 << k) & (length < 2 << k), both).otherwise(picked)
        return picked

    la, lb = F.col("_la"), F.col("_lb")
    runs = near.select(*KEY, F.explode(F.array(
        F.struct(F.col("_ord").alias("_start"), la.alias("_n"), names("a", la, F.lit(0)).alias("_name")),
        F.struct((F.col("_ord") - lb + 1).alias("_start"), lb.alias("_n"), names("b", lb, F.size("_wb") - lb).alias("_name")),
    )).alias("_run")).select(*KEY, "_run.*").filter("_n is not null and _name[0] >= 0 and _name[1] >= 0")
    runs = stored(runs.select(*KEY, "_start", "_n", F.col("_name")[0].alias("_x"), F.col("_name")[1].alias("_y")).distinct())
    firsts = stored(runs.groupBy("_n", "_x", "_y").agg(F.min(F.struct(*KEY, "_start")).alias("_first"), F.count(F.lit(1)).alias("_times")))
    later = runs.join(firsts.filter("_times > 1"), ["_n", "_x", "_y"]).filter(F.struct(*KEY, "_start") > F.col("_first"))
    gone = later.select(*KEY, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_n") - 1)).alias("_ord")).distinct()
    return gone.join(rows.select(*KEY, "_ord", "_pos"), [*KEY, "_ord"]).select(*KEY, "_pos")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with text cut, and n_lines, n_removed (lines that hold a word).

    Lines are compared as they are. Lines without a word stay where they are and don't end a run.
    Null text stays null and has no lines. Rows that repeat an id and text are one document, so
    they don't delete each other. A run that overlaps its own later copy is cut to what comes before. Extra columns are kept, but for ones named n_lines or n_removed.
    An empty table stays empty.
    """
    gone = repeated_later(docs, min_words, id_col, text_col).groupBy(*KEY).agg(F.collect_set("_pos").alias("_gone"))
    text = F.col(f"_doc.{text_col}")

    def left(x):
        kept = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: x[i]), "\n")

    cut = F.when(F.col("_gone").isNull(), text).otherwise(let(F.split(text, "\n", -1), left))
    filled = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: s.rlike(WORD))
    joined = _keyed(docs, id_col, text_col).join(stored(gone), KEY, "left")
    named = [F.col(f"_new.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        F.col("_doc").withField(text_col, cut).alias("_new"), F.size(filled).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    ).select(*named, "n_lines", "n_removed")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """Documents with later copies cut out; those that had words and lost all of them go."""
    packed = carried(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    left = dedup_lines(packed).filter("n_removed = 0 or n_removed < n_lines")
    return left.select(F.col("_doc").withField("text", F.col("text")).alias("_doc")).select("_doc.*")


def op8(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


#: Runs as joined text; the order of first copies is by doc_id, as ids are unique in the tables.
SQL = f"""
WITH l AS (SELECT doc_id, pos, string_split(text, chr(10))[pos] AS line
           FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
w AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS o,
             len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
j AS (SELECT a.doc_id, a.o AS s, b.o AS e, sum(c.n) AS words, string_agg(c.line, chr(10) ORDER BY c.o) AS run
      FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.o BETWEEN a.o AND a.o + {MIN_WORDS - 1}
               JOIN w c ON c.doc_id = a.doc_id AND c.o BETWEEN a.o AND b.o GROUP BY ALL),
m AS (SELECT * FROM j WHERE words >= {MIN_WORDS}),
q AS (SELECT doc_id, s, e, run FROM m QUALIFY e = min(e) OVER (PARTITION BY doc_id, s) OR s = max(s) OVER (PARTITION BY doc_id, e)),
f AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY run) AS first FROM q),
x AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS o FROM f WHERE (doc_id, s) > first),
g AS (SELECT w.doc_id, w.pos FROM w JOIN x USING (doc_id, o)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN t USING (doc_id)
"""
