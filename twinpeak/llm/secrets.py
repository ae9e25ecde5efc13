"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: an OR over its alternatives of an
AND over the trigrams of their literal runs. The index holds postings (trigram, document) for the
trigrams that some query names. Postings are intersected per document, and only candidates are
verified with the expression itself. A rule with an alternative that has no literal run of three
letters has no mandatory trigram, and scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, documents, let, lower_ascii, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match is kept when `group` has at least `least` characters.

    `needs` is a cheaper expression that every text with a kept match meets.
    """

    kind: str
    pattern: str
    group: int
    least: int
    any_case: bool = False
    needs: str | None = None


# The base rules of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, needs=r"[0-9a-f]{24}"),
)
#: Further kinds of well-known public shape.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/=-]+)", 1, 16, True),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/@]+)@", 1, 4),
)
RULES = BASE + EXTRA

GAP = None


def _runs(tree) -> list[tuple]:
    """Alternatives of a parsed expression, each a sequence of letters with GAP for anything else."""
    found: list[tuple] = [()]
    for op, arg in tree:
        if op is ops.LITERAL:
            here = [(chr(arg),)]
        elif op is ops.SUBPATTERN:
            here = _runs(arg[-1])
        elif op is ops.BRANCH:
            here = [run for branch in arg[1] for run in _runs(branch)]
        elif op is ops.MAX_REPEAT and arg[:2] == (0, 1):
            here = [(), *_runs(arg[2])]
        elif op is ops.MAX_REPEAT and arg[0] >= 1:
            here = [run + (GAP,) for run in _runs(arg[2])]
        else:
            here = [(GAP,)]
        found = [a + b for a, b in product(found, here)]
    return found


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """OR of AND-sets of lower-case trigrams that any match holds; None: nothing is mandatory."""
    sets = []
    for run in _runs(parser.parse(rule.pattern)):
        literals = "".join("\0" if x is GAP else x for x in run).lower().split("\0")
        sets.append(frozenset(s[i : i + 3] for s in literals for i in range(len(s) - 2)))
    if not all(sets):
        return None
    return [s for s in dict.fromkeys(sets) if not any(other < s for other in sets)]


def _spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches that pass, as structs (start, rank, kind, end)."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    rank = RULES.index(rule)
    # the texts between the matches place them: each start is the sum of all lengths before it
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["whole"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        hits = F.when(x["value"] >= rule.least, F.array_append(state["hits"], span)).otherwise(state["hits"])
        return F.struct(end.alias("at"), hits.alias("hits"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("hits")), step, lambda s: s["hits"])


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Row keys with the ranks of the rules whose trigram query their postings meet."""
    queries = {RULES.index(r): q for r in rules if (q := trigram_query(r)) is not None}
    grams = sorted({g for q in queries.values() for s in q for g in s})
    low = lower_ascii(F.col("_text"))
    present = let(low, lambda t: F.filter(
        F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull()
    ))
    postings = keyed.select("_id", "_hash", F.explode(present).alias("_gram"))
    # 60 trigrams a word of the posting set, joined by OR before and after the exchange
    words = range(len(grams) // 60 + 1)
    bits = [
        F.bit_or(F.when(F.floor(F.col("_gram") / 60) == w, F.expr("shiftleft(1L, cast(_gram % 60 as int))")).otherwise(F.lit(0).cast("long")))
        .alias(f"_w{w}")
        for w in words
    ]
    sets = postings.groupBy("_id", "_hash").agg(*bits)

    def holds(grams_of: frozenset[str]) -> Column:
        masks = [sum(1 << (grams.index(g) % 60) for g in grams_of if grams.index(g) // 60 == w) for w in words]
        tests = [F.col(f"_w{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in zip(words, masks, strict=True) if m]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def meets(query) -> Column:
        out = holds(query[0])
        for s in query[1:]:
            out = out | holds(s)
        return out

    ranks = F.array(*[F.when(meets(q), F.lit(rank)) for rank, q in queries.items()])
    return sets.select("_id", "_hash", F.filter(ranks, lambda x: x.isNotNull()).alias("_ranks")).filter(F.size("_ranks") > 0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, rank, kind, end) by start, then rank.

    Offsets are code points, end exclusive. Null text counts as empty. Repeated rows and ids, null
    ids and extra columns are fine: rows are matched by id and text fingerprint, and two different
    texts under one pair would only be verified by each other's rules as well.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_hash")
    )
    found = stored(candidates(keyed, rules))
    # only candidates need their text moved; every row is scanned in place by rules without a query
    full = [r for r in rules if trigram_query(r) is None]
    hits = keyed.join(found, ["_id", "_hash"], "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = [
        F.when(F.col("_text").rlike(r.needs), _spans(F.col("_text"), r)).otherwise(none) if r.needs else _spans(F.col("_text"), r)
        for r in full
    ]
    parts += [
        F.when(F.array_contains(F.coalesce("_ranks", F.array().cast("array<int>")), RULES.index(r)), _spans(F.col("_text"), r)).otherwise(none)
        for r in rules
        if r not in full
    ]
    return hits.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def redacted(text: str, spans: list) -> str:
    """A text with its spans masked; a small helper for reports."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op9(spark, sf_dir):
    found = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _sql() -> str:
    """The same spans in SQL, by string splitting and running sums."""
    parts = []
    for rank, r in enumerate(RULES):
        p = "'" + (("(?i)" if r.any_case else "") + r.pattern).replace("'", "''") + "'"
        parts.append(f"""
SELECT row_no, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least,
       list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS gaps,
       list_transform(regexp_extract_all(t, {p}, 0), lambda x: length(x)) AS wholes,
       list_transform(regexp_extract_all(t, {p}, {r.group}), lambda x: length(x)) AS vals FROM d""")
    one = "kind || ':' || start_at || ':' || end_at"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT row_no, rank, kind, least, unnest(range(1, len(wholes) + 1)) AS i, gaps, wholes, vals FROM m),
s AS (SELECT row_no, rank, kind,
             list_sum(gaps[1:i]) + coalesce(list_sum(wholes[1:i-1]), 0) AS start_at,
             list_sum(gaps[1:i]) + list_sum(wholes[1:i]) AS end_at
      FROM e WHERE vals[i] >= least),
g AS (SELECT row_no, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg({one}, ',' ORDER BY start_at, rank) FILTER (rank < {len(BASE)}) AS base,
             string_agg({one}, ',' ORDER BY start_at, rank) AS spans
      FROM s GROUP BY row_no)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_no)
"""


SQL = _sql()
assert all(re.compile(r.pattern) for r in RULES)
