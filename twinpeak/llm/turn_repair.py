"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows, in order, are the steps of a lattice whose states are what stands last in the
repaired conversation: nothing, a system, a user or an assistant turn. Arcs keep, rerole or delete a
row or insert a turn, at integer costs. The auction keeps a price for each node and one path from the
origin: at its end node, the price is raised to the cheapest arc's cost plus price and the path
contracts, or, when the price is right already, the path extends along that arc. When the path meets
the sink, the prices are an optimal dual: every cheapest path runs along tight arcs, those whose cost
is the difference of their ends' prices, and the ASCII-least one is traced over tight arcs.

A conversation may hold any share of all rows. Rows are range-sorted by conversation and turn, so a
long one spreads over partitions; a lattice is solved in blocks of BLOCK rows. A conversation of one
block needs no more. Of longer ones, each block gives its 4 x 4 costs from state to state, and 32
neighbours at a time are joined into one, up to a single node; prices then go down the same tree and
tell each block the cost from its end. What only one task can do is the digest, since SHA-256 is one
chain of bytes: texts stream through it in order, a row at a time, and only the answer is kept.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Window, stored, work_partitions

BLOCK_BITS = 5
BLOCK = 1 << BLOCK_BITS
FAR = 1 << 40

#: States, costs, and what the state at a conversation's end still costs.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
AT_END = (0, 6, 3, 0)
ENDINGS = ("", "II", "I", "")
INITIALS = "sua"
#: A row's code is its initial's place (3: another) plus four times its fault.
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)

PLAIN_ENTRIES = (0, FAR, FAR, FAR)


def follows(state: int) -> int:
    """The turn that a rerole or an insertion makes: an assistant's after a user's, else a user's."""
    return ASSISTANT if state == USER else USER


def row_arcs(codes: str):
    """Arcs (edit, cost, node) by node; node 4 i + state stands before row i, with the rows' least costs.

    Arcs are in ASCII order of their edits. The nodes of the block's end have none.
    """
    arcs, least = [], []
    for i, letter in enumerate(codes):
        fault, initial = divmod(ord(letter) - 65, 4)
        least.append({SOUND: 0, CUT_OFF: TRUNCATED}.get(fault, DELETE))
        for state in range(4):
            turn = follows(state)
            here = [("D", DELETE, 4 * i + 4 + state), ("I", INSERT, 4 * i + turn)]
            if fault in (SOUND, CUT_OFF):
                more = TRUNCATED if fault == CUT_OFF else 0
                if initial < 3 and (initial + 1 == turn or (initial == 0 and state == NOTHING)):
                    here.append(("K", KEEP + more, 4 * i + 5 + initial))
                here.append(("R", REROLE + more, 4 * i + 4 + turn))
            arcs.append(here)
    return arcs, least


def node_arcs(costs):
    """The same for a run of nodes of the tree, each with its 16 costs from state to state."""
    arcs = [
        [("", cost[4 * a + b], 4 * i + 4 + b) for b in range(4) if cost[4 * a + b] < FAR]
        for i, cost in enumerate(costs)
        for a in range(4)
    ]
    return arcs, [min(cost) for cost in costs]


class Lattice:
    """Arcs with a sink behind the last states, cut down to nodes that reach it, and feasible prices."""

    def __init__(self, arcs, least, exits):
        self.sink = len(arcs) + 4
        ends = [[("", cost, self.sink)] if cost < FAR else [] for cost in exits]
        before: list[list[int]] = [[] for _ in range(self.sink + 1)]
        every = [*arcs, *ends, []]
        for node, out in enumerate(every):
            for _, _, to in out:
                before[to].append(node)
        alive, todo = {self.sink}, [self.sink]
        while todo:
            for node in before[todo.pop()]:
                if node not in alive:
                    alive.add(node)
                    todo.append(node)
        self.alive = alive
        self.arcs = [[arc for arc in out if arc[2] in alive] for out in every]
        # What the rows that are left cost at least: no arc is cheaper than the drop along it.
        rest = [0]
        for cost in reversed(least):
            rest.append(rest[-1] + cost)
        floor = min(exits)
        self.prices = [floor + rest[len(least) - i] for i in range(len(least) + 1) for _ in range(4)] + [0]

    def auction(self, origin: int) -> int:
        """Raise prices until the path from the origin meets the sink; the cost of that path."""
        arcs, prices, path = self.arcs, self.prices, [origin]
        while path[-1] != self.sink:
            node = path[-1]
            best, to = min((cost + prices[to], to) for _, cost, to in arcs[node])
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return prices[origin]

    def tight(self, node: int):
        return [arc for arc in self.arcs[node] if self.prices[node] == arc[1] + self.prices[arc[2]]]

    def on_shortest(self, origin: int) -> set[int]:
        """Nodes of all cheapest paths from an origin whose auction is over."""
        seen, todo, before = {origin}, [origin], {}
        while todo:
            node = todo.pop()
            for _, _, to in self.tight(node):
                before.setdefault(to, []).append(node)
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        found, todo = {self.sink}, [self.sink]
        while todo:
            for node in before.get(todo.pop(), ()):
                if node not in found:
                    found.add(node)
                    todo.append(node)
        return found

    def least_edits(self, origin: int) -> tuple[str, int, int]:
        """The ASCII-least edits among the cheapest paths, the state they end in and what they cost."""
        allowed, node, edits, spent = self.on_shortest(origin), origin, [], 0
        while True:
            edit, cost, to = next(arc for arc in self.tight(node) if arc[2] in allowed)
            if to == self.sink:
                return "".join(edits), node % 4, spent
            edits.append(edit)
            spent += cost
            node = to


def _state_costs(arcs, least) -> tuple[int, ...]:
    found = [FAR] * 16
    for end in range(4):
        lattice = Lattice(arcs, least, [0 if s == end else FAR for s in range(4)])
        for start in range(4):
            if start in lattice.alive:
                found[4 * start + end] = lattice.auction(start)
    return tuple(found)


@lru_cache(maxsize=20_000)
def block_costs(codes: str) -> tuple[int, ...]:
    """Costs from each state before a block to each state after it."""
    return _state_costs(*row_arcs(codes))


def joined_costs(costs) -> tuple[int, ...]:
    return _state_costs(*node_arcs(costs))


@lru_cache(maxsize=50_000)
def block_edits(codes: str, entries: tuple, exits: tuple) -> tuple:
    """(state before, edits, state after, cost) for each state with a finite entry."""
    lattice, found = Lattice(*row_arcs(codes), exits), []
    for state in range(4):
        if entries[state] < FAR and state in lattice.alive:
            lattice.auction(state)
            found.append((state, *lattice.least_edits(state)))
    return tuple(found)


def handed_down(costs, entries, exits) -> list[tuple[int, ...]]:
    """Costs to the end at each border of a run of nodes: finite for states on a cheapest path only."""
    lattice = Lattice(*node_arcs(costs), exits)
    borders = [[FAR] * 4 for _ in range(len(costs) + 1)]
    for state in range(4):
        if entries[state] < FAR and state in lattice.alive:
            lattice.auction(state)
            for node in lattice.on_shortest(state) - {lattice.sink}:
                borders[node // 4][node % 4] = lattice.prices[node]
    return [tuple(b) for b in borders]


def key_text(value: Column) -> Column:
    """A value as text; null reads as one space."""
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the checksum of `conv_id:turn`: dropped, emptied, unstopped, repeated or made a user's."""
    fault = F.pmod(F.crc32(F.concat(key_text(F.col("conv_id")), F.lit(":"), key_text(F.col("turn")))), F.lit(20))
    text = key_text(F.col("text"))
    text = F.when(F.col("_f") == 1, F.lit("")).when(F.col("_f") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (
        conversations.select("conv_id", F.col("turn").cast("long"), "role", "text", fault.alias("_f"))
        .filter("_f != 0")
        .select(
            key_text(F.col("conv_id")).alias("_key"),
            "turn",
            F.when(F.col("_f") == 4, F.lit("user")).otherwise(key_text(F.col("role"))).alias("role"),
            text.alias("text"),
            F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def placed(rows: DataFrame) -> DataFrame:
    """Rows with _part and _row in the order of conversation, turn, role and the text's digest.

    Equal rows are told apart by where they were read, so even a third of all rows being one is spread.
    """
    keyed = rows.withColumn("_digest", F.md5("text")).withColumn("_spot", F.monotonically_increasing_id())
    order = ["_key", "turn", "role", "_digest", "_spot"]
    ranged = keyed.repartitionByRange(work_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(
        ranged.drop("_spot")
        .withColumn("_part", F.spark_partition_id().cast("long"))
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )


def coded(rows: DataFrame) -> DataFrame:
    """_key, _part, _row, _code, and _index: the row's number among those of its conversation in its part."""
    blank = ~F.col("text").rlike(BLANKS.replace("[", "[^"))
    cut_off = ~F.col("text").rlike(rf"[.!?]{BLANKS}*\z")
    # The first of equal rows is found by a minimum, and only it meets a partner: each place is one row.
    first = rows.groupBy("_key", "role", "_digest").agg(F.min(F.struct("_part", "_row")).alias("_p")).select("_p._part", "_p._row", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_first").isNull(), DUPLICATE).when(F.col("_cut"), CUT_OFF).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    faults = rows.select("_key", "_part", "_row", place.alias("_place"), blank.alias("_blank"), cut_off.alias("_cut"))
    group = Window.partitionBy("_part", "_key")
    return (
        faults.join(first, ["_part", "_row"], "left")
        .withColumn("_code", F.char((F.lit(65) + 4 * fault + F.col("_place")).cast("long")))
        .select("_key", "_part", "_row", "_code", (F.col("_row") - F.min("_row").over(group)).alias("_index"), F.count(F.lit(1)).over(group).alias("_n"))
    )


def _mapped(df: DataFrame, schema: str, fn) -> DataFrame:
    """Apply fn to each row's values; it gives a list of rows."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.string() if p.split()[1] == "string" else pa.int64() if p.split()[1] == "long" else pa.list_(pa.int64()) for p in schema.split(", ")]

    def run(tables):
        for batch in tables:
            made = [row for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in fn(*values)]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.mapInArrow(run, schema)


def tree_prices(leaves: DataFrame) -> DataFrame:
    """(_key, _node, _codes) of long conversations to their blocks' costs to the end: entries and exits."""
    nodes = stored(_mapped(leaves.select("_key", "_node", "_codes"), "_key string, _node long, _costs array<long>", lambda k, n, c: [(k, n, block_costs(c))]))
    levels = []
    while (nodes.agg(F.max("_node")).first()[0] or 0) > 0:
        run = F.array_sort(F.collect_list(F.struct("_node", "_costs")))
        parents = stored(
            nodes.groupBy("_key", F.shiftright("_node", BLOCK_BITS).alias("_up"))
            .agg(run.alias("_run"))
            .select("_key", "_up", F.transform("_run", lambda x: x["_node"]).alias("_nodes"), F.flatten(F.transform("_run", lambda x: x["_costs"])).alias("_all"))
        )
        levels.append(parents)
        joined = _mapped(parents.select("_key", "_up", "_all"), "_key string, _node long, _costs array<long>", lambda k, n, c: [(k, n, joined_costs(_sixteens(c)))])
        nodes = stored(joined)
    long = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    known = nodes.select("_key", "_node", long(PLAIN_ENTRIES).alias("_entries"), long(AT_END).alias("_exits"))
    for parents in reversed(levels):
        told = parents.join(known.withColumnRenamed("_node", "_up"), ["_key", "_up"])
        told = told.select("_key", "_nodes", "_all", "_entries", "_exits")
        known = stored(_mapped(told, "_key string, _node long, _entries array<long>, _exits array<long>", _children))
    return known


def _sixteens(flat):
    return [flat[i : i + 16] for i in range(0, len(flat), 16)]


def _children(key, nodes, flat, entries, exits):
    borders = handed_down(_sixteens(flat), entries, exits)
    return [(key, node, borders[i], borders[i + 1]) for i, node in enumerate(nodes)]


def block_plans(codes: DataFrame) -> DataFrame:
    """(_key, _part, _block, _codes, _edits) of every block; _edits lists what each state before it leads to."""
    # A conversation that reaches over a border is the last of one part and the first of the next.
    borders = codes.groupBy("_part").agg(F.min("_key").alias("_least"), F.max("_key").alias("_most"))
    block = F.shiftright("_index", BLOCK_BITS)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_code"))), lambda x: x["_code"]), "")
    blocks = codes.groupBy("_key", "_part", block.alias("_block")).agg(letters.alias("_codes"), F.max("_n").alias("_n"))
    # One row for each partition.
    blocks = stored(blocks.join(F.broadcast(borders), "_part").withColumn("_alone", (F.col("_n") <= BLOCK) & ~F.col("_key").isin(F.col("_least"), F.col("_most"))))
    schema = "_key string, _part long, _block long, _codes string, _edits string"
    plan = lambda k, p, b, c, entries, exits: [(k, p, b, c, _printed(block_edits(c, tuple(entries), tuple(exits))))]
    alone = _mapped(blocks.filter("_alone").select("_key", "_part", "_block", "_codes"), schema, lambda k, p, b, c: plan(k, p, b, c, PLAIN_ENTRIES, AT_END))
    longer = blocks.filter("not _alone")
    most = longer.agg(F.max("_block")).first()[0]
    if most is None:
        return alone
    bits = int(most).bit_length()
    longer = longer.withColumn("_node", F.shiftleft("_part", bits) + F.col("_block"))
    told = longer.join(tree_prices(longer), ["_key", "_node"]).select("_key", "_part", "_block", "_codes", "_entries", "_exits")
    return alone.unionByName(_mapped(told, schema, plan))


def _printed(edits) -> str:
    return ";".join(f"{before}{edit}{after}{cost}" for before, edit, after, cost in edits)


def _read(text: str) -> dict[int, tuple[str, int, int]]:
    """What _printed wrote: digits, edits, a digit for the state after, digits of the cost."""
    found = {}
    for part in text.split(";") if text else ():
        edits = part[1:].rstrip("0123456789")
        numbers = part[1 + len(edits) :]
        found[int(part[0])] = edits, int(numbers[0]), int(numbers[1:])
    return found


class _Conversation:
    """One conversation as its blocks and rows pass by in order."""

    def __init__(self, key: str):
        self.key, self.state, self.cost, self.audit, self.digest, self.first = key, NOTHING, 0, [], hashlib.sha256(), True
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.turns, self.low, self.high = 0, None, None
        self.left = iter(())

    def turn_out(self, role: str, text: str) -> None:
        self.digest.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False

    def insert(self) -> None:
        self.state = follows(self.state)
        self.turn_out(("user", "assistant")[self.state - USER], "")

    def block(self, codes: str, edits: str) -> None:
        """Begin a block: its codes are counted, and the edits for the state so far are taken."""
        self.finish()
        for letter in codes:
            fault, initial = divmod(ord(letter) - 65, 4)
            self.faults[fault] += 1
            if self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.last = initial
        # Edits tell the state after the block too; it is reached by applying them.
        text, _, cost = _read(edits)[self.state]
        self.audit.append(text)
        self.cost += cost
        self.left = iter(text)

    def row(self, turn, role: str, text) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        for edit in self.left:
            if edit == "I":
                self.insert()
                continue
            if edit == "K":
                self.state = 1 + INITIALS.index(role[0])
                self.turn_out(role, text)
            elif edit == "R":
                self.state = follows(self.state)
                self.turn_out(("user", "assistant")[self.state - USER], text)
            return

    def finish(self) -> None:
        """Insertions behind a block's last row."""
        for _ in self.left:
            self.insert()

    def result(self) -> tuple:
        self.finish()
        ending = ENDINGS[self.state]
        self.cost += AT_END[self.state]
        for _ in ending:
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF], self.illegal, self.cost, "".join(self.audit) + ending, self.digest.hexdigest()


ANSWER = "_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(tables):
    now, done = None, []
    names = [p.split()[0] for p in ANSWER.split(", ")]
    types = [pa.string() if p.endswith("string") else pa.int64() for p in ANSWER.split(", ")]

    def out(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in tables:
        for key, at, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "_at", "turn", "role", "text")), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(key)
            if at < 0:
                now.block(role, text)
            else:
                now.row(turn, role, text)
        yield out(done)
        done = []
    yield out([now.result()] if now is not None else [])


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, the cheapest audit and the digest of the repaired text, for every conv_id of the damaged rows' table.

    Nulls read as one space; a null conv_id is a conversation of its own, and null turns come first.
    Rows of one turn go by role, then by the digest of their text; repeated rows are duplicates. A role
    that begins with no s, u or a (an empty one, too) can't be kept. A conversation without rows after
    damage has zeros, an empty audit and the digest of nothing. Other columns are not read; an empty
    table gives no rows. The audit is as long as the conversation has edits.
    """
    rows = placed(damaged(conversations))
    codes = stored(coded(rows))
    plans = stored(block_plans(codes))
    faulty = F.ascii("_code") - 65 >= 4 * BLANK
    places = codes.select("_part", "_row", F.shiftright("_index", BLOCK_BITS).alias("_block"), faulty.alias("_gone"))
    # Deleted rows bring their turn only; a block's plan comes before its rows.
    texts = rows.join(places, ["_part", "_row"]).select(
        "_key", "_part", "_block", F.col("_row").alias("_at"), "turn", "role", F.when(~F.col("_gone"), F.col("text")).alias("text")
    )
    heads = plans.select("_key", "_part", "_block", F.lit(-1).cast("long").alias("_at"), F.lit(None).cast("long").alias("turn"), F.col("_codes").alias("role"), F.col("_edits").alias("text"))
    order = ["_key", "_part", "_block", "_at"]
    told = texts.unionByName(heads).repartition("_key").sortWithinPartitions(*order).mapInArrow(_stream, ANSWER)
    every = conversations.select("conv_id").distinct().withColumn("_key", key_text(F.col("conv_id")))
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(told, "_key", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
