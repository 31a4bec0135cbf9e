"""Conversation structure repair: cheapest edits by shortest paths over (rows read, state of the role pattern).

Edit costs are small integers, so distances come from Dial's ring of buckets,
searched from the end; the audit is then walked from the start along tight arcs,
always the one whose initial is least.

A conversation that is long is cut into runs of rows. Of each run only the four
by four costs between states are needed to know the distances at its ends, so
runs are searched side by side, and no task holds more than one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from marlspike.llm.common import Scratch, bounded_batches

#: Rows, and bytes of text, from which on a conversation is cut into runs.
LONG_ROWS, LONG_BYTES = 20_000, 64 << 20
#: Rows of a run, about.
RUN_ROWS = 100_000
#: Characters of repaired text that are handed on together while a long conversation is hashed.
PIECE = 1 << 20

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = 4
#: The state that a turn of an initial leads to, by the state before it.
_READ = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: The state after an inserted or reroled turn, and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Where a conversation may end, and what is left to pay there.
GOALS = (0, None, None, 0)
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
_RING = max(REROLE + CUT, DELETE, INSERT) + 1


def _code(initial: str, cut: bool, dead: bool) -> int:
    """What of a row matters to its edits, as one number: role initial, truncated, blank or duplicate."""
    return ("sua".find(initial) + 1 if initial else 0) << 2 | cut << 1 | dead


def _moves(code: int) -> list[list[tuple[str, int, int] | None]]:
    """For each state the moves over a row, by initial: (initial, next state, cost)."""
    initial, cut, dead = "-sua"[code >> 2], code >> 1 & 1, code & 1
    out = []
    for q in range(STATES):
        ways = [("D", q, DELETE)]
        if not dead:
            if (initial, q) in _READ:
                ways.append(("K", _READ[initial, q], KEEP + CUT * cut))
            ways.append(("R", _NEXT[q], REROLE + CUT * cut))
        out.append(ways)
    return out


MOVES = [_moves(c) for c in range(16)]
#: For each row and state after it: (state before, cost).
_BEFORE = [[[(p, c) for p in range(STATES) for _, t, c in MOVES[code][p] if t == q] for q in range(STATES)] for code in range(16)]
_INSERTED = [[p for p in range(STATES) if _NEXT[p] == q] for q in range(STATES)]


def distances(codes: bytes, ends: tuple) -> list[int]:
    """Least costs from (rows read, state), laid out as ``4 * rows + state``, to the end, where ``ends`` are left to pay; -1 where there is no way."""
    n = len(codes)
    out, ring = [-1] * (STATES * (n + 1)), [[] for _ in range(_RING)]
    seeds = sorted((d, q) for q, d in enumerate(ends) if d is not None)
    d, waiting = (seeds[0][0] if seeds else 0), 0
    while waiting or seeds:
        while seeds and seeds[0][0] == d:
            ring[d % _RING].append(STATES * n + seeds.pop(0)[1])
            waiting += 1
        bucket = ring[d % _RING]
        while bucket:  # arcs without cost fill it while it is emptied
            at = bucket.pop()
            waiting -= 1
            if out[at] >= 0:
                continue
            out[at] = d
            i, q = at >> 2, at & 3
            for p in _INSERTED[q]:
                if out[at - q + p] < 0:
                    ring[(d + INSERT) % _RING].append(at - q + p)
                    waiting += 1
            if i:
                for p, c in _BEFORE[codes[i - 1]][q]:
                    if out[at - q - STATES + p] < 0:
                        ring[(d + c) % _RING].append(at - q - STATES + p)
                        waiting += 1
        d += 1
    return out


def walk(codes: bytes, left: list[int], state: int, last: bool) -> tuple[str, int]:
    """Initials of the cheapest edits from a state on, the least of them where several are, and the state at the end.

    ``left`` are the distances. What may be inserted at the end of a run is part
    of the next one, so only the last run of a conversation inserts there.
    """
    out, i, q, n = [], 0, state, len(codes)
    while i < n or (last and left[STATES * n + q] > 0):
        d = left[STATES * i + q]
        ways = [("I", i, _NEXT[q], INSERT)]
        if i < n:
            ways += [(a, i + 1, t, c) for a, t, c in MOVES[codes[i]][q]]
        a, i, q, _ = min(w for w in ways if left[STATES * w[1] + w[2]] >= 0 and left[STATES * w[1] + w[2]] + w[3] == d)
        out.append(a)
    return "".join(out), q


def edited(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(initial, role, text)`` of the turns that edits leave of ``(role, text)``."""
    q, source = state, iter(rows)
    for a in audit:
        if a == "I":
            yield a, _ROLE[q], ""
            q = _NEXT[q]
            continue
        role, text = next(source)
        if a == "D":
            continue
        if a == "R":
            role = _ROLE[q]
        q = _NEXT[q] if a == "R" else _READ[role[:1], q]
        yield a, role, text


def fault(role: str, text: str, seen: bool) -> str:
    """The first fault of a row: ``blank``, ``duplicate``, ``truncated`` or none."""
    t = text.rstrip(_SPACE)
    return "blank" if not t else "duplicate" if seen else "truncated" if t[-1] not in ".!?" else ""


@dataclass
class Facts:
    """Counts over rows in order, of a conversation or a run of one."""

    low: int | None = None
    high: int | None = None
    first: int | None = None
    turns: int = 0
    turn: int | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    opening: str | None = None
    initial: str | None = None

    def add(self, turn: int | None, initial: str, kind: str) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.turn = turn
        if self.initial is None:
            self.opening = initial
        elif self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        if kind:
            setattr(self, kind, getattr(self, kind) + 1)

    def then(self, o: Facts) -> Facts:
        """These rows, and those of ``o`` behind them."""
        if o.initial is None:
            return self
        if self.initial is None:
            return o
        return Facts(
            self.low if self.low is not None else o.low, o.high if o.high is not None else self.high, self.first if self.first is not None else o.first,
            self.turns + o.turns - (self.turn is not None and self.turn == o.first), o.turn if o.turn is not None else self.turn,
            self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
            self.illegal + o.illegal + (self.initial + o.opening not in _LEGAL), self.opening, o.initial,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_SUMMARY = ", ".join(f"{c} bigint" for c in (*_COUNTS, "cost")) + ", audit string, repaired_sha256 string"
_TURNS = "place bigint, edit string, role string, text string"


def _schema(id_type, rest: str, name: str = "conv_id") -> StructType:
    return StructType([StructField(name, id_type), *_parse_datatype_string(rest).fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of sorted batches by their first column; a group is at most one short conversation, or one run."""
    key, held, first = None, [], True
    for r in _rows(batches):
        if not first and r[0] != key:
            yield key, held
            held = []
        key, first = r[0], False
        held.append(r)
    if not first:
        yield key, held


def _batched(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(held) >= at_once or size > 16 << 20:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def _solved(group: list[tuple]) -> tuple[Facts, bytes, list[tuple[str, str]]]:
    """Facts, codes and turns of a whole conversation from ``(conv, turn, role, text, present)``, in order."""
    facts, codes, seen, turns = Facts(), bytearray(), set(), []
    for _, turn, role, text, present in group:
        if not present:
            continue
        kind = fault(role, text, (role, text) in seen)
        seen.add((role, text))
        facts.add(turn, role[:1], kind)
        codes.append(_code(role[:1], kind == "truncated", kind in ("blank", "duplicate")))
        turns.append((role, text))
    return facts, bytes(codes), turns


def _short_audits(schema: pa.Schema):
    def rows(batches):
        for conv, group in _groups(batches):
            facts, codes, turns = _solved(group)
            left = distances(codes, GOALS)
            audit, _ = walk(codes, left, 0, True)
            text = "\n".join(f"{role}:{t}" for _, role, t in edited(audit, 0, turns))
            yield (conv, *(getattr(facts, c) for c in _COUNTS), left[0], audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())

    return lambda batches: _batched(rows(batches), schema)


def _short_turns(schema: pa.Schema):
    def rows(batches):
        for conv, group in _groups(batches):
            _, codes, turns = _solved(group)
            audit, _ = walk(codes, distances(codes, GOALS), 0, True)
            for i, (a, role, t) in enumerate(edited(audit, 0, turns)):
                yield conv, i, a, role, t

    return lambda batches: _batched(rows(batches), schema)


# --- long conversations, run by run ---


def _run_facts(schema: pa.Schema):
    """Of each run its facts, its codes, and the costs between its states."""

    def rows(batches):
        for part, group in _groups(batches):
            for conv, mine in _by_conversation(group):
                facts, codes = Facts(), bytearray()
                for _, _, turn, initial, kind in mine:
                    facts.add(turn, initial, kind)
                    codes.append(_code(initial, kind == "truncated", kind in ("blank", "duplicate")))
                codes = bytes(codes)
                cost = [[-1] * STATES for _ in range(STATES)]
                for e in range(STATES):
                    left = distances(codes, tuple(0 if q == e else None for q in range(STATES)))
                    for q in range(STATES):
                        cost[q][e] = left[q]
                yield conv, part, [x for r in cost for x in r], codes, list(facts.__dict__.values())[:9], [facts.opening, facts.initial]

    return lambda batches: _batched(rows(batches), schema, 1)


def _by_conversation(group: list[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    held: list[tuple] = []
    for r in group:
        if held and held[-1][1] != r[1]:
            yield held[0][1], held
            held = []
        held.append(r)
    if held:
        yield held[0][1], held


def _run_ends(schema: pa.Schema):
    """What is left to pay at the end of each run, backward over a conversation's runs; counts of the whole beside it."""

    def rows(batches):
        for conv, group in _groups(batches):
            whole, ends = Facts(), [None] * len(group)
            for _, _, _, numbers, letters in group:
                whole = whole.then(Facts(*numbers, *letters))
            after = list(GOALS)
            for q in (2, 1):  # at the very end turns may still be inserted: an assistant's, then a user's before it
                after[q] = INSERT + after[_NEXT[q]]
            for i in range(len(group) - 1, -1, -1):
                ends[i], cost = after, group[i][2]
                after = [min(cost[STATES * q + e] + x for e, x in enumerate(ends[i]) if cost[STATES * q + e] >= 0) for q in range(STATES)]
            for i, g in enumerate(group):
                yield conv, g[1], i, i == len(group) - 1, ends[i], after[0], [getattr(whole, c) for c in _COUNTS]

    return lambda batches: _batched(rows(batches), schema)


def _run_walks(schema: pa.Schema):
    """The edits of a run from each state that it may be entered in."""

    def rows(batches):
        for conv, part, n, last, ends, cost, counts, codes in _rows(batches):
            left = distances(codes, GOALS if last else tuple(ends))
            found = [walk(codes, left, q, last) for q in range(STATES)]
            yield conv, part, n, cost, counts, [f[0] for f in found], [f[1] for f in found]

    return lambda batches: _batched(rows(batches), schema, 1)


def _run_entries(schema: pa.Schema):
    """The state in which each run is entered, forward over a conversation's runs."""

    def rows(batches):
        state = 0
        for conv, part, n, exits in _rows(batches):
            state = 0 if n == 0 else state
            yield conv, part, state
            state = exits[state]

    return lambda batches: _batched(rows(batches), schema)


def _run_turns(schema: pa.Schema):
    """Turns that a run leaves: its edits come first, then its rows."""

    def rows(batches):
        audit, q, at, key, n = "", 0, 0, None, 0
        for part, conv, _, edits, state, role, text in _rows(batches):
            if edits is not None:
                if key is not None:
                    yield from ((*key, n + i, *t) for i, t in enumerate(edited(audit[at:], q, [])))
                audit, q, at, key, n = edits, state, 0, (conv, part), 0
                continue
            while audit[at] == "I":
                yield *key, n, "I", _ROLE[q], ""
                q, at, n = _NEXT[q], at + 1, n + 1
            for a, r, t in edited(audit[at], q, [(role, text)]):
                yield *key, n, a, r, t
                q, n = (_NEXT[q] if a == "R" else _READ[role[:1], q]), n + 1
            at += 1
        if key is not None:
            yield from ((*key, n + i, *t) for i, t in enumerate(edited(audit[at:], q, [])))

    return lambda batches: _batched(rows(batches), schema)


def _pieces(schema: pa.Schema):
    def rows(batches):
        key, held, size, n = None, [], 0, 0
        for conv, part, _, role, text in _rows(batches):
            if held and (key != (conv, part) or size > PIECE):
                yield *key, n, "\n".join(held)
                n = n + 1 if key == (conv, part) else 0
                held, size = [], 0
            key = conv, part
            held.append(f"{role}:{text}")
            size += len(held[-1])
        if held:
            yield *key, n, "\n".join(held)

    return lambda batches: _batched(rows(batches), schema, 8)


def _hashes(schema: pa.Schema):
    """SHA-256 over the pieces of each conversation, one piece in memory at a time."""

    def rows(batches):
        key, state = None, None
        for conv, _, _, text in _rows(batches):
            raw = text.encode("utf-8", "surrogatepass")
            if state is None or conv != key:
                if state is not None:
                    yield key, state.hexdigest()
                key, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(raw)
        if state is not None:
            yield key, state.hexdigest()

    return lambda batches: _batched(rows(batches), schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, kind, schema: StructType) -> DataFrame:
    return df.mapInArrow(kind(_arrow(schema)), schema)


@dataclass
class Repair:
    """``audits``: a row for each conversation. ``turns``: the repaired turns in order."""

    audits: DataFrame
    turns: DataFrame


def _cut_in_runs(scratch: Scratch, rows: DataFrame, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """Audits and turns of the long conversations in ``rows``."""
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "text"]
    parts = max(1, -(-rows.count() // run_rows))
    # equal rows are interchangeable; the number at the end lets even these lie in several runs
    dealt = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "any").sortWithinPartitions(*order, "any")
    mark = F.xxhash64("role", "text"), F.xxhash64(F.lit("second"), "role", "text")
    laid = dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("g"), mark[0].alias("h1"), mark[1].alias("h2"))
    laid = scratch.save(laid)
    again = laid.groupBy("conv_id", "h1", "h2").agg(F.min("g").alias("least"), F.count("*").alias("n")).filter("n > 1")
    again = scratch.save(again.select(F.col("conv_id").alias("c"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "least"))
    stripped = F.rtrim("text", F.lit(_SPACE))
    facts = laid.select("part", "conv_id", "g", "turn", "h1", "h2", F.substring("role", 1, 1).alias("initial"), F.right(stripped, F.lit(1)).alias("mark"))
    met = facts.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    what = F.when(F.col("mark") == "", "blank").when(F.col("g") > F.col("least"), "duplicate").when(~F.col("mark").isin(".", "!", "?"), "truncated").otherwise("")
    # runs of one number are one group for the reader below: (part, conv_id, turn, initial, fault), in order
    facts = met.select("part", "conv_id", "turn", "initial", what.alias("fault"), "g").repartition("part").sortWithinPartitions("part", "g").drop("g")
    runs = _mapped(facts, _run_facts, _schema(kind, "part int, cost array<bigint>, codes binary, numbers array<bigint>, letters array<string>"))
    runs = scratch.save(runs)
    by_run = lambda df, *more: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", *more)
    ends = by_run(runs.select("conv_id", "part", "cost", "numbers", "letters"))
    ends = _mapped(ends, _run_ends, _schema(kind, "part int, n bigint, last boolean, ends array<bigint>, cost bigint, counts array<bigint>"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    ends = scratch.save(ends)
    walks = ends.join(runs, same(ends, runs)).select(*(ends[c] for c in ends.columns), runs["codes"])
    walks = _mapped(walks, _run_walks, _schema(kind, "part int, n bigint, cost bigint, counts array<bigint>, audits array<string>, exits array<bigint>"))
    walks = scratch.save(walks)
    entries = _mapped(by_run(walks.select("conv_id", "part", "n", "exits")), _run_entries, _schema(kind, "part int, state int"))
    entries = scratch.save(entries)
    chosen = walks.join(entries, same(walks, entries)).select(walks["conv_id"], walks["part"], "n", "cost", "counts", F.get("audits", F.col("state")).alias("audit"), "state")
    chosen = scratch.save(chosen)
    turns = chosen.select("part", "conv_id", F.lit(-1).cast("bigint").alias("g"), F.col("audit").alias("edits"), "state", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = turns.unionByName(laid.select("part", "conv_id", "g", F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("state"), "role", "text"))
    turns = turns.repartition("part").sortWithinPartitions("part", "conv_id", "g")
    turns = scratch.save(_mapped(turns, _run_turns, _schema(kind, f"part int, {_TURNS}")))
    pieces = _mapped(turns.select("conv_id", "part", "place", "role", "text").repartition("part").sortWithinPartitions("part", "conv_id", "place"), _pieces, _schema(kind, "part int, n bigint, text string"))
    hashed = _mapped(by_run(pieces, "n"), _hashes, _schema(kind, "repaired_sha256 string")).withColumnRenamed("conv_id", "hashed_id")
    whole = chosen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "audit"))).alias("a"), F.first("cost").alias("cost"), F.first("counts").alias("counts"))
    whole = whole.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    audits = whole.select("conv_id", *(F.get("counts", F.lit(i)).alias(c) for i, c in enumerate(_COUNTS)), "cost", F.array_join(F.col("a.audit"), "").alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    sizes = turns.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.count("*").alias("m"))
    met = chosen.select("conv_id", "part", "n").join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    offset = met.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    turns = turns.join(offset, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", (F.col("place") + F.col("offset")).alias("place"), "edit", "role", "text")
    return audits, turns


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, run_rows: int = RUN_ROWS) -> Repair:
    """Conversations of ``rows(conv_id, turn, role, text)`` with the fewest edits that make their roles ``(s?(ua)+)?``.

    ``audits`` has for each conversation ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``; ``turns`` has ``conv_id,
    place, edit, role, text``. A row that is blank or a duplicate must be deleted;
    any other may be kept if its role's initial fits, or be given the fitting one
    of user and assistant; turns without text may be inserted anywhere. Kept rows
    that end without a mark of ``.!?`` cost extra. Of equally cheap edits the
    least audit counts.

    A column ``present``, if there is one, marks rows by false that only name
    their conversation. Rows are in order of turn (nulls first), role, text; so
    repeated rows stand together and all but the first are duplicates, and ties
    do not depend on the order of the table. Null roles and texts count as one
    space. A null conv_id is a conversation of its own. A role without an initial
    can be reroled or deleted, not kept. No rows: no conversations. Columns of
    other names are ignored.

    Conversations of more than ``long_rows`` rows or ``long_bytes`` of text are
    cut into runs of about ``run_rows`` rows, in order, and searched run by run.
    Only their hash is computed in one task, as SHA-256 must be, piece by piece.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.coalesce(F.col("present").cast("boolean"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    given = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), present.alias("present"))
    sizes = given.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    scratch = Scratch(spark, "conversations")
    big = scratch.save(sizes.filter((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("big_id")))
    long = scratch.count(big) > 0
    is_big = F.col("conv_id").eqNullSafe(F.col("big_id"))
    short = given.join(big, is_big, "left_anti") if long else given
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    audits = _mapped(short, _short_audits, _schema(kind, _SUMMARY))
    turns = _mapped(short, _short_turns, _schema(kind, _TURNS))
    if long:
        mine = given.join(big, is_big, "left_semi")
        more, others = _cut_in_runs(scratch, mine.filter("present").drop("present"), run_rows)
        named = big.join(more.select(F.col("conv_id").alias("c")), F.col("big_id").eqNullSafe(F.col("c")), "left_anti")
        zeros = [F.lit(0).cast("bigint").alias(c) for c in (*_COUNTS, "cost")]
        empty = named.select(F.col("big_id").alias("conv_id"), *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
        audits, turns = audits.unionByName(more).unionByName(empty), turns.unionByName(others)
    return Repair(audits, turns)


def damage(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with faults put in by a hash of ``conv_id:turn``; dropped rows stay with ``present`` false.

    Nulls count as one space. Of twenty remainders 0 drops a row, 1 empties its
    text, 2 takes the marks ``.!?`` out, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(space("role"))
    out = rows.select("conv_id", "turn", "role", "text", draw.alias("draw")).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), "draw")
    copies = F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))
    return out.select("conv_id", "turn", "role", "text", "present", F.explode(copies).alias("copy")).drop("copy")
