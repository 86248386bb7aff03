"""Repair of conversations: the cheapest edits that make the roles of a conversation alternate, by a Viterbi recursion in parallel.

Legal are no turns, or turns of user and assistant by turns, the assistant's last, after a system's turn at most: ``(s?(ua)+)?`` of the
roles' initials. A turn is kept (0), gets another role (3) or goes (4); blank and repeated ones have to go; turns without text come in (3);
a turn that ends in the middle of a sentence costs 3 more unless it goes.

Rows are sorted over range partitions and cut into chunks of bounded size, so that a conversation may have any share of them. All chunks
run backward at once from a speculative vector of costs. Fix-up passes compare what a chunk started from with what its right neighbour
has now; where they differ by more than a constant it runs again, only as far as its vectors differ from the old ones by more than that.
Vectors are stored less their least cost, which is stored beside them; adding these up along a conversation stitches the costs. Then the
edits are traced from each of the four states that a chunk can begin in, and passes over the chunks' ends settle which of them holds.
A pass is a join of neighbours, by the chunk's number, which is in one row: no key is hot. Passes end when nothing changes; each settles at least
a further chunk of a conversation, nearly always all of them.

A conversation's digest is one pass over its repaired text by definition: its chunks stream through one task, which holds one at a time.

Null role and text: one space. A null conv_id is a conversation, a null turn comes first. Rows of one turn are in order of role and of
the text's MD5; repeated rows are repeated turns. A very long text is a chunk of its own. A conversation without turns has an empty audit. Empty table: no rows.
Further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: A chunk has at most so many turns, and no further one once it has so many characters.
ROWS, CHARS = 1024, 1 << 15
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing yet; after the system's, the user's, the assistant's turn. Where a turn leads from each, and one that is added or gets another role.
FOLLOWS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Costs after the last turn: a turn that is added costs 3, until the assistant was last or there is nothing.
END = (0, 6, 3, 0)
RUN = "n long, conv_id long, marks string, right array<int>, left array<int>, costs binary"


@lru_cache(None)
def edits(state: int, initial: str, fault: str) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what may happen to a turn, letters in order. fault: ``b`` blank, ``d`` duplicate, ``t`` truncated or ``-``."""
    out = [("D", 4, state)]
    if fault not in "bd":
        more, to = 3 * (fault == "t"), FOLLOWS.get(initial, (None,) * 4)[state]
        out += [("K", more, to)] if to is not None else []
        out.append(("R", 3 + more, NEXT[state]))
    return tuple(out)


@lru_cache(None)
def before(after: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], int]:
    """The costs of what follows in each state before a turn, less their least, and this; after: those behind the turn."""
    costs = [min(c + after[to] for _, c, to in edits(q, initial, fault)) for q in range(4)]
    for _ in range(3):
        costs = [min(c, 3 + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(c - min(costs) for c in costs), min(costs)


@lru_cache(None)
def traced(state: int, here: tuple[int, ...], least: int, after: tuple[int, ...], initial: str, fault: str) -> tuple[str, int]:
    """The least letters among the cheapest edits up to and with a turn, and the state behind it."""
    letters = ""
    while True:
        ways = {x: to for x, c, to in edits(state, initial, fault) if here[state] + least == c + after[to]}
        if here[state] == 3 + here[NEXT[state]]:
            ways["I"] = NEXT[state]
        best = min(ways)
        letters, state = letters + best, ways[best]
        if best != "I":
            return letters, state


def closing(state: int) -> str:
    """What is added after the last turn."""
    return "" if state in (0, 3) else "I" + closing(NEXT[state])


def backward(marks: str, right: tuple[int, ...], old: bytes | None = None) -> tuple[tuple[int, ...], bytes]:
    """The vector before the first turn, and 5 bytes a turn: its vector and least cost. old: of a run from another vector, kept from where both agree."""
    costs, vector = bytearray(old or bytes(5 * (len(marks) // 2))), right
    for i in range(len(marks) - 2, -1, -2):
        vector, least = before(vector, marks[i], marks[i + 1])
        at = 5 * (i // 2)
        new = bytes((*vector, least))
        if old and costs[at : at + 4] == new[:4]:
            costs[at + 4] = least
            return tuple(costs[:4]), bytes(costs)
        costs[at : at + 5] = new
    return vector, bytes(costs)


def forward(marks: str, right: tuple[int, ...], costs: bytes, state: int) -> tuple[str, int]:
    """The audit of a chunk that begins in a state, and the state behind it."""
    out = []
    for i in range(0, len(marks), 2):
        at = 5 * (i // 2)
        after = tuple(costs[at + 5 : at + 9]) if at + 5 < len(costs) else right
        letters, state = traced(state, tuple(costs[at : at + 4]), costs[at + 4], after, marks[i], marks[i + 1])
        out.append(letters)
    return "".join(out), state


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "?"


_CHUNK = "conv_id long, turns array<long>, roles array<string>, texts array<string>, keys array<binary>, marks string"


def _chunk_function(rows: int, chars: int):
    """Sorted turns to chunks: a conversation begins a new one. marks: two characters a turn, its role's initial and fault."""

    def chunk(conv: int | None, own: list[tuple]) -> pa.RecordBatch:
        marks, keys = "", []
        for _, role, text in own:
            said = text.rstrip(BLANKS)
            marks += _initial(role) + ("b" if not said else "-" if said[-1] in ".!?" else "t")
            keys.append(hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest())
        turns, roles, texts = (list(c) for c in zip(*own, strict=True)) if own else ([], [], [])
        strings = pa.list_(pa.string())
        columns = [pa.array([conv], pa.int64()), pa.array([turns], pa.list_(pa.int64())), pa.array([roles], strings), pa.array([texts], strings), pa.array([keys], pa.list_(pa.binary())), pa.array([marks])]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turns", "roles", "texts", "keys", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, size, any_rows = None, [], 0, False
        for batch in batches:
            for c, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if any_rows and (c != conv or len(own) >= rows or size >= chars):
                    yield chunk(conv, own)
                    own, size = [], 0
                conv, any_rows = c, True
                if not gone:
                    own.append((turn, role, text))
                    size += len(text)
        if any_rows:
            yield chunk(conv, own)

    return run


def chunks(turns: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """``n`` and the columns of a chunk, numbered in order without gaps. turns: ``conv_id, turn, role, text, gone``; a conversation whose turns are all gone has an empty chunk."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.md5("text"), F.monotonically_increasing_id()]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order[:4])
    cut = written(placed.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_chunk_function(rows, chars), _CHUNK).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = cut.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    starts, n = [], 0
    for r in sizes:
        starts.append((r["part"], n - (r["part"] << 33)))
        n += r["count"]
    first = turns.sparkSession.createDataFrame(starts, "part long, start long")
    return cut.withColumn("part", part.cast("long")).join(F.broadcast(first), "part").withColumn("n", F.col("place") + F.col("start")).drop("part", "place", "start")


def _marked(cut: DataFrame) -> DataFrame:
    """``n, conv_id, marks``: the marks with repeated turns; the first of equal turns is found by partial minima, so that copies don't meet."""
    keys = cut.select("n", "conv_id", F.posexplode("keys").alias("i", "key"))
    firsts = keys.groupBy("conv_id", "key").agg(F.min(F.struct("n", "i")).alias("x"))
    own = firsts.groupBy("x.n").agg(F.collect_list("x.i").alias("firsts"))
    fault = lambda i: F.substring("marks", 2 * i + 2, F.lit(1))
    repeated = lambda i: (fault(i) != "b") & ~F.coalesce(F.array_contains("firsts", i), F.lit(False))
    mark = lambda i: F.concat(F.substring("marks", 2 * i + 1, F.lit(1)), F.when(repeated(i), "d").otherwise(fault(i)))
    places = F.when(F.length("marks") > 0, F.sequence(F.lit(0), F.floor(F.length("marks") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return cut.select("n", "conv_id", "marks").join(own, "n", "left").select("n", "conv_id", F.array_join(F.transform(places, mark), "").alias("marks"))


def _run_function(again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pydict()
            old = own["costs"] if again else [None] * batch.num_rows
            done = [backward(m, tuple(r), o) for m, r, o in zip(own["marks"], own["right"], old, strict=True)]
            lefts = pa.array([list(left) for left, _ in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lefts, pa.array([c for _, c in done], pa.binary())], names=["n", "conv_id", "marks", "right", "left", "costs"])

    return run


def _neighbours(state: DataFrame, step: int, value: Column, name: str) -> DataFrame:
    """``n, conv`` and a value of the chunk that comes step further on, for the chunk before or behind it."""
    return state.select((F.col("n") - step).alias("n"), F.struct("conv_id").alias("conv"), value.alias(name))


def backward_costs(marked: DataFrame) -> DataFrame:
    """RUN: every chunk's vectors, right up to a constant, by fix-up passes; ``last``: whether its conversation ends with it."""
    state = written(marked.withColumn("right", F.array(*map(F.lit, END))).mapInArrow(_run_function(False), RUN))
    while True:
        joined = state.join(_neighbours(state, 1, F.col("left"), "given"), "n", "left")
        behind = F.coalesce(F.col("conv.conv_id").eqNullSafe(F.col("conv_id")) & F.col("conv").isNotNull(), F.lit(False))
        due = joined.where(behind & (F.col("given") != F.col("right")))
        new = written(due.select("n", "conv_id", "marks", F.col("given").alias("right"), "costs").mapInArrow(_run_function(True), RUN))
        if new.isEmpty():
            return joined.select(*state.columns, (~behind).alias("last"))
        state = written(state.join(new.select("n"), "n", "left_anti").unionByName(new))


_TRACED = "n long, conv_id long, marks string, cost long, audits array<string>, ends array<int>"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.to_pydict()
        audits, ends, cost = [], [], []
        for marks, right, costs, last in zip(own["marks"], own["right"], own["costs"], own["last"], strict=True):
            ways = [forward(marks, tuple(right), costs, q) for q in range(4)]
            audits.append([letters + (closing(q) if last else "") for letters, q in ways])
            ends.append([q for _, q in ways])
            cost.append(sum(costs[4::5]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cost, pa.int64()), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["n", "conv_id", "marks", "cost", "audits", "ends"])


def audits(costs: DataFrame) -> DataFrame:
    """``n, marks, cost, audit, entry``: a chunk's edits from the state that it begins in, which the chunk before it ends in."""
    ways = written(costs.select("n", "conv_id", "marks", "right", "costs", "last").mapInArrow(_trace, _TRACED))
    state = ways.select("n", "conv_id", "ends", F.lit(0).alias("entry"))
    while True:
        given = _neighbours(state, -1, F.get("ends", F.col("entry")), "given")
        behind = F.col("conv").isNotNull() & F.col("conv.conv_id").eqNullSafe(F.col("conv_id"))
        moved = state.join(given, "n", "left").withColumn("new", F.when(behind, F.col("given")).otherwise(0))
        moved = written(moved.select("n", "conv_id", "ends", F.col("new").alias("entry"), (F.col("new") != F.col("entry")).alias("changed")))
        state = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return ways.join(state.select("n", "entry"), "n").select("n", "marks", "cost", F.get("audits", F.col("entry")).alias("audit"), "entry")


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _told(parts: list[str], roles: list[str], texts: list[str], audit: str, state: int) -> None:
    """Adds the repaired turns of a chunk."""
    i = 0
    for letter in audit:
        if letter == "I":
            parts.append(f"{ROLE[state]}:")
            state = NEXT[state]
            continue
        if letter == "K":
            parts.append(f"{roles[i]}:{texts[i]}")
            state = FOLLOWS[_initial(roles[i])][state]
        elif letter == "R":
            parts.append(f"{ROLE[state]}:{texts[i]}")
            state = NEXT[state]
        i += 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to conversations, one held at a time."""
    out, now = [], None

    def closed() -> dict:
        low, high, distinct = now.pop("turns")
        now["gaps"] = 0 if low is None else high - low + 1 - distinct
        now["audit"] = "".join(now["audit"])
        now["repaired_sha256"] = now.pop("digest").hexdigest()
        now.pop("initial"), now.pop("any")
        return now

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        names = [f.split()[0] for f in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names], names=names)

    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    out.append(closed())
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
                now = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "digest": hashlib.sha256(), "initial": None, "turns": (None, None, 0), "any": False}
            low, high, distinct = now["turns"]
            for turn in r["turns"]:
                if turn is not None:
                    low, distinct = turn if low is None else low, distinct + (turn != high)
                    high = turn
            now["turns"] = low, high, distinct
            for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                now[name] += r["marks"][1::2].count(letter)
            # Initials of roles, those of others as one sign that is never legal beside another.
            initials = (now["initial"] or "") + r["marks"][::2]
            now["illegal"] += sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
            now["initial"] = initials[-1:]
            now["cost"] += r["cost"]
            now["audit"].append(r["audit"])
            parts: list[str] = []
            _told(parts, r["roles"], r["texts"], r["audit"], r["entry"])
            for part in parts:
                now["digest"].update((b"\n" if now["any"] else b"") + part.encode())
                now["any"] = True
    if now is not None:
        out.append(closed())
    if out:
        yield batch_of(out)


def repair(turns: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """A row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    turns: ``conv_id, turn, role, text`` and ``gone``: whether a turn is left out, which leaves its conversation in the result.
    The audit has the initials of the cheapest edits (keep, rerole, delete, insert), of several the first in order of letters.
    """
    cut = chunks(turns, rows, chars)
    costs = backward_costs(_marked(cut))
    # What precedes a conversation's first turn is settled in the first state, whose vector has its own cost.
    own = audits(costs).join(costs.select("n", F.get("left", F.lit(0)).alias("start")), "n")
    whole = cut.select("n", "conv_id", "turns", "roles", "texts").join(own, "n")
    previous = _neighbours(cut, -1, F.lit(True), "same")
    first = ~F.coalesce(F.col("conv.conv_id").eqNullSafe(F.col("conv_id")) & F.col("same"), F.lit(False))
    whole = whole.join(previous, "n", "left").withColumn("cost", F.col("cost") + F.when(first, F.col("start")).otherwise(0))
    ordered = whole.select("n", "conv_id", "turns", "roles", "texts", "marks", "cost", "audit", "entry").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "n")
    return ordered.mapInArrow(_summed, _OUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults by the CRC-32 of ``conv_id:turn`` modulo 20: 0 is gone, 1 has no text, 2 has no ``.!?``, 3 comes twice, 4 is the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies).drop("copy")
