"""The cheapest edits that make conversations alternate: an optional system turn, then user and assistant in turn.

Each row is kept, given the other role or deleted, and empty turns may be inserted anywhere. The states of a Viterbi search are what
came last: nothing, system, user or assistant. Every state's survivor is a leaf of a tree of back pointers whose nodes count their references; once
all survivors share an ancestor, the edits up to it are final and go out, so that memory holds only what is
unresolved. Inserted turns belong to the row after them, so every survivor's edits end with those of the same row, none is the beginning of another, and
their order never changes by what follows: it is kept as a rank, which compares whole unresolved suffixes in one step.

Rows are range-partitioned by conversation and turn, so that a long conversation spreads over many tasks. Where one is cut, its parts are summed
up: for every state before a part and every state after it, the least cost and the order of the cheapest edits. The
driver puts these summaries together, two for each partition, and only then are the parts of such conversations edited.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, staged

#: What came last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted turn or a new role, and after a kept one by its initial.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of edits, and of every truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults by number; a row with one of the first two must go.
FAULTS = {"blank": 1, "duplicate": 2, "truncated": 3}
_FAR = 1 << 60
#: Whatever follows, each state can do as any other would, for so much more at most (after a system turn as if nothing had come: two insertions at the
#: end, and deleting a later system turn), so survivors that cost more than the cheapest by more than this go.
_SLACK = 2 * INSERT + DELETE
_SPACE = " \t\n\x0b\x0c\r"


@lru_cache(1 << 16)
def advance(cost: tuple, rank: tuple, initial: str, fault: int) -> tuple[tuple, int, tuple, tuple]:
    """One row: of each state after it the state before and the edits (None: out of reach), the least cost, the costs above it and the ranks."""
    best: list[tuple | None] = [None] * 4
    for before in range(4):
        state, so_far, inserted = before, cost[before], ""
        while so_far < _FAR and len(inserted) < 3:  # a third insertion would only come back to a state that costs less
            edits = [("D", state, DELETE)]
            if fault not in (FAULTS["blank"], FAULTS["duplicate"]):
                more = TRUNCATED if fault == FAULTS["truncated"] else 0
                edits.append(("R", NEXT[state], REROLE + more))
                if initial in LEGAL[state]:
                    edits.append(("K", LEGAL[state][initial], KEEP + more))
            for letter, after, price in edits:
                found = (so_far + price, rank[before], inserted + letter, before)
                if best[after] is None or found < best[after]:
                    best[after] = found
            state, so_far, inserted = NEXT[state], so_far + INSERT, inserted + "I"
    least = min(b[0] for b in best if b)
    best = [b if b and b[0] <= least + _SLACK else None for b in best]
    order = sorted((b[1], b[2], state) for state, b in enumerate(best) if b)
    place = {state: k for k, (_, _, state) in enumerate(order)}
    return tuple((b[3], b[2]) if b else None for b in best), least, tuple(b[0] - least if b else _FAR for b in best), tuple(place.get(s, 4) for s in range(4))


def ending(cost: tuple, rank: tuple) -> tuple[int, int]:
    """The state to end in and how many turns to insert after it."""
    missing = (0, 2, 1, 0)
    state = min((s for s in range(4) if cost[s] < _FAR), key=lambda s: (cost[s] + INSERT * missing[s], rank[s]))
    return state, missing[state]


class Survivors:
    """The survivors of all states, from one state on. A node is [parent, edits, state, references, sum of its children's numbers]."""

    def __init__(self, entry: int = NOTHING):
        self.total, self.cost, self.rank = 0, tuple(0 if s == entry else _FAR for s in range(4)), tuple(0 if s == entry else 4 for s in range(4))
        self.nodes, self.root, self.made = {0: [None, "", entry, 1, 0]}, 0, 0
        self.leaf: list[int | None] = [0 if s == entry else None for s in range(4)]

    def _release(self, number: int) -> None:
        node = self.nodes[number]
        node[3] -= 1
        while node[3] == 0:
            del self.nodes[number]
            parent = self.nodes[node[0]]
            parent[4] -= number
            parent[3] -= 1
            number, node = node[0], parent

    def step(self, initial: str, fault: int) -> list[str]:
        """The edits of earlier rows, and of this one, that have become final: a string for each row."""
        moves, least, self.cost, self.rank = advance(self.cost, self.rank, initial, fault)
        self.total += least
        before, self.leaf = self.leaf, [None] * 4
        for state, move in enumerate(moves):
            if move:
                self.made += 1
                parent = before[move[0]]
                self.nodes[self.made] = [parent, move[1], state, 1, 0]
                self.nodes[parent][3] += 1
                self.nodes[parent][4] += self.made
                self.leaf[state] = self.made
        for number in before:
            if number is not None:
                self._release(number)
        final = []
        while (node := self.nodes[self.root])[3] == 1 and node[4]:  # one child and no survivor
            del self.nodes[self.root]
            self.root = node[4]
            final.append(self.nodes[self.root][1])
        return final

    def rest(self, state: int) -> list[str]:
        """The edits, not yet given out, of the survivor that ends in a state."""
        out, number = [], self.leaf[state]
        while number != self.root:
            out.append(self.nodes[number][1])
            number = self.nodes[number][0]
        return out[::-1]

    @property
    def state(self) -> int:
        """The state after the edits given out."""
        return self.nodes[self.root][2]

    def summary(self) -> tuple[list, list]:
        return [self.total + c if c < _FAR else None for c in self.cost], list(self.rank)


def joined(summaries: list[tuple[int, int, object, list]]) -> list[tuple[int, int, int, int, int]]:
    """Parts of conversations in order, as (partition, which, conversation, summary by entry): for each its entry, exit and turns inserted at its end."""
    out, at = [], 0
    while at < len(summaries):
        upto = at + 1
        while upto < len(summaries) and summaries[upto][2] == summaries[at][2]:
            upto += 1
        cost, rank, back = (0, _FAR, _FAR, _FAR), (0, 4, 4, 4), []
        for _, _, _, by_entry in summaries[at:upto]:
            best: list[tuple | None] = [None] * 4
            for before in range(4):
                costs, ranks = by_entry[before] or ([None] * 4, None)
                for after in range(4):
                    if cost[before] < _FAR and costs[after] is not None:
                        found = (cost[before] + costs[after], rank[before], ranks[after], before)
                        if best[after] is None or found < best[after]:
                            best[after] = found
            order = {s: k for k, (_, _, s) in enumerate(sorted((b[1], b[2], s) for s, b in enumerate(best) if b))}
            cost, rank = tuple(b[0] if b else _FAR for b in best), tuple(order.get(s, 4) for s in range(4))
            back.append([b and b[3] for b in best])
        state, inserted = ending(cost, rank)
        for k in range(upto - 1, at - 1, -1):
            entry = back[k - at][state]
            out.append((summaries[k][0], summaries[k][1], entry, state, inserted))
            state, inserted = entry, 0
        at = upto
    return out


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; role and text not null) with text_key (the text's SHA-256), initial and fault (a number of FAULTS; 0: none; the first of them that a row has).

    A row is blank if it has no character but blanks, a duplicate if an earlier row of its conversation has its role and text, truncated if its last character that is no
    blank is none of . ! ?. Repeats are found by their hash: of each, the first place of all is put together before rows meet it.
    """
    key = F.sha2(F.concat_ws("|", F.coalesce(F.concat(F.lit("is "), F.col("conv_id").cast("string")), F.lit("none")), F.length("role").cast("string"), "role", "text_key"), 256)
    told = rows.withColumn("text_key", F.sha2("text", 256))
    told = staged(told.withColumn("repeat_key", key).withColumn("row", F.monotonically_increasing_id()), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row"))
    repeated = told.groupBy("repeat_key").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("repeat_key", F.col("first.row").alias("first_row"))
    told = join_hot(told, staged(repeated, "repeats"), ["repeat_key"], "left")
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = F.when(last == "", FAULTS["blank"]).when(F.col("first_row") != F.col("row"), FAULTS["duplicate"]).when(~last.isin(".", "!", "?"), FAULTS["truncated"]).otherwise(0)
    return told.select("conv_id", "turn", "role", "text", "text_key", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


_DONE, _OPEN, _SUMMARY = 0, 1, 2
_COLUMNS = ["kind", "conv_id", "part", "which", "place", "turn", "initial", "fault", "edit", "cost", "role", "text", "summary"]


def _schema(rows: DataFrame) -> T.StructType:
    """The columns of edits and of what is still open, the conversation's id and the turn as they are in rows."""
    kinds = {"conv_id": rows.schema["conv_id"].dataType, "turn": rows.schema["turn"].dataType, "kind": T.IntegerType(), "which": T.IntegerType(), "fault": T.IntegerType(), "cost": T.IntegerType(), "part": T.LongType(), "place": T.LongType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in _COLUMNS])


class _Out:
    """Rows on their way out, some thousand at a time."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0

    def add(self, **row) -> None:
        self.rows.append(tuple(row.get(c) for c in _COLUMNS))
        self.size += len(row.get("text") or "")

    def full(self) -> bool:
        return len(self.rows) >= 4096 or self.size > 1 << 22

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class _Editor:
    """Writes the edits of one conversation, or part of one, as they become final."""

    def __init__(self, out: _Out, conv_id, part: int, entry: int):
        self.out, self.conv_id, self.part = out, conv_id, part
        self.survivors, self.state, self.waiting, self.place = Survivors(entry), entry, deque(), 0

    def turn(self, row: dict) -> None:
        self.waiting.append(row)
        for edits in self.survivors.step(row["initial"], row["fault"]):
            self.write(edits)

    def insert(self, place: int) -> None:
        self.state = NEXT[self.state]
        self.out.add(kind=_DONE, conv_id=self.conv_id, part=self.part, place=place, edit="I", cost=INSERT, role=ROLE[self.state], text="")

    def write(self, edits: str) -> None:
        row = self.waiting.popleft()
        for k in range(len(edits) - 1):
            self.insert(row["place"] - 3 + k)
        letter, self.place = edits[-1], row["place"]
        told = {"kind": _DONE, "conv_id": self.conv_id, "part": self.part, "place": self.place, "turn": row["turn"], "initial": row["initial"], "fault": row["fault"], "edit": letter}
        if letter == "D":
            self.out.add(**told, cost=DELETE)
            return
        self.state = LEGAL[self.state][row["initial"]] if letter == "K" else NEXT[self.state]
        cost = (KEEP if letter == "K" else REROLE) + (TRUNCATED if row["fault"] == FAULTS["truncated"] else 0)
        self.out.add(**told, cost=cost, role=row["role"] if letter == "K" else ROLE[self.state], text=row["text"])

    def end(self, state: int, inserted: int) -> None:
        for edits in self.survivors.rest(state):
            self.write(edits)
        for k in range(inserted):
            self.insert(self.place + 1 + k)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _edit_partitions(schema: T.StructType):
    """mapInArrow function over rows in order. Conversations that lie whole in a partition are edited. The rows of the first one, which may have begun before, go out
    as they are, and so do those of the last one whose edits are not yet final; of each of the two a summary goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, editor, first, now, begun, place = _Out(schema), None, None, None, False, 0
        part = 0

        def left_open(row: dict, which: int) -> None:
            out.add(kind=_OPEN, conv_id=now, part=part, which=which, **{c: row[c] for c in ("place", "turn", "initial", "fault", "role", "text")})

        def summary(which: int, by_entry: list, state: int | None) -> None:
            out.add(kind=_SUMMARY, conv_id=now, part=part, which=which, summary=json.dumps([by_entry, state]))

        for row in _turns(batches):
            if not begun or row["conv_id"] != now:
                if first:
                    summary(0, [s.summary() for s in first], None)
                    first = None
                if editor:
                    editor.end(*ending(editor.survivors.cost, editor.survivors.rank))
                now, part = row["conv_id"], row["part"]
                if begun:
                    editor = _Editor(out, now, part, NOTHING)
                else:
                    first, begun = [Survivors(s) for s in range(4)], True
            place += 4
            row["place"] = part << 40 | place
            if editor:
                editor.turn(row)
            else:
                for s in first:
                    s.step(row["initial"], row["fault"])
                left_open(row, 0)
            if out.full():
                yield from out.take()
        if first:
            summary(0, [s.summary() for s in first], None)
        if editor:
            summary(1, [editor.survivors.summary(), None, None, None], editor.survivors.state)
            for row in editor.waiting:
                left_open(row, 1)
        yield from out.take()

    return run


def _edit_open(schema: T.StructType):
    """mapInArrow function over open rows in order, each with the entry, exit and number of turns inserted at the end of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, editor, now = _Out(schema), None, None
        for row in _turns(batches):
            if now is None or (row["part"], row["which"]) != now[:2]:
                if editor:
                    editor.end(*now[2:])
                now = (row["part"], row["which"], row["exit"], row["inserted"])
                editor = _Editor(out, row["conv_id"], row["part"], row["entry"])
            editor.turn(row)
            if out.full():
                yield from out.take()
        if editor:
            editor.end(*now[2:])
        yield from out.take()

    return run


def repair(rows: DataFrame) -> DataFrame:
    """The edits of conversations given as rows (conv_id, turn, role, text): one row for each row and each inserted turn.

    conv_id, part and place (whose order is that of the repaired conversation), turn, initial (of the role as it was), fault (a number of FAULTS, 0: none), edit
    (K keep, R give the other role, D delete, I insert), cost, and role and text as they are afterwards (null where deleted). Of the cheapest edits of a conversation those whose
    letters come first in ASCII are taken. Kept roles read as initials (s?(ua)+)?, so a conversation may lose all rows.
    Rows stand by turn, nulls first, then by role, then by the text's SHA-256; equal rows are duplicates of one another. A null role or text
    counts as one blank; a null conv_id is a conversation of its own. Other columns are not looked at. Memory holds the rows
    whose edits are not final, which in conversations with few faults are few.
    """
    spark = rows.sparkSession
    own = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    told = staged(faults(own), "turns")
    # the first of equal rows is no duplicate, so it comes before the others
    order = ["conv_id", "turn", "role", "text_key", F.col("fault") == FAULTS["duplicate"]]
    ordered = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    schema = _schema(rows)
    found = staged(ordered.drop("text_key").mapInArrow(_edit_partitions(schema), schema), "edits")
    # two for each partition at most
    parts = found.where(F.col("kind") == _SUMMARY).select("part", "which", "conv_id", "summary").collect()
    parts = sorted(((r.part, r.which, r.conv_id, *json.loads(r.summary)) for r in parts), key=lambda x: x[:2])
    known = {(p, w): state for p, w, _, _, state in parts}
    plan = [(p, w, entry if known[p, w] is None else known[p, w], state, inserted) for p, w, entry, state, inserted in joined([x[:4] for x in parts])]
    plan = spark.createDataFrame(plan, "part long, which int, entry int, exit int, inserted int")
    late = found.where(F.col("kind") == _OPEN).join(F.broadcast(plan), ["part", "which"])
    late = late.repartition("part", "which").sortWithinPartitions("part", "which", "place").mapInArrow(_edit_open(schema), schema)
    return found.where(F.col("kind") == _DONE).unionByName(late).select("conv_id", "part", "place", "turn", "initial", "fault", "edit", "cost", "role", "text")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults by the CRC-32 of conv_id:turn modulo 20 (a null there is one blank, and so is a null role or text).

    0: the row is dropped; 1: its text is emptied; 2: its text loses . ! and ?; 3: it is there twice; 4: its role is user.
    """
    one = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(one["conv_id"], F.lit(":"), one["turn"])) % 20
    told = rows.select("conv_id", "turn", one["role"].alias("role"), one["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    told = told.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return told.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "time")


#: What is known of a stretch of edits: counts, the first and last initial and turn, and the repaired lines.
_STRETCH = ["part", "place", "gap_turns", "first_turn", "last_turn", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "n_lines", "lines"]
_STRETCH_SQL = ["long", "long", "long", "long", "long", "string", "string", "long", "long", "long", "long", "long", "string", "long", "binary"]
_LEGAL = {"su", "ua", "au"}


def _stretches(most: int = 1 << 20):
    """mapInArrow function over edits: consecutive ones of a conversation as one row, of about so many bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, size = [], None, 0

        def close() -> None:
            nonlocal now
            if now:
                done.append((now["conv_id"], *(now[c] for c in _STRETCH[:-3]), "".join(now["audit"]), len(now["lines"]), "\n".join(now["lines"]).encode()))
            now = None

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv_id", *_STRETCH])
            done.clear()
            size = 0

        types = None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, *({"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in _STRETCH_SQL)]
            for row in _turns(iter([batch])):
                # rows of a place, and places, follow one another within a part
                if now is None or row["conv_id"] != now["conv_id"] or row["part"] != now["part"] or not 0 < row["place"] - now["end"] < 8 or now["size"] > most:
                    close()
                    now = dict.fromkeys(_STRETCH, 0) | {"conv_id": row["conv_id"], "part": row["part"], "place": row["place"], "size": 0, "audit": [], "lines": []} | dict.fromkeys(("first_turn", "last_turn", "first_initial", "last_initial"))
                now["end"] = row["place"]
                now["audit"].append(row["edit"])
                now["cost"] += row["cost"]
                if row["edit"] != "D":
                    now["lines"].append(f"{row['role']}:{row['text']}")
                    now["size"] += len(now["lines"][-1])
                    size += len(now["lines"][-1])
                if row["edit"] != "I":
                    if row["fault"]:
                        now[_FAULT[row["fault"]]] += 1
                    now["illegal"] += now["last_initial"] is not None and now["last_initial"] + row["initial"] not in _LEGAL
                    now["last_initial"] = row["initial"]
                    if now["first_initial"] is None:
                        now["first_initial"] = row["initial"]
                    if row["turn"] is not None and row["turn"] != now["last_turn"]:
                        now["gap_turns"] += 1
                        now["last_turn"] = row["turn"]
                        if now["first_turn"] is None:
                            now["first_turn"] = row["turn"]
                if len(done) >= 4096 or size > 1 << 23:
                    yield from out()
        close()
        yield from out()

    return run


_FAULT = {n: name for name, n in FAULTS.items()}
_DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over stretches in order: one row for each conversation."""
    done, now, kind = [], None, None

    def close() -> None:
        if now:
            gaps = now["last_turn"] - now["first_turn"] + 1 - now["gap_turns"] if now["first_turn"] is not None else 0
            done.append((now["conv_id"], gaps, *(now[c] for c in _DIGEST[1:]), "".join(now["audit"]), now["hash"].hexdigest()))

    def out() -> Iterator[pa.RecordBatch]:
        if done:
            types = [kind, *[pa.int64()] * len(_DIGEST), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv_id", *_DIGEST, "audit", "repaired_sha256"])
        done.clear()

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    close()
                    now = {"conv_id": row["conv_id"], "hash": sha256(), "audit": [], "n_lines": 0} | dict.fromkeys(_DIGEST, 0) | {"gap_turns": 0} | dict.fromkeys(("first_turn", "last_turn", "last_initial"))
                for c in _DIGEST[1:]:
                    now[c] += row[c]
                if row["first_initial"] is not None:
                    now["illegal"] += now["last_initial"] is not None and now["last_initial"] + row["first_initial"] not in _LEGAL
                    now["last_initial"] = row["last_initial"]
                if row["first_turn"] is not None:
                    now["gap_turns"] += row["gap_turns"] - (row["first_turn"] == now["last_turn"])
                    now["last_turn"] = row["last_turn"]
                    if now["first_turn"] is None:
                        now["first_turn"] = row["first_turn"]
                if row["n_lines"]:
                    now["hash"].update((b"\n" if now["n_lines"] else b"") + row["lines"])
                    now["n_lines"] += row["n_lines"]
                now["audit"].append(row["audit"])
        yield from out()
    close()
    yield from out()


def digests(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id in ids, from the edits of repair(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turns missing between the least and the largest, nulls aside; illegal: neighbours, before the repair, whose initials are not su, ua or au; audit: the letters of the edits; the hash is that of
    the repaired rows as role:text, joined by newlines. Without edits: zeros, no letters, the hash of nothing.
    A hash goes through a conversation from end to end, so one task reads it whole, as stretches of a megabyte one after another; an audit must fit in a row (2 GB). repair() itself has neither limit.
    """
    id_type = edits.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), *T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in zip(_STRETCH, _STRETCH_SQL, strict=True))).fields])
    told = edits.withColumn("turn", F.col("turn").cast("long")).mapInArrow(_stretches(), schema)
    empty = {"string": F.lit(None).cast("string"), "binary": F.lit(None).cast("binary"), "long": F.lit(0).cast("long")}
    none = {c: empty[k] for c, k in zip(_STRETCH, _STRETCH_SQL, strict=True)} | {"part": F.lit(-1).cast("long"), "first_turn": F.lit(None).cast("long"), "last_turn": F.lit(None).cast("long"), "audit": F.lit("")}
    every = ids.select(F.col("conv_id").cast(id_type).alias("conv_id")).distinct().select("conv_id", *(c.alias(name) for name, c in none.items()))
    out = T.StructType([T.StructField("conv_id", id_type), *T.StructType.fromDDL(", ".join([f"{c} long" for c in _DIGEST] + ["audit string", "repaired_sha256 string"])).fields])
    return told.unionByName(every).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_digests, out)
