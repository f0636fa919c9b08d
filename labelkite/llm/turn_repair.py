"""Cheapest repair of a conversation's turns, by a Viterbi search that keeps only what is still open.

Faults of a row, the first that holds: ``blank`` (no sign but white space), ``duplicate`` (role and text
seen earlier in the conversation), ``truncated`` (its last sign is none of ``.!?``). Edits: keep (K, 0),
give the role user or assistant (R, 3), delete (D, 4; a must for blank and duplicate rows), insert an
empty text of user or assistant (I, 3); a truncated row that stays costs 3 more. The roles that are left
read ``(s?(ua)+)?`` by their initials. Of the cheapest repairs the one whose edits are least as text.

The search has four states (nothing yet, after s, after u, after a), and one survivor in each: the
cheapest edits so far, ties to the least text. Survivors are paths in a tree of edits whose nodes count
what hangs on them; an edit goes out as soon as all survivors share it, and a dead branch is freed. Two
survivors of one cost are compared on all that is still open of both: for each pair the remainders
behind their common beginning are brought along from row to row, so that no path is walked again. Texts
are not held: rows pass through at once and meet their edits in a sort inside the task, which can spill.

A conversation's rows are in order of turn (a null first), then role, then text. Spark deals
conversations out to tasks; one conversation is one task's stream, as each edit depends on all before.

Nulls: a null role or text is one space, so it is blank; null conversations are one conversation. A very
long text is one row like others. Repeated rows are duplicates. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

USER, ASSISTANT = "user", "assistant"
# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
_NEXT = {  # where a role's initial leads; no entry: not allowed
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED,
}
_OWN = {NOTHING: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}  # where user or assistant leads

REPAIRED = (
    "conv_id long, place long, edit string, role string, text string, turn long, was string, fault string, cost long"
)
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


class Tree:
    """Edits as a tree. A node is freed with its last child; the root moves on when one child is left."""

    def __init__(self) -> None:
        self.parent, self.refs, self.kids = array("q"), array("q"), array("q")
        self.letter: list[str] = []
        self.free: list[int] = []
        self.root = self.add(-1, "")

    def add(self, parent: int, letter: str) -> int:
        """A node that one survivor holds."""
        if self.free:
            node = self.free.pop()
            self.parent[node], self.refs[node], self.kids[node], self.letter[node] = parent, 1, 0, letter
        else:
            node = len(self.letter)
            self.parent.append(parent), self.refs.append(1), self.kids.append(0), self.letter.append(letter)
        if parent >= 0:
            self.refs[parent] += 1
            self.kids[parent] ^= node  # the sum of its children: the last one, when one is left
        return node

    def drop(self, node: int) -> None:
        """A survivor lets go of its node."""
        self.refs[node] -= 1
        while node != self.root and self.refs[node] == 0:
            parent = self.parent[node]
            self.free.append(node)
            self.kids[parent] ^= node
            self.refs[parent] -= 1
            node = parent

    def settled(self) -> str:
        """The edits that all survivors share; they leave the tree."""
        out = []
        while self.refs[self.root] == 1 and self.kids[self.root]:
            node, old = self.kids[self.root], self.root
            out.append(self.letter[node])
            self.parent[node], self.root = -1, node
            self.refs[old] = self.kids[old] = 0
            if old:  # number 0 is not used again, as it would vanish in a sum of children
                self.free.append(old)
        return "".join(out)

    def __len__(self) -> int:
        return len(self.letter) - len(self.free)


class Search:
    """The search over one conversation's rows."""

    def __init__(self) -> None:
        self.tree = Tree()
        # By state: cost and node. By pair of states: what is left of both behind their common beginning.
        self.best = {NOTHING: (0, self.tree.root)}
        self.rest = {(NOTHING, NOTHING): ("", "")}
        self._insert({NOTHING: (0, NOTHING, "")})

    def _less(self, x: tuple, y: tuple) -> bool:
        """Whether candidate ``(cost, from state, letters)`` is before the other."""
        if x[0] != y[0]:
            return x[0] < y[0]
        a, b = self.rest[x[1], y[1]]
        return a + x[2] < b + y[2]

    def row(self, initial: str, bad: bool, truncated: bool) -> str:
        """Take one row; the edits that are settled by it."""
        stays = STAYS if truncated else 0
        found: dict[int, tuple] = {}

        def offer(state: int, candidate: tuple) -> None:
            if state not in found or self._less(candidate, found[state]):
                found[state] = candidate

        for state, (cost, _) in self.best.items():
            offer(state, (cost + DELETE, state, "D"))
            if not bad:
                kept = _NEXT.get((state, initial))
                if kept is not None:
                    offer(kept, (cost + stays, state, "K"))
                offer(_OWN[state], (cost + REROLE + stays, state, "R"))
        self._insert(found)
        return self.tree.settled()

    def _insert(self, found: dict[int, tuple]) -> None:
        """Inserts behind the row: to u from elsewhere, then to a from u; then the new survivors."""
        for to, sources in ((ASKED, (NOTHING, SYSTEM, ANSWERED)), (ANSWERED, (ASKED,))):
            for s in sources:
                if s in found:
                    cost, state, letters = found[s]
                    more = (cost + INSERT, state, letters + "I")
                    if to not in found or self._less(more, found[to]):
                        found[to] = more
        # What goes on from nothing or after s can go on after a, at the cost of one deleted s at most: a
        # survivor that is dearer than that cannot win and would hold its branch for ever.
        for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
            if state in found and found[state][0] > found[ANSWERED][0] + more:
                del found[state]
        nodes: dict[tuple, int] = {}
        new = {}
        for state, (cost, source, letters) in sorted(found.items(), key=lambda x: len(x[1][2])):
            node = self.best[source][1]
            self.tree.refs[node] += not letters
            for i in range(len(letters)):
                key = source, letters[: i + 1]
                if key not in nodes:  # a survivor's letters may begin another's
                    nodes[key] = self.tree.add(node, letters[i])
                node = nodes[key]
            new[state] = cost, node
        held = {node for _, node in new.values()}
        rest = {}
        for i, (_, s, x) in found.items():
            for j, (_, t, y) in found.items():
                a, b = self.rest[s, t]
                rest[i, j] = _behind(a + x, b + y)
        for _, node in self.best.values():
            self.tree.drop(node)
        for node in nodes.values():
            if node not in held:
                self.tree.drop(node)
        self.best, self.rest = new, rest

    def end(self) -> str:
        """The edits that were still open."""
        ends = [(self.best[s][0], s, "") for s in (ANSWERED, NOTHING) if s in self.best]
        last = ends[-1] if len(ends) == 2 and self._less(ends[1], ends[0]) else ends[0]
        node, out = self.best[last[1]][1], []
        while node != self.tree.root:
            out.append(self.tree.letter[node])
            node = self.tree.parent[node]
        return "".join(reversed(out))


def _behind(a: str, b: str) -> tuple[str, str]:
    """What is left of two strings behind their common beginning; one sign of each decides."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    return (a[0], b[0]) if a and b else (a, b)


# Order of what belongs to one row: inserts before it, its edit, itself.
BEFORE, EDIT, ROW, NAME = range(4)
_STREAM = pa.schema(
    [("conv_id", pa.int64()), ("row", pa.int64()), ("kind", pa.int8()), ("edit", pa.string()), ("turn", pa.int64()),
     ("was", pa.string()), ("fault", pa.string()), ("text", pa.string())]
)
_STREAM_SQL = "conv_id long, row long, kind byte, edit string, turn long, was string, fault string, text string"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number, and the edits as they are settled: ``(conv_id, row, kind, edit)``."""
    now, search, taken, done = None, None, 0, 0
    conv, row, kind, edit = [], [], [], []

    def put(letters: str) -> None:
        nonlocal done
        for e in letters:
            conv.append(now[0])
            row.append(done)
            kind.append(BEFORE if e == "I" else EDIT)
            edit.append(e)
            done += e != "I"

    def edits() -> pa.RecordBatch:
        nothing = [pa.nulls(len(conv), t) for t in _STREAM.types[4:]]
        columns = [pa.array(conv, pa.int64()), pa.array(row, pa.int64()), pa.array(kind, pa.int8()), pa.array(edit, pa.string())]
        for x in (conv, row, kind, edit):
            x.clear()
        return pa.RecordBatch.from_arrays(columns + nothing, schema=_STREAM)

    for batch in batches:
        ids, present, _, was, fault, _ = (batch.column(i) for i in range(6))
        numbers = np.zeros(batch.num_rows, np.int64)
        initials = pc.utf8_slice_codeunits(was, 0, 1).to_pylist()
        for i, (c, there, f) in enumerate(zip(ids.to_pylist(), present.to_pylist(), fault.to_pylist())):
            if now is None or now[0] != c:
                if now is not None:
                    put(search.end())
                now, search, taken, done = (c,), Search(), 0, 0
            numbers[i] = taken
            if there:
                taken += 1
                put(search.row(initials[i], f in ("blank", "duplicate"), f == "truncated"))
        kinds = pc.if_else(present, pa.scalar(ROW, pa.int8()), pa.scalar(NAME, pa.int8()))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(numbers), kinds, pa.nulls(batch.num_rows, pa.string()), *batch.columns[2:]], schema=_STREAM
        )
        if conv:
            yield edits()
    if now is not None:
        put(search.end())
        yield edits()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its edit, and the inserted rows, in order; a conversation without rows has one of nulls."""
    now, state, place, edit, told = None, NOTHING, 0, None, False
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    for batch in batches:
        index, places, edits, roles, costs = [], [], [], [], []
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 5, 6)]
        for i, (c, kind, e, was, fault) in enumerate(zip(*columns)):
            if now is None or now[0] != c:
                now, state, place, edit, told = (c,), NOTHING, 0, None, False
            if kind == EDIT:
                edit = e
                continue
            if kind == NAME and (told or place):
                continue
            role, cost = None, 0
            if kind == BEFORE or edit == "R":
                state = _OWN[state]
                role = USER if state == ASKED else ASSISTANT
                cost = INSERT if kind == BEFORE else REROLE
            elif kind == ROW and edit == "K":
                state, role = _NEXT[state, was[:1]], was
            elif kind == ROW:
                cost = DELETE
            if kind == ROW:
                cost += STAYS if fault == "truncated" and edit != "D" else 0
            index.append(i)
            places.append(place)
            edits.append({BEFORE: "I", ROW: edit, NAME: None}[kind])
            roles.append(role)
            costs.append(cost)
            told = told or kind == NAME
            place += kind != NAME
        if index:
            at = pa.array(index, pa.int64())
            conv, kind, turn, was, fault, text = (batch.column(i).take(at) for i in (0, 2, 4, 5, 6, 7))
            inserted = pc.equal(kind, pa.scalar(BEFORE, pa.int8()))
            role = pa.array(roles, pa.string())
            text = pc.if_else(inserted, pa.scalar("", pa.string()), pc.if_else(pc.is_valid(role), text, pa.scalar(None, pa.string())))
            yield pa.RecordBatch.from_arrays(
                [conv, pa.array(places, pa.int64()), pa.array(edits, pa.string()), role, text, turn, was, fault, pa.array(costs, pa.int64())],
                names,
            )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each conversation from its repaired rows, which come in order."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    now = None
    rows: list[tuple] = []

    def closed() -> tuple:
        gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
        faults = [now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return now["conv"], gaps, *faults, "".join(now["audit"]), now["sha"].hexdigest()

    for batch in batches:
        for c, _, edit, role, text, turn, was, fault, cost in zip(*[x.to_pylist() for x in batch.columns]):
            if now is None or now["conv"] != c:
                if now is not None:
                    rows.append(closed())
                now = {"conv": c, "turns": 0, "first": None, "last": None, "blank": 0, "duplicate": 0, "truncated": 0}
                now |= {"illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "before": None}
            if edit is None:
                continue
            now["audit"].append(edit)
            now["cost"] += cost
            if fault:
                now[fault] += 1
            if was is not None:
                if now["before"] is not None and now["before"] + was[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = was[:1]
            if turn is not None:
                now["first"] = turn if now["turns"] == 0 else now["first"]
                now["turns"] += now["turns"] == 0 or turn != now["last"]
                now["last"] = turn
            if role is not None:
                now["sha"].update(("\n" if now["any"] else "").encode() + f"{role}:{text}".encode())
                now["any"] = True
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(), types)], names)


def repair(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """Repaired rows ``(conv_id, place, edit, role, text, turn, was, fault, cost)``.

    ``was`` is the role before; an inserted row has none, a deleted one has no ``role`` and ``text``. A
    row where ``present`` is not true only names its conversation; one without other rows gives one row
    whose edit is null. The rows of a conversation come together and in order, in one partition.
    """
    space = F.lit(" ")
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    given = rows.select(
        F.col(conversation).cast("long").alias("conv_id"),
        there.alias("present"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("was"),
        F.coalesce(F.col(text), space).alias("text"),
    ).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "was", "text").orderBy("turn")) > 1
    core = F.rtrim("text", F.lit(WHITE))
    fault = (
        F.when(core == "", "blank")
        .when(F.col("again"), "duplicate")
        .when(~F.right(core, F.lit(1)).isin(*ENDS), "truncated")
    )
    judged = given.withColumn("again", again).withColumn("fault", fault)
    ordered = judged.sortWithinPartitions("conv_id", "turn", "was", "text", "again")
    stream = ordered.select("conv_id", "present", "turn", "was", "fault", "text").mapInArrow(_searched, _STREAM_SQL)
    return stream.sortWithinPartitions("conv_id", "row", "kind").mapInArrow(_merged, REPAIRED)


def summary(repaired: DataFrame, arranged: bool = True) -> DataFrame:
    """Of each conversation: gaps in its turns, faults, illegal neighbours, cost, edits, digest of what is left.

    ``arranged``: the rows come as ``repair`` gives them; if they were stored in between, set it to false.
    """
    if not arranged:
        repaired = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return repaired.mapInArrow(_summed, SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, present)``: rows with faults that depend on a hash of their key."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text = F.coalesce("text", space)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ENDS, "")).otherwise(text)
    role = F.when(F.col("kind") == 4, USER).otherwise(F.coalesce("role", space))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), "kind"
    )
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return out.withColumn("copy", F.explode(copies)).drop("copy", "kind")
