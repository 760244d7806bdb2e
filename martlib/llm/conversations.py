"""Conversation repair: the cheapest edits that give a conversation legal turns.

Secondary-sorted streaming: rows are dealt by conversation and sorted by turn inside each
partition; one pass over the Arrow batches carries the state of a dynamic program from row to
row, across batches. The program has four states (nothing yet, after system, after user, after
assistant) and holds per state its least cost, the order of the states' edit strings (so equal
costs go to the ASCII-least string without the strings being kept), a running SHA-256 of the text
repaired so far, and one byte per row and state that says where the state came from. Every
``BLOCK_ROWS`` rows of one conversation those bytes leave the task as a row of the result and are
written to the shared folder, so memory does not grow with a conversation; a second stream walks
the blocks of such giants backwards and cuts their edit strings block by block.

Whether a row repeats an earlier one is found by Spark before the stream: the first turn of each
(conversation, role, text) comes from a map-side combined aggregate over digests, and later turns
that repeat it enter the stream as marks. A task remembers the marks of one turn number at most.
The SHA-256 of a conversation's text is sequential, so a conversation stays in one task.

Edits: keep (0), change the role to user or assistant (3), delete (4; required for blank rows and
repeats), insert an empty user or assistant turn anywhere (3). A truncated row that stays costs 3.
The result's role initials match ``(s?(ua)+)?``.

Defined cases: null role and text are one blank; a null turn is the first; a null conv_id is a
conversation; rows of the same turn number are ordered by role, then text; a row marked ``lost``
only names its conversation; roles count by their first letter, an empty role has none; a
conversation without rows has zeros, no edits and the hash of nothing; empty tables give empty
results; other columns are ignored. Turn spans beyond 64 bits count as the largest long.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.storage import write_through

# Rows of one conversation whose back pointers a task holds.
BLOCK_ROWS = 65_536
# Conversations per batch of results, and bytes of edit strings in one.
OUT_ROWS = 4096
OUT_BYTES = 8 * 1024 * 1024

SPACES = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

# State -> the state after each role that may follow. Roles by number: user, assistant, system.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
NAMES = (b"user:", b"assistant:")
_FOLLOWS = {0: {SYSTEM: 1, USER: 2}, 1: {USER: 2}, 2: {ASSISTANT: 3}, 3: {USER: 2}}
_FINAL = (0, 3)
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
# Faults of a row by number; the stream adds duplicates.
SOUND, BLANK, CUT = range(3)
DUPLICATE = 3

_FAR = 1 << 40
_LAST_LONG = (1 << 63) - 1


def _wanted(state: int) -> int:
    """The role that an inserted or changed turn has after a state."""
    return ASSISTANT if state == 2 else USER


def _inserts(state: int):
    """(roles inserted, state after them); a third one would only repeat a state."""
    roles: list[int] = []
    yield tuple(roles), state
    for _ in range(2):
        roles.append(_wanted(state))
        state = _FOLLOWS[state][roles[-1]]
        yield tuple(roles), state


@cache
def moves(role: int, must_go: bool, cut: bool) -> tuple:
    """All (from, to, cost, edit letters, roles inserted, role of the row or None) for one row."""
    found = []
    for start in _FOLLOWS:
        for roles, state in _inserts(start):
            letters, cost = "I" * len(roles), INSERT * len(roles)
            found.append((start, state, cost + DELETE, letters + "D", roles, None))
            if must_go:
                continue
            kept = cost + (TRUNCATED if cut else 0)
            if role in _FOLLOWS[state]:
                found.append((start, _FOLLOWS[state][role], kept, letters + "K", roles, OTHER))
            new = _wanted(state)
            found.append((start, _FOLLOWS[state][new], kept + REROLE, letters + "R", roles, new))
    return tuple(found)


@cache
def step(costs: tuple, order: tuple, role: int, must_go: bool, cut: bool) -> tuple:
    """One row: (cost taken out, costs, order, numbers of the chosen moves by state).

    Up to a row all edit strings hold as many letters other than I and end with one, so none
    is the beginning of another and ``order`` settles every comparison of what follows.
    """
    options = moves(role, must_go, cut)
    best: list = [None] * 4
    for number, (start, to, cost, letters, _, _) in enumerate(options):
        if costs[start] < _FAR:
            key = (costs[start] + cost, order[start], letters)
            if best[to] is None or key < best[to][0]:
                best[to] = (key, number)
    strings = sorted((b[0][1:], to) for to, b in enumerate(best) if b)
    ranks = {to: i for i, (_, to) in enumerate(strings)}
    least = min(b[0][0] for b in best if b)
    return (
        least,
        tuple(b[0][0] - least if b else _FAR for b in best),
        tuple(ranks.get(to, 9) for to in range(4)),
        tuple(b[1] if b else 255 for b in best),
    )


def close(costs: tuple, order: tuple) -> tuple[int, int, tuple]:
    """(cost, state before the last inserts, roles they insert) of the best ending."""
    ends = [
        (costs[start] + INSERT * len(roles), order[start], start, roles)
        for start in _FOLLOWS
        for roles, state in _inserts(start)
        if state in _FINAL and costs[start] < _FAR
    ]
    cost, _, start, roles = min(ends)
    return cost, start, roles


class Talk:
    """One conversation on its way through the stream."""

    def __init__(self, name):
        self.name = name
        self.costs, self.order, self.spent = (0, _FAR, _FAR, _FAR), (0, 9, 9, 9), 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.rows = bytearray()  # per row five bytes: its kind, and a move per state
        self.blocks = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.turns, self.first, self.turn = 0, None, None
        self.before = None  # role, role name and text of the row before
        self.marks: set = set()
        self.at = ()  # turn of the marks

    def row(self, turn, role: int, name: bytes, text: bytes, fault: int, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first = turn if self.first is None else self.first
        same_turn = self.before is not None and turn == self.turn
        repeated = repeated or (same_turn and self.before[1:] == (name, text))
        if self.before is not None and (self.before[0], role) not in _LEGAL:
            self.illegal += 1
        self.turn, self.before = turn, (role, name, text)
        if fault != BLANK and repeated:
            fault = DUPLICATE
        self.faults[fault] += 1
        kind = (role, fault in (BLANK, DUPLICATE), fault == CUT)
        least, costs, self.order, chosen = step(self.costs, self.order, *kind)
        self.spent += least
        options = moves(*kind)
        made = [None] * 4
        for to, number in enumerate(chosen):
            if number == 255:
                continue
            start, _, _, _, roles, own = options[number]
            state, h = start, self.hashes[start].copy()
            for new in roles:
                h.update(b"\n" + NAMES[new] if state else NAMES[new])
                state = _FOLLOWS[state][new]
            if own is not None:
                h.update((b"\n" if state else b"") + (name + b":" if own == OTHER else NAMES[own]))
                h.update(text)
            made[to] = h
        self.costs, self.hashes = costs, made
        self.rows += bytes((role * 4 + fault, *chosen))

    def held(self) -> int:
        return len(self.rows) // 5

    def block(self, state: int | None = None, tail: str | None = None) -> dict:
        """The back pointers held so far, as a row of the result."""
        out = {"conv_id": self.name, "block": self.blocks, "back": bytes(self.rows), "state": state, "tail": tail}
        self.blocks, self.rows = self.blocks + 1, bytearray()
        return out

    def end(self) -> list[dict]:
        cost, state, roles = close(self.costs, self.order)
        h, at = self.hashes[state], state
        for new in roles:
            h.update(b"\n" + NAMES[new] if at else NAMES[new])
            at = _FOLLOWS[at][new]
        span = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        found = {
            "conv_id": self.name,
            "gaps": min(span, _LAST_LONG),
            "blank": self.faults[BLANK],
            "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[CUT],
            "illegal": self.illegal,
            "cost": self.spent + cost,
            "repaired_sha256": h.hexdigest(),
        }
        tail = "I" * len(roles)
        if self.blocks:
            return [found, self.block(state, tail)]
        return [found | {"audit": walk(self.rows, state)[0] + tail}]


def walk(rows: bytes, state: int) -> tuple[str, int]:
    """Edit letters of a block that ends in ``state``, and the state that it starts from."""
    letters = []
    for i in range(len(rows) - 5, -1, -5):
        role, fault = divmod(rows[i], 4)
        start, _, _, word, _, _ = moves(role, fault in (BLANK, DUPLICATE), fault == CUT)[rows[i + 1 + state]]
        letters.append(word)
        state = start
    return "".join(reversed(letters)), state


_FOUND = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string, block long, back binary, state int, tail string"
)
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_LOST, _MARK, _ROW = range(3)


def _batches(rows, schema: pa.Schema):
    """Result rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("audit") or "") + len(row.get("back") or b"")
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stream(batches, schema: pa.Schema, block_rows: int):
    def rows():
        talk = None
        for batch in batches:
            names, turns, kinds, roles, faults = (
                batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role_kind", "fault")
            )
            texts, labels, digests = (
                batch.column(c).cast(pa.large_binary()).to_pylist() for c in ("text", "role", "digest")
            )
            for i, name in enumerate(names):
                if talk is None or talk.name != name:
                    if talk is not None:
                        yield from talk.end()
                    talk = Talk(name)
                if kinds[i] == _MARK:
                    if talk.at != (turns[i],):
                        talk.at, talk.marks = (turns[i],), set()
                    talk.marks.add(digests[i])
                elif kinds[i] == _ROW:
                    repeated = talk.at == (turns[i],) and digests[i] in talk.marks
                    talk.row(turns[i], roles[i], labels[i], texts[i], faults[i], repeated)
                    if talk.held() >= block_rows:
                        yield talk.block()
        if talk is not None:
            yield from talk.end()

    yield from _batches(rows(), schema)


def _unwind(batches, schema: pa.Schema):
    """Blocks of giant conversations, last one first, to pieces of their edit strings."""

    def rows():
        name, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["state"] is not None:
                    state = row["state"]
                letters, state = walk(row["back"], state)
                yield {"conv_id": row["conv_id"], "block": row["block"], "audit": letters + (row["tail"] or "")}

    yield from _batches(rows(), schema)


def _arrow(spark, schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _typed(df: DataFrame, rest: str) -> T.StructType:
    """A schema of the input's conv_id and further columns."""
    return T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(rest).fields])


def _prepared(turns: DataFrame) -> DataFrame:
    """The rows of the stream without the marks: faults, kinds and digests beside each turn."""
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in turns.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(lost, F.lit(_LOST)).otherwise(F.lit(_ROW)).alias("kind"),
        F.when(~lost, role).alias("role"),
        F.when(~lost, text).alias("text"),
    )
    trimmed = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "u", USER).when(initial == "a", ASSISTANT).when(initial == "s", SYSTEM)
    return rows.select(
        "conv_id",
        "turn",
        "kind",
        "role",
        "text",
        first.otherwise(OTHER).alias("role_kind"),
        F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(*ENDS), SOUND).otherwise(CUT).alias("fault"),
        _digest().alias("digest"),
    )


def _digest() -> Column:
    """SHA-256 of role and text, kept apart by the role's length."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.unhex(F.sha2(whole, 256))


def _marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest) of every turn whose role and text stood in an earlier turn."""
    places = rows.where(F.col("kind") == _ROW).select(
        "conv_id", "digest", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("place")
    )
    first = places.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    again = first.where("first <> last").select(
        F.col("conv_id").alias("of"), F.col("digest").alias("same"), F.col("first")
    )
    met = places.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")))
    return met.where("place <> first").select("conv_id", F.col("place.turn").alias("turn"), "digest").distinct()


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per conversation: its faults, the cost and letters of its cheapest repair, the repaired hash."""
    rows = _prepared(turns)
    marks = _marks(rows).select(
        "conv_id",
        "turn",
        F.lit(_MARK).alias("kind"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("role_kind", "int"), ("fault", "int"))],
        "digest",
    )
    dealt = rows.unionByName(marks).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "kind", "role", "text")
    schema = _typed(turns, _FOUND)
    arrow = _arrow(turns.sparkSession, schema)
    found = dealt.mapInArrow(lambda batches: _stream(batches, arrow, block_rows), schema)
    found = write_through(found, "conversations")

    blocks = found.where("back IS NOT NULL").select("conv_id", "block", "back", "state", "tail")
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    pieces_schema = _typed(turns, "block long, audit string")
    pieces_arrow = _arrow(turns.sparkSession, pieces_schema)
    pieces = blocks.mapInArrow(lambda batches: _unwind(batches, pieces_arrow), pieces_schema)
    # One piece per BLOCK_ROWS rows; together they are the value that is returned.
    whole = pieces.groupBy(F.col("conv_id").alias("of")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), ""
        ).alias("whole")
    )
    done = found.where("back IS NULL")
    return done.join(whole, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *[F.coalesce("audit", "whole").alias(c) if c == "audit" else c for c in COLUMNS]
    )


def _apply(batches, schema: pa.Schema):
    """Repaired turns from each conversation's edit letters, which come first, and its rows."""

    def inserted(name, letters, at, state, place):
        while at < len(letters) and letters[at] == "I":
            new = _wanted(state)
            state, place = _FOLLOWS[state][new], place + 1
            role = NAMES[new][:-1].decode()
            yield {"conv_id": name, "place": place, "turn": None, "role": role, "text": "", "edit": "I"}, at + 1, state, place
            at += 1

    def rows():
        name, letters, at, state, place, open_ = None, "", 0, 0, 0, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] < 0:
                    if open_:
                        for out, at, state, place in inserted(name, letters, at, state, place):
                            yield out
                    name, letters, at, state, place, open_ = row["conv_id"], row["text"], 0, 0, 0, True
                    continue
                for out, at, state, place in inserted(name, letters, at, state, place):
                    yield out
                edit = letters[at]
                at += 1
                if edit == "D":
                    continue
                role = row["role"]
                kind = _wanted(state) if edit == "R" else row["role_kind"]
                if edit == "R":
                    role = NAMES[kind][:-1].decode()
                state, place = _FOLLOWS[state][kind], place + 1
                yield {"conv_id": name, "place": place, "turn": row["turn"], "role": role, "text": row["text"], "edit": edit}
        if open_:
            for out, at, state, place in inserted(name, letters, at, state, place):
                yield out

    yield from _batches(rows(), schema)


def repaired_turns(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place from 1, turn or null, role, text, edit).

    ``reports`` is what :func:`repair` gave for the same turns.
    """
    columns = ["conv_id", "turn", "kind", "role", "text", "role_kind"]
    rows = _prepared(turns).where(F.col("kind") == _ROW).select(columns)
    edits = reports.select(
        "conv_id",
        F.lit(None).cast("long").alias("turn"),
        F.lit(-1).alias("kind"),
        F.lit(None).cast("string").alias("role"),
        F.col("audit").alias("text"),
        F.lit(None).cast("int").alias("role_kind"),
    )
    dealt = edits.unionByName(rows).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("kind") >= 0, "turn", "kind", "role", "text")
    schema = _typed(turns, "place long, turn long, role string, text string, edit string")
    arrow = _arrow(turns.sparkSession, schema)
    return dealt.mapInArrow(lambda batches: _apply(batches, arrow), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20; dropped rows are marked lost."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    text = F.coalesce("text", F.lit(" "))
    code = F.crc32(F.concat(names[0], F.lit(":"), names[1])) % 20
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), code.alias("code"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "")
        .when(F.col("code") == 2, F.translate("text", "".join(ENDS), ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("code") == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
