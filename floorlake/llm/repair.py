"""Conversation structure repair: the cheapest edits, by A*, after which a conversation is ``(s?(ua)+)?`` in role initials."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.llm.common import NOT_SPACE
from floorlake.staging import small_batches, staged

#: States of a repaired conversation: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
# What edits cost.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Inserts that end a conversation properly, by the state it stops in.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Rows, and bytes of text, of a conversation that are solved at a time; longer ones are put together from pieces.
PIECE_ROWS = 512
PIECE_BYTES = 1 << 20

Row = tuple[str, int, str, str]  # role initial, fault, role, text


def _onward(state: int) -> int:
    return ASSISTANT if state == USER else USER


def search(rows: list[tuple], entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """exit state -> (cost, audit) of the cheapest edits of ``rows`` from state ``entry``, of equal ones the ASCII-least.

    ``rows`` begin with role initial and fault. Without ``last`` no insert follows the last row,
    and every state that can be reached is an exit; with it the only exit is that of the cheapest proper end.

    A* over (rows taken, state), keyed by (cost plus heuristic, audit). The heuristic of a place is
    the sum, over the rows from there on, of what each must cost: 2 for a required deletion, and 2
    for a truncated row, which is deleted for 2 or charged 5. It is consistent, and an audit sorts
    after what it begins with, so keys never fall along a path and a node's first visit is its best.
    """
    n = len(rows)
    due = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        due[i] = due[i + 1] + (min(DELETE, CUT_SHORT) if rows[i][1] else 0)
    heap = [(due[0], "", 0, entry)]
    seen, exits = set(), {}
    while heap:
        key, audit, i, state = heapq.heappop(heap)
        if i > n:
            return {state: (key, audit)}
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n:
            if last:
                heapq.heappush(heap, (key + INSERT * len(TAILS[state]), audit + TAILS[state], n + 1, state))
            else:
                exits[state] = (key, audit)
            continue
        cost, onward = key - due[i], _onward(state)
        initial, fault = rows[i][:2]
        heapq.heappush(heap, (cost + DELETE + due[i + 1], audit + "D", i + 1, state))
        heapq.heappush(heap, (cost + INSERT + due[i], audit + "I", i, onward))
        if fault in (SOUND, TRUNCATED):
            kept = cost + (CUT_SHORT if fault else 0) + due[i + 1]
            heapq.heappush(heap, (kept + REROLE, audit + "R", i + 1, onward))
            if initial == "s" and state == START:
                heapq.heappush(heap, (kept, audit + "K", i + 1, SYSTEM))
            elif initial == ("a" if state == USER else "u"):
                heapq.heappush(heap, (kept, audit + "K", i + 1, onward))
    return exits


def edited(rows: list[tuple], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows after the edits of ``audit``, from ``state`` on."""
    i = 0
    for edit in audit:
        onward = _onward(state)
        name = "assistant" if state == USER else "user"
        if edit == "D":
            i += 1
            continue
        if edit == "I":
            yield name, ""
        else:
            yield (rows[i][2] if edit == "K" else name), rows[i][3]
            onward = SYSTEM if edit == "K" and rows[i][0] == "s" else onward
            i += 1
        state = onward


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` of rows damaged by crc32 of ``conv_id:turn`` mod 20: 0 drops a row (no copies), 1 empties its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes its role user.

    Nulls are one space, in that key too.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies")
    )


def judged(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, digest, initial, fault, role, text, copies: the rows of each conversation, equal ones as one with their number.

    A row's fault is the first of: blank; duplicate, its role and text stand earlier; truncated. Of
    a deleted row's copies all but the first are duplicates, or blank. Rows without copies only
    name their conversation. Role and text are compared by SHA-256.
    """
    n = (F.lit(1) if copies is None else copies).cast("long")
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("copies"))
    gone = F.col("copies") == 0
    said = said.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), *[F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")], "copies")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # rows that only name their conversation are apart from all others
    one = said.groupBy("conv_id", "turn", digest.alias("digest"), gone.alias("gone")).agg(F.sum("copies").alias("copies"), F.max("role").alias("role"), F.max("text").alias("text"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "digest", "gone").orderBy("turn")) > 1
    end = F.regexp_extract("text", f"({NOT_SPACE})[\\x20\\x09-\\x0D]*$", 1)
    fault = F.when(end == "", BLANK).when(earlier, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    found = one.select("conv_id", "turn", "digest", initial.alias("initial"), fault.alias("fault"), "role", "text", "copies")
    # a deleted row's text is of no more use
    return found.withColumn("text", F.when(F.col("fault").isin(BLANK, DUPLICATE), "").otherwise(F.col("text")))


STATS = "lo long, hi long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long"
PIECES = (
    f"conv_id long, part int, seq long, done boolean, {STATS}, cost long, audit string, repaired_sha256 string, "
    "moves array<struct<entry: int, exit: int, cost: long, audit: string>>, held array<struct<initial: string, fault: int, role: string, text: string>>"
)
HELD = pa.struct([("initial", pa.string()), ("fault", pa.int32()), ("role", pa.string()), ("text", pa.string())])
MOVE = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
WHOLE = [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("done", pa.bool_())]
NUMBERS = [(k, pa.string() if k in ("head", "tail") else pa.int64()) for k in (c.split()[0] for c in STATS.split(", "))]
PIECE_SCHEMA = pa.schema([*WHOLE, *NUMBERS, ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("moves", pa.list_(MOVE)), ("held", pa.list_(HELD))])


def _digest(turns: Iterator[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()


class _Piece:
    """Neighbouring rows of one conversation, and what is counted of them."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.rows, self.bytes = conv_id, [], 0
        self.stats = {"lo": None, "hi": None, "turns": 0, "head": None, "tail": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn: int | None, row: Row) -> None:
        s = self.stats
        if turn is not None and turn != s["hi"]:
            s["turns"] += 1
            s["lo"] = turn if s["lo"] is None else s["lo"]
            s["hi"] = turn
        if s["tail"] is not None:
            s["illegal"] += s["tail"] + row[0] not in ("su", "ua", "au")
        s["head"] = row[0] if s["head"] is None else s["head"]
        s["tail"] = row[0]
        if row[1]:
            s[("blank", "duplicate", "truncated")[row[1] - 1]] += 1
        self.rows.append(row)
        self.bytes += len(row[3])

    def record(self, whole: bool, part: int, seq: int) -> dict:
        out = {"conv_id": self.conv_id, "part": part, "seq": seq, "done": whole, **self.stats}
        if whole:
            ((cost, audit),) = search(self.rows, START, True).values()
            return out | {"cost": cost, "audit": audit, "repaired_sha256": _digest(edited(self.rows, audit))}
        moves = [{"entry": g, "exit": h, "cost": c, "audit": a} for g in range(4) for h, (c, a) in search(self.rows, g, False).items()]
        return out | {"moves": moves, "held": [dict(zip(("initial", "fault", "role", "text"), r, strict=True)) for r in self.rows]}


def _batches(records: Iterator[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for r in records:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(rows: DataFrame, solved: bool = True) -> DataFrame:
    """Conversations solved (``done``), or their pieces with the cheapest edits between any two states.

    Rows are sorted over all tasks, so a long conversation lies in many. A conversation that neither begins nor ends
    a task's rows and fits a piece is solved at once; of others it takes the pieces to know. Without ``solved`` all come in pieces.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records() -> Iterator[dict]:
            seq, piece, whole = 0, None, False
            for batch in batches:
                for r in batch.to_pylist():
                    if piece is None or piece.conv_id != r["conv_id"]:
                        if piece is not None:
                            yield piece.record(whole, part, seq)
                            seq += 1
                        piece, whole = _Piece(r["conv_id"]), solved and piece is not None
                    for k in range(r["copies"]):
                        if len(piece.rows) >= PIECE_ROWS or piece.bytes >= PIECE_BYTES:
                            yield piece.record(False, part, seq)
                            seq += 1
                            piece, whole = _Piece(r["conv_id"]), False
                        fault = r["fault"] if k == 0 or r["fault"] == BLANK else DUPLICATE
                        piece.add(r["turn"], (r["initial"], fault, r["role"], r["text"] if k == 0 else ""))
            if piece is not None:
                yield piece.record(False, part, seq)

        return _batches(records(), PIECE_SCHEMA, 64)

    order = ["conv_id", "turn", "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(solve, PIECES)


def _by_conversation(df: DataFrame) -> DataFrame:
    order = ["conv_id", "part", "seq"]
    return df.repartition("conv_id").sortWithinPartitions(*order)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its records) of sorted records."""
    from itertools import groupby

    return groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["conv_id"])


def _put_together(conv_id: int | None, pieces: Iterator[dict]) -> dict:
    """One conversation's counts and cheapest audit from its pieces, with the audit and entry state of each piece.

    ``best``: state -> (cost, place of the audit so far among those of all states, way back). Such audits end with
    a row taken, so none begins with another and their order holds whatever follows.
    """
    best, ways, s = {START: (0, 0)}, [], None
    for p in pieces:
        found = {}
        for m in p["moves"]:
            if m["entry"] in best:
                cost, place = best[m["entry"]]
                option = (cost + m["cost"], place, m["audit"], m["entry"])
                found[m["exit"]] = min(found.get(m["exit"], option), option)
        places = {x: k for k, x in enumerate(sorted({o[1:3] for o in found.values()}))}
        best = {state: (o[0], places[o[1:3]]) for state, o in found.items()}
        ways.append((p["part"], p["seq"], {state: o[2:] for state, o in found.items()}))
        if s is None or s["head"] is None:
            s = {k: p[k] for k, _ in NUMBERS}
        elif p["head"] is not None:
            s["turns"] += p["turns"] - (p["turns"] > 0 and p["lo"] == s["hi"])
            s["illegal"] += p["illegal"] + (s["tail"] + p["head"] not in ("su", "ua", "au"))
            s["lo"] = p["lo"] if s["lo"] is None else s["lo"]
            s["hi"], s["tail"] = (s["hi"] if p["hi"] is None else p["hi"]), p["tail"]
            for k in ("blank", "duplicate", "truncated"):
                s[k] += p[k]
    cost, _, tail, state = min((cost + INSERT * len(TAILS[g]), place, TAILS[g], g) for g, (cost, place) in best.items())
    steps = []
    for k, (part, seq, back) in enumerate(reversed(ways)):
        audit, entry = back[state]
        steps.append({"part": part, "seq": seq, "entry": entry, "audit": audit + ("" if k else tail)})
        state = entry
    steps.reverse()
    return {"conv_id": conv_id, **s, "cost": cost, "audit": "".join(x["audit"] for x in steps), "steps": steps}


STEP = pa.struct([("part", pa.int32()), ("seq", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())])
JOINED_SCHEMA = pa.schema([("conv_id", pa.int64()), *NUMBERS, ("cost", pa.int64()), ("audit", pa.string()), ("steps", pa.list_(STEP))])
JOINED = f"conv_id long, {STATS}, cost long, audit string, steps array<struct<part: int, seq: long, entry: int, audit: string>>"


def _joined(pieces: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_put_together(c, rows) for c, rows in _grouped(batches)), JOINED_SCHEMA, 1)

    return _by_conversation(pieces.select("conv_id", "part", "seq", *[k for k, _ in NUMBERS], "moves")).mapInArrow(solve, JOINED)


def _with_steps(pieces: DataFrame, joined: DataFrame) -> DataFrame:
    steps = joined.select(F.inline("steps"))
    return pieces.select("conv_id", "part", "seq", "held").join(steps, ["part", "seq"])


def _edited(record: dict) -> Iterator[tuple[str, str]]:
    rows = [(h["initial"], h["fault"], h["role"], h["text"]) for h in record["held"]]
    return edited(rows, record["audit"], record["entry"])


def _digests(pieces: DataFrame, joined: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: a digest takes its conversation's turns one after another, so it streams through one task, a piece at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(rows: Iterator[dict]) -> str:
        out, between = hashlib.sha256(), ""
        for r in rows:
            for role, text in _edited(r):
                out.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
        return out.hexdigest()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(({"conv_id": c, "repaired_sha256": digest(rows)} for c, rows in _grouped(batches)), schema, 64)

    return _by_conversation(_with_steps(pieces, joined)).mapInArrow(solve, "conv_id long, repaired_sha256 string")


def repair_conversations(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    Rows are taken by turn, nulls first, then by a digest of role and text; null roles and texts
    are one space. ``copies`` says how often each row stands there; a conversation of rows without
    copies has zeros and an empty audit. Keep (K) costs 0, Rerole (R) 1, Delete (D) 2, Insert (I)
    5, and a truncated row that isn't deleted 5; blank and duplicate rows must go. A role's
    initial is its first character, an empty role's a space; only s, u and a can be kept. Rows with
    a null conv_id are one conversation; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    pieces = staged(_pieces(judged(turns, copies)), "pieces")
    split = pieces.filter("not done")
    joined = staged(_joined(split), "joined")
    digests = _digests(split, joined).withColumnRenamed("conv_id", "__conv")
    own = ["conv_id", *[k for k, _ in NUMBERS], "cost", "audit", "repaired_sha256"]
    rest = joined.drop("steps").join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long")
    every = pieces.filter("done").select(*own).union(rest.select(*own))
    return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, part, seq, place, role, text: the turns of the repaired conversations, in the order of part, seq and place."""
    small_batches(turns.sparkSession)
    pieces = staged(_pieces(judged(turns, copies), solved=False), "pieces")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((r, k, t) for batch in batches for r in batch.to_pylist() for k, t in enumerate(_edited(r)))
        return _batches(({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "place": k, "role": t[0], "text": t[1]} for r, k, t in found), schema, 64)

    return _with_steps(pieces, staged(_joined(pieces), "joined")).mapInArrow(solve, "conv_id long, part int, seq long, place int, role string, text string")
