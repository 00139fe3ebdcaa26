"""Conversations mended by the cheapest edits that make their roles alternate.

Rows are sorted over the whole table by ranges of (conversation, turn, role,
text), so that a conversation of any length is spread over tasks. Within a
task a backward pass gives the cost to go of each grammar state before each
row, and a forward walk takes the ASCII-least edit among those that keep to
it. A conversation that reaches over a task's edge is a chain of stretches:
the costs of a stretch are a 4 x 4 table, whose products along the chain say
what the rest costs; walks from all four states then say where each stretch
begins. Two stretches a task at most touch an edge, which bounds the tables
that are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import ensure_checkpoint_dir, map_batches

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant; where a role's initial leads from each, -1 nowhere.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The one role that an insertion or a new role can have in each state.
WANTED = ("user", "user", "assistant", "user")
ENDS = (0, 3)
FAR = 1 << 60
#: Faults: none, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, CUT = range(4)
BLANKS = " \t\n\x0b\x0c\r"
#: Characters of a piece of a conversation that reaches over an edge.
PIECE = 1 << 20
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _closed(v: list[int]) -> list[int]:
    """Costs to go when insertions may come first."""
    two = min(v[2], INSERT + v[3])
    return [min(v[0], INSERT + two), min(v[1], INSERT + two), two, min(v[3], INSERT + two)]


END = _closed([0 if q in ENDS else FAR for q in range(4)])


def _before(v: list[int], initial: str, fault: int, copies: int) -> list[int]:
    """Costs to go before a row from those after it."""
    if fault in (BLANK, DUPLICATE):
        return [x + DELETE * copies for x in v]  # v is closed already
    cut, keep, out = TRUNCATED * (fault == CUT), NEXT.get(initial), []
    for q in range(4):
        best = min(DELETE + v[q], REROLE + cut + v[NEXT[WANTED[q][0]][q]])
        out.append(min(best, cut + v[keep[q]]) if keep and keep[q] >= 0 else best)
    return _closed(out)


def _entries(rows: list[tuple]) -> list[tuple]:
    """(initial, fault, copies, role, text) of (role, text, fault, copies): copies after the first of a row that may stay are duplicates."""
    out = []
    for role, text, fault, copies in rows:
        if not copies:
            continue
        if fault in (BLANK, DUPLICATE):
            out.append((role[:1], fault, copies, role, text))
        else:
            out.append((role[:1], fault, 1, role, text))
            if copies > 1:
                out.append((role[:1], DUPLICATE, copies - 1, role, text))
    return out


def _costs(entries: list[tuple], end: list[int]) -> list[list[int]]:
    """Costs to go before each entry, and after the last."""
    out = [list(end)]
    for initial, fault, copies, *_ in reversed(entries):
        out.append(_before(out[-1], initial, fault, copies))
    return out[::-1]


def _walk(entries: list[tuple], costs: list[list[int]], q: int, last: bool) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """(edit, cost, state after it, role, text) in order; a deletion has no role. Insertions after the last entry come only at a conversation's end."""
    for i, (initial, fault, copies, role, text) in enumerate(entries):
        now, then = costs[i], costs[i + 1]
        if fault in (BLANK, DUPLICATE):
            yield "D" * copies, DELETE * copies, q, None, None
            continue
        cut, keep = TRUNCATED * (fault == CUT), NEXT.get(initial, (-1,) * 4)
        while True:
            on = NEXT[WANTED[q][0]][q]
            if DELETE + then[q] == now[q]:
                yield "D", DELETE, q, None, None
            elif INSERT + now[on] == now[q]:
                yield "I", INSERT, on, WANTED[q], ""
                q = on
                continue
            elif keep[q] >= 0 and cut + then[keep[q]] == now[q]:
                q = keep[q]
                yield "K", cut, q, role, text
            else:
                yield "R", REROLE + cut, on, WANTED[q], text
                q = on
            break
    while last and q not in ENDS:
        role, q = WANTED[q], NEXT[WANTED[q][0]][q]
        yield "I", INSERT, q, role, ""


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20, nulls as one space.

    0 drops a row (copies 0), 1 empties its text, 2 takes ``[.!?]`` out of it,
    3 repeats it (copies 2), 4 makes its role user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their copies, and the fault of the first of them.

    Which row of a role and text comes first in its conversation is found by
    an aggregate and a join whose key has the turn, so that a text with many turns spreads.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    first = one.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("least.turn").alias("t"), F.lit(True).alias("first"))
    same = one["conv_id"].eqNullSafe(first["c"]) & (one["role"] == first["r"]) & (one["digest"] == first["d"]) & one["turn"].eqNullSafe(first["t"])
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    return one.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _placed(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows in order over ranges, with the number of their range, kept in the shared folder so that all passes see the same ranges."""
    ensure_checkpoint_dir(rows.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int | None, int, bool, list[tuple]]]:
    """(conversation, range, whether it touches an edge of the range, rows) of rows in order."""
    key, part, rows, first = None, None, [], True
    for b in batches:
        for c, p, *row in zip(*[b.column(k).to_pylist() for k in ("conv_id", "part", *columns)], strict=True):
            if part is not None and c != key:
                yield key, part, first, rows
                rows, first = [], False
            key, part = c, p
            rows.append(row)
    if part is not None:
        yield key, part, True, rows


_LIGHT = ["role", "fault", "copies"]


def _light(placed: DataFrame) -> DataFrame:
    return placed.select("conv_id", "part", F.left("role", F.lit(1)).alias("role"), "fault", "copies")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch at an edge, costs from each state before it to each after it."""
    out = []
    for conv, part, edge, rows in _runs(batches, _LIGHT):
        if edge:
            entries = _entries([(r, None, f, n) for r, f, n in rows])
            columns = [_costs(entries, [FAR * (q != e) for q in range(4)])[0] for e in range(4)]
            out.append((conv, part, [min(FAR, columns[e][q]) for q in range(4) for e in range(4)]))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])


def _rest(t: pa.Table) -> pa.Table:
    """What the rest of a conversation costs after each of its stretches; as many rows as tasks that it reaches."""
    found, end = [], END
    for x in sorted(t.to_pylist(), key=lambda x: -x["part"]):
        found.append({"conv_id": x["conv_id"], "part": x["part"], "rest": end, "last": not found})
        end = _closed([min(FAR, min(x["costs"][4 * q + e] + end[e] for e in range(4))) for q in range(4)])
    return pa.Table.from_pylist(found, schema=_REST)


_REST = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("rest", pa.list_(pa.int64())), ("last", pa.bool_())])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch at an edge, the state after it for each state before it."""
    out = []
    for conv, part, edge, rows in _runs(batches, [*_LIGHT, "rest", "last"]):
        if edge:
            rest, last = rows[0][3:]
            entries = _entries([(r, None, f, n) for r, f, n, *_ in rows])
            costs, ends = _costs(entries, rest), []
            for q in range(4):
                after = q
                if costs[0][q] < FAR:
                    for _, _, after, _, _ in _walk(entries, costs, q, last):
                        pass
                ends.append(after)
            out.append({"conv_id": conv, "part": part, "rest": rest, "last": last, "ends": ends})
    yield pa.RecordBatch.from_pylist(out, schema=_REST.append(pa.field("ends", pa.list_(pa.int64()))))


def _begun(t: pa.Table) -> pa.Table:
    """The state in which each stretch of a conversation begins."""
    found, q = [], 0
    for x in sorted(t.to_pylist(), key=lambda x: x["part"]):
        found.append({k: x[k] for k in ("conv_id", "part", "rest", "last")} | {"begins": q})
        q = x["ends"][q]
    return pa.Table.from_pylist(found, schema=_REST.append(pa.field("begins", pa.int64())))


def _with(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``placed`` with what ``edges`` says of its stretches: two rows a range at most, so that they are broadcast and rows stay in place."""
    e = edges.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")
    return placed.join(F.broadcast(e), placed["conv_id"].eqNullSafe(e["c"]) & (placed["part"] == e["p"]), "left").drop("c", "p")


_HEAVY = ["turn", "role", "text", "fault", "copies", "rest", "last", "begins"]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bool, list[list], Iterator[tuple]]]:
    """(conversation, range, whether at an edge, rows, walk) of each stretch."""
    for conv, part, edge, rows in _runs(batches, _HEAVY):
        rest, last, begins = rows[0][5:] if edge else (END, True, 0)
        entries = _entries([x[1:5] for x in rows])
        yield conv, part, edge, rows, _walk(entries, _costs(entries, rest), begins, last)


def _facts(rows: list[list]) -> dict:
    """Counts of a stretch, its first and last initials and turns."""
    out = dict.fromkeys((*COUNTS, "turns"), 0) | dict.fromkeys(("first", "final", "low", "high"))
    for turn, role, _, fault, n, *_ in rows:
        if not n:
            continue
        if turn is not None and turn != out["high"]:
            out |= {"low": turn if out["low"] is None else out["low"], "high": turn, "turns": out["turns"] + 1}
        out["blank"] += n * (fault == BLANK)
        out["duplicate"] += n if fault == DUPLICATE else (n - 1) * (fault != BLANK)
        out["truncated"] += fault == CUT
        out["illegal"] += n - 1 + _illegal(out["final"], role[:1])
        out |= {"first": role[:1] if out["first"] is None else out["first"], "final": role[:1]}
    return out


def _illegal(before: str | None, after: str | None) -> int:
    return int(before is not None and after is not None and before + after not in ("su", "ua", "au"))


_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in (*COUNTS, "turns", "low", "high")], ("first", pa.string()), ("final", pa.string()), ("audit", pa.string()), ("piece", pa.string()), ("sha", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with its digest for each conversation within a range; rows of bounded text for a stretch at an edge."""
    out, size = [], 0
    for conv, part, edge, rows, walk in _edits(batches):
        head, seq = _facts(rows) | {"conv_id": conv, "part": part}, 0
        audit, lines, held = [], [], 0
        for edit, cost, _, role, text in walk:
            audit.append(edit)
            head["cost"] += cost
            if role is not None:
                lines.append(f"{role}:{text}")
                held += len(lines[-1])
            if edge and held >= PIECE:  # the first row of a stretch has its counts, so they come with its last piece
                out.append(dict.fromkeys((*COUNTS, "turns"), 0) | {"conv_id": conv, "part": part, "seq": seq, "audit": "".join(audit), "piece": "\n".join(lines)})
                seq, audit, lines, size, held = seq + 1, [], [], size + held, 0
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
                    out, size = [], 0
        text = "\n".join(lines)
        out.append(head | {"seq": seq, "audit": "".join(audit)} | ({"piece": text} if edge else {"sha": hashlib.sha256(text.encode()).hexdigest()}))
        size += len(text) if edge else 300
        if size >= PIECE:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema=_PIECE)


_OUT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; texts pass through the hash and aren't held."""

    def row() -> dict:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        return {"conv_id": now["conv_id"], "gaps": min(gaps, (1 << 63) - 1), **{c: now[c] for c in COUNTS}, "audit": "".join(audit), "repaired_sha256": now["sha"] or state.hexdigest()}

    now, audit, state, any_line = None, [], None, False
    for b in batches:
        out = []
        for x in b.to_pylist():
            if now is None or x["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(row())
                now, audit, state, any_line = dict(x), [], hashlib.sha256(), False
            else:
                for c in COUNTS:
                    now[c] += x[c]
                now["illegal"] += _illegal(now["final"], x["first"])
                now["final"] = x["final"] if x["final"] is not None else now["final"]
                if x["low"] is not None:
                    now["turns"] += x["turns"] - (now["high"] == x["low"])
                    now |= {"low": x["low"] if now["low"] is None else now["low"], "high": x["high"]}
            audit.append(x["audit"])
            if x["piece"]:
                state.update((("\n" if any_line else "") + x["piece"]).encode())
                any_line = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=_OUT)


def _planned(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows in place, with what the walk needs at the edges."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), "copies")
    placed = _placed(_judged(rows), parts)
    light = _light(placed)
    rest = map_batches(light, _tables, "conv_id long, part int, costs array<long>").groupBy("conv_id").applyInArrow(_rest, "conv_id long, part int, rest array<long>, last boolean")
    leads = map_batches(_with(light, rest), _leads, "conv_id long, part int, rest array<long>, last boolean, ends array<long>")
    begun = leads.groupBy("conv_id").applyInArrow(_begun, "conv_id long, part int, rest array<long>, last boolean, begins long")
    return _with(placed, begun)


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows`` (conv_id, turn, role, text).

    Rows go by turn, nulls first, those of one turn by role and text. A null
    role or text is one space; rows without a conv_id are one conversation. A
    row may have ``copies``, how often it stands there; where all of a
    conversation's are 0 its counts are 0, its audit empty and its hash that of
    the empty string. Roles whose initial isn't s, u or a can't be kept. Gaps
    beyond a long are the greatest long. No rows give no rows; extra columns
    are left aside. A conversation of any length is worked on in parts; only
    its repaired text passes through one task, as SHA-256 goes in order, and
    its audit is one string.
    """
    pieces = map_batches(_planned(rows, parts), _pieces, "conv_id long, part int, seq int, " + ", ".join(f"{c} long" for c in (*COUNTS, "turns", "low", "high")) + ", first string, final string, audit string, piece string, sha string")
    in_order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return map_batches(in_order, _merged, "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


_TURN = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repaired_turns(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, part, place, edit, role, text): the turns that stand after the repair of ``rows``, in order of part and place within a conversation."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, part, _, _, walk in _edits(batches):
            for place, (edit, _, _, role, text) in enumerate(walk):
                if role is not None:
                    out.append({"conv_id": conv, "part": part, "place": place, "edit": edit, "role": role, "text": text})
                    size += len(text) + 100
                if size >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, schema=_TURN)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=_TURN)

    return map_batches(_planned(rows, parts), turns, "conv_id long, part int, place long, edit string, role string, text string")
