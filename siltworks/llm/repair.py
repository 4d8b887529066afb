"""Repair of conversation structure by error-correcting Earley parsing.

A sound conversation is an optional system turn, then pairs of a user's and an assistant's turn. The grammar is weighted:
each role that a production asks for is kept, taken from a turn of another role (rerole) or made up (insert), and a
turn may go (delete). The chart has a column per turn; its items, nonterminals reached at a place, hold the least (cost,
audit), audits being the edits' initials. As the grammar is left-linear a column has one item per nonterminal, so a parse
takes linear time.

Turns are sorted by conversation and order over all tasks, so a conversation may lie in several. A task parses what it
holds in pieces of bounded size. A piece that is a whole conversation is repaired at once. Any other is parsed from
each nonterminal that it may begin with; its completed items say what it costs to get from one to another, and
pieces are put together in order from that alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import col, discard, materialise, ship

#: What the grammar derives so far: nothing, a system turn, an open pair, whole pairs. A conversation may end at ACCEPTED.
NOTHING, SYSTEM, OPEN, PAIRS = range(4)
ACCEPTED = (NOTHING, PAIRS)
#: Productions (left side, nonterminal before, initial of the role after it).
PRODUCTIONS = ((SYSTEM, NOTHING, "s"), (OPEN, NOTHING, "u"), (OPEN, SYSTEM, "u"), (OPEN, PAIRS, "u"), (PAIRS, OPEN, "a"))
#: Roles that turns can get.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Faults of a turn, the first that holds from the right; from DUPLICATE on it has to go.
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
#: Neighbours' initials that are in order.
LEGAL = ("su", "ua", "au")
#: Distinct turns of a piece at most.
PIECE = 512
WHITE = " \t\n\x0b\x0c\r"

Item = tuple[int, str]
#: Initial of the role, fault, number of equal turns.
Cell = tuple[str, int, int]


def _better(column: dict[int, Item], state: int, item: Item) -> bool:
    if state in column and column[state] <= item:
        return False
    column[state] = item
    return True


def _complete(column: dict[int, Item]) -> dict[int, Item]:
    """Close a column under insert productions, cheapest items first."""
    waiting = sorted(column, key=column.get)
    while waiting:
        before = waiting.pop(0)
        cost, audit = column[before]
        for after, of, role in PRODUCTIONS:
            if of == before and role in ROLES and _better(column, after, (cost + INSERT, audit + "I")):
                waiting = sorted({*waiting, after}, key=column.get)
    return column


def parse(cells: list[Cell], start: int = NOTHING) -> dict[int, Item]:
    """The last column of the chart: for each nonterminal the least (cost, audit) that derives the cells from ``start``."""
    column = {start: (0, "")}
    for initial, fault, copies in cells:
        # Deletions come before insertions in an audit, so those that must be need no insertion before them.
        forced = copies if fault >= DUPLICATE else copies - 1
        if fault < DUPLICATE:
            column, scanned = _complete(column), {}
            for state, (cost, audit) in column.items():
                _better(scanned, state, (cost + DELETE, audit + "D"))
            cut = CUT if fault == TRUNCATED else 0
            for after, before, role in PRODUCTIONS:
                if before in column:
                    cost, audit = column[before]
                    if role == initial:
                        _better(scanned, after, (cost + cut, audit + "K"))
                    elif role in ROLES:
                        _better(scanned, after, (cost + REROLE + cut, audit + "R"))
            column = scanned
        if forced:
            column = {state: (cost + DELETE * forced, audit + "D" * forced) for state, (cost, audit) in column.items()}
    return _complete(column)


def edits(audit: str, cells: list[Cell], state: int = NOTHING) -> tuple[list[tuple[str, str, str]], str]:
    """For each cell the roles inserted before it, its first turn's edit and new role ('' if it keeps its own); and the roles after all."""
    out, lead, letters = [], "", iter(audit)
    step = {"s": SYSTEM, "u": OPEN, "a": PAIRS}
    for initial, _, copies in cells:
        lead = ""
        while (letter := next(letters)) == "I":
            role = "a" if state == OPEN else "u"
            lead, state = lead + role, step[role]
        becomes = ""
        if letter == "R":
            becomes = "a" if state == OPEN else "u"
        if letter != "D":
            state = step[becomes or initial]
        out.append((lead, letter, becomes))
        for _ in range(copies - 1):
            next(letters)
    tail = ""
    for _ in letters:
        role = "a" if state == OPEN else "u"
        tail, state = tail + role, step[role]
    return out, tail


def illegal_pairs(cells: list[Cell]) -> int:
    """Neighbours whose roles are out of order; equal turns stand side by side."""
    return sum(n - 1 for _, _, n in cells) + sum(a[0] + b[0] not in LEGAL for a, b in zip(cells, cells[1:]))


_EDIT = pa.struct([("lead", pa.string()), ("edit", pa.string()), ("becomes", pa.string()), ("tail", pa.string())])
_WHOLE = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
_ITEM = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_CELL = pa.struct([("initial", pa.string()), ("fault", pa.int32()), ("copies", pa.int64())])
_PART = pa.struct([("items", pa.list_(_ITEM)), ("cells", pa.list_(_CELL))])
_EDIT_SQL = "struct<lead:string,edit:string,becomes:string,tail:string>"
_PARSED = f"piece bigint, seq int, done {_EDIT_SQL}, whole struct<cost:bigint,audit:string,illegal:bigint>, part struct<items:array<struct<start:int,end:int,cost:bigint,audit:string>>,cells:array<struct<initial:string,fault:int,copies:bigint>>>"


def _edit_rows(audit: str, cells: list[Cell], state: int) -> list[dict]:
    out, tail = edits(audit, cells, state)
    return [dict(zip(("lead", "edit", "becomes", "tail"), (*e, tail if i == len(out) - 1 else ""))) for i, e in enumerate(out)]


def _parse_sorted(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Add piece, seq and the edits of each row to sorted turns; a piece's last row has its result.

    Rows wait until their piece is parsed, so at most ``limit`` rows more than a batch are held.
    """
    first_piece = TaskContext.get().partitionId() << 33
    held: list[pa.RecordBatch] = []
    ready: list[tuple] = []
    pieces, cells, conv, begins = 0, [], None, False

    def close(ends: bool) -> None:
        """``begins`` and ``ends`` tell that the piece is known to begin or end its conversation."""
        nonlocal pieces, cells
        if not cells:
            return
        piece, n, whole, part, done = first_piece + pieces, len(cells), None, None, [None] * len(cells)
        if begins and ends:
            column = parse(cells)
            cost, audit = min(column[s] for s in ACCEPTED if s in column)
            whole = {"cost": cost, "audit": audit, "illegal": illegal_pairs(cells)}
            done = _edit_rows(audit, cells, NOTHING)
        else:
            starts = (NOTHING,) if begins else (NOTHING, SYSTEM, OPEN, PAIRS)
            items = [{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, (c, a) in parse(cells, s).items()]
            part = {"items": items, "cells": [dict(zip(("initial", "fault", "copies"), c)) for c in cells]}
        for seq in range(n):
            last = seq == n - 1
            ready.append((piece, seq, done[seq], whole if last else None, part if last else None))
        pieces, cells = pieces + 1, []

    def out() -> Iterator[pa.RecordBatch]:
        while held and len(ready) >= held[0].num_rows:
            batch = held.pop(0)
            rows = ready[: batch.num_rows]
            del ready[: batch.num_rows]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), _EDIT, _WHOLE, _PART))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "piece", "seq", "done", "whole", "part"])

    seen = False
    for batch in batches:
        held.append(batch)
        light = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "initial", "fault", "copies")]
        for c, *cell in zip(*light):
            if not seen or c != conv:
                close(True)
                begins, conv, seen = seen, c, True
            elif len(cells) >= limit:
                close(False)
                begins = False
            cells.append(tuple(cell))
        yield from out()
    close(False)
    yield from out()


def _less(a: list[tuple], b: list[tuple]) -> bool:
    """Whether the path ``a`` of audits, last one first, is less than ``b``."""
    return "".join(reversed(a)) < "".join(reversed(b))


def compose(parts: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """Put pieces together: the least cost, and of each piece the nonterminal it starts from and its audit.

    ``parts`` are the items of each piece in order. Audits of equal cost are compared back to where their paths meet.
    """
    ends: list[dict[int, tuple[int, int, str]]] = []
    costs = {NOTHING: 0}

    def path(i: int, state: int) -> Iterator[tuple[int, str]]:
        while i >= 0:
            _, state, audit = ends[i][state]
            yield state, audit
            i -= 1

    def less(i: int, a: tuple[int, str], b: tuple[int, str]) -> bool:
        (sa, xa), (sb, xb) = a, b
        left, right = [xa], [xb]
        back_a, back_b = path(i, sa), path(i, sb)
        while sa != sb:
            (sa, xa), (sb, xb) = next(back_a), next(back_b)
            left.append(xa)
            right.append(xb)
        return _less(left, right)

    for i, items in enumerate(parts):
        best: dict[int, tuple[int, int, str]] = {}
        for item in items:
            if item["start"] not in costs:
                continue
            cost, end = costs[item["start"]] + item["cost"], item["end"]
            known = best.get(end)
            if known is None or cost < known[0] or (cost == known[0] and less(i - 1, (item["start"], item["audit"]), known[1:])):
                best[end] = (cost, item["start"], item["audit"])
        ends.append(best)
        costs = {s: b[0] for s, b in best.items()}
    last = len(ends) - 1
    final = None
    for s in ACCEPTED:
        if s in costs and (final is None or costs[s] < costs[final] or (costs[s] == costs[final] and less(last, (s, ""), (final, "")))):
            final = s
    return costs[final], [*path(last, final)][::-1]


def _compose_group(key: tuple, table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    cost, chosen = compose([r["part"]["items"] for r in rows])
    cells = [[(c["initial"], c["fault"], c["copies"]) for c in r["part"]["cells"]] for r in rows]
    illegal = sum(map(illegal_pairs, cells)) + sum(a[-1][0] + b[0][0] not in LEGAL for a, b in zip(cells, cells[1:]))
    done = [_edit_rows(audit, c, state) for c, (state, audit) in zip(cells, chosen)]
    whole = [{"cost": cost, "audit": "".join(a for _, a in chosen), "illegal": illegal}] + [None] * (len(rows) - 1)
    return pa.table({"conv": table.column("conv"), "piece": pa.array([r["piece"] for r in rows], pa.int64()), "whole": pa.array(whole, _WHOLE), "done": pa.array(done, pa.list_(_EDIT))})


def _cells(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """conv, turn, role, text, copies, fault, initial of each distinct turn, and the written tables that it reads.

    The fault is that of the first of equal turns.
    """
    blank = lambda c: F.coalesce(col(c), F.lit(" "))
    df = messages.select(col(conv_id).alias("conv"), col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    df = materialise(df.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")))
    # Turns said before: the first of each role and text that occurs at several places.
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    said = df.groupBy("conv", "role", digest.alias("digest")).agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    said = materialise(said.select(F.col("conv").alias("of"), F.col("role").alias("by"), "digest", "first"), merge=True)
    again = df.join(said, F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (digest == F.col("digest")), "left")
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", BLANK).when(F.col("first") < order, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    out = again.select("conv", "turn", "role", "text", "copies", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    return out, (df, said)


def repair_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The repaired turns, and a report of each conversation, of messages sorted by turn (null first), role and text.

    Turns: conv_id, place (an array of numbers that orders them), edit (K kept, R reroled, I inserted), role, text; inserted
    ones have an empty text. Report: conv_id, gaps (numbers of turns that are lacking), blank, duplicate, truncated (turns by
    their first fault), illegal (neighbours whose roles are out of order), cost and audit of the repair (long, string).

    Null roles and texts are one blank. Blank turns and repetitions of a role and text said before go; of equal rows the first
    may stay. A null turn is in no gap. Messages without a conversation are one. Turns of any length are taken whole; extra
    columns are not read. A conversation with very many turns is parsed by several tasks; its audit, one value, is
    put together in one. Without messages there are no rows. Both frames read written tables.
    """
    ship(messages.sparkSession)
    cells, tables = _cells(messages, conv_id, turn, role, text)
    names = ["conv", "turn", "role", "text", "copies", "fault", "initial"]
    dealt = cells.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv", "turn", "role", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", " + _PARSED
    parsed = materialise(dealt.select(*names).mapInArrow(lambda batches: _parse_sorted(batches, piece), schema))
    discard(*tables)
    kind = cells.schema["conv"].dataType.simpleString()
    parts = parsed.filter("part is not null").select("conv", "piece", "part")
    composed = materialise(parts.groupBy("conv").applyInArrow(_compose_group, f"conv {kind}, piece bigint, whole struct<cost:bigint,audit:string,illegal:bigint>, done array<{_EDIT_SQL}>"))
    late = composed.select("piece", F.posexplode("done").alias("seq", "now"))
    rows = parsed.select("conv", "turn", "role", "text", "piece", "seq", "done")
    late = rows.filter("done is null").drop("done").join(late, ["piece", "seq"]).withColumnRenamed("now", "done")
    rows = rows.filter("done is not null").unionByName(late)

    made = lambda roles: f"transform(filter(split({roles}, ''), r -> r <> ''), r -> struct('I' as edit, if(r = 'u', 'user', 'assistant') as role, '' as text))"
    own = "if(done.edit = 'D', array(), array(struct(done.edit as edit, case done.becomes when 'u' then 'user' when 'a' then 'assistant' else role end as role, text as text)))"
    lines = F.expr(f"concat({made('done.lead')}, {own}, {made('done.tail')})")
    turns = rows.select(F.col("conv").alias("conv_id"), "piece", "seq", F.posexplode(lines).alias("k", "line"))
    place = F.array(F.col("piece"), F.col("seq").cast("long"), F.col("k").cast("long")).alias("place")
    turns = turns.select("conv_id", place, "line.*")

    copies = F.col("copies")
    count = lambda fault, n: F.sum(F.when(F.col("fault") == fault, n).otherwise(0))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = parsed.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), count(BLANK, copies).alias("blank"),
        F.sum(F.when(F.col("fault") == DUPLICATE, copies).when(F.col("fault") != BLANK, copies - 1).otherwise(0)).alias("duplicate"), count(TRUNCATED, 1).alias("truncated"),
    )
    wholes = parsed.filter("whole is not null").select("conv", "whole").unionByName(composed.filter("whole is not null").select("conv", "whole"))
    both = stats.unionByName(wholes.select("conv", "whole.*"), allowMissingColumns=True)
    report = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return turns, both.groupBy(F.col("conv").alias("conv_id")).agg(*[F.max(c).alias(c) for c in report])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines, of sorted lines: one state, whatever the length."""
    conv, state = None, None
    for batch in batches:
        ids, digests = [], []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            if state is None or c != conv:
                if state is not None:
                    ids.append(conv)
                    digests.append(state.hexdigest())
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column(0).type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the digest of a conversation's ``role:text`` lines in order, joined by newlines.

    A digest reads its conversation in order, so that is one task's work, with one hash state; lines are sorted by Spark.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = turns.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    return lines.mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults by the crc32 of ``conv_id:turn``, nulls as one blank.

    Of twenty: 0 drops the row, 1 empties its text, 2 takes out its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    df = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), case.alias("case")).filter("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "case")
    return df.withColumn("copy", F.explode(F.expr("if(case = 3, array(0, 1), array(0))"))).drop("case", "copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of damaged conversations: the report of ``repair_conversations``, whose rules hold, and the repaired digest.

    Conversations of which no row is left have zeros, an empty audit and the digest of the empty text, as have those
    whose repair keeps nothing.
    """
    turns, report = repair_conversations(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    both = report.unionByName(conversation_digests(turns), allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = [*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit")]
    return both.groupBy("conv_id").agg(*found, F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The crc32 by its table, then all three states and the end of the grammar carried from row to row, without pieces.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
cased AS (SELECT conv_id, turn, r, x,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 20 AS k FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM cased WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x, copy) AS i, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
told AS (SELECT conv_id, turn, i, r, x, left(r, 1) AS c, left(lag(r) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(r, 1) AS pair,
  CASE WHEN bare = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f FROM placed),
-- The cheapest (cost, audit, text) of each state of the grammar after i rows: nothing, a system turn, an open pair, whole pairs.
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {c: 0::BIGINT, a: '', t: ''} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
    {c: 2::BIGINT, a: 'I', t: chr(10) || 'user:'} AS u, {c: 4::BIGINT, a: 'II', t: chr(10) || 'user:' || chr(10) || 'assistant:'} AS p FROM (SELECT DISTINCT conv_id FROM told)
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([p, {c: u.c + 2, a: u.a || 'I', t: u.t || chr(10) || 'assistant:'}]) FROM (
    SELECT conv_id, i, e, s, p, list_min([u, {c: e.c + 2, a: e.a || 'I', t: e.t || chr(10) || 'user:'}, IF(s IS NULL, NULL, {c: s.c + 2, a: s.a || 'I', t: s.t || chr(10) || 'user:'}), {c: p.c + 2, a: p.a || 'I', t: p.t || chr(10) || 'user:'}]) AS u FROM (
      SELECT b.conv_id, o.i, {c: e.c + 3, a: e.a || 'D', t: e.t} AS e,
        list_min([IF(s IS NULL, NULL, {c: s.c + 3, a: s.a || 'D', t: s.t}), IF(f < 2 AND o.c = 's', {c: e.c + f, a: e.a || 'K', t: e.t || chr(10) || r || ':' || x}, NULL)]) AS s,
        list_min([{c: u.c + 3, a: u.a || 'D', t: u.t},
          IF(f < 2, {c: e.c + f + IF(o.c = 'u', 0, 2), a: e.a || IF(o.c = 'u', 'K', 'R'), t: e.t || chr(10) || IF(o.c = 'u', r, 'user') || ':' || x}, NULL),
          IF(f < 2 AND s IS NOT NULL, {c: s.c + f + IF(o.c = 'u', 0, 2), a: s.a || IF(o.c = 'u', 'K', 'R'), t: s.t || chr(10) || IF(o.c = 'u', r, 'user') || ':' || x}, NULL),
          IF(f < 2, {c: p.c + f + IF(o.c = 'u', 0, 2), a: p.a || IF(o.c = 'u', 'K', 'R'), t: p.t || chr(10) || IF(o.c = 'u', r, 'user') || ':' || x}, NULL)]) AS u,
        list_min([{c: p.c + 3, a: p.a || 'D', t: p.t},
          IF(f < 2, {c: u.c + f + IF(o.c = 'a', 0, 2), a: u.a || IF(o.c = 'a', 'K', 'R'), t: u.t || chr(10) || IF(o.c = 'a', r, 'assistant') || ':' || x}, NULL)]) AS p
      FROM best b JOIN told o ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND o.i = b.i + 1))),
ended AS (SELECT conv_id, max(i) AS i FROM best GROUP BY conv_id),
chosen AS (SELECT b.conv_id, list_min([e, p]) AS w FROM best b JOIN ended n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.i = b.i),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 3) AS blank, count_if(f = 2) AS duplicate, count_if(f = 1) AS truncated,
  count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.t[2:], '')) AS repaired_sha256
FROM ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
