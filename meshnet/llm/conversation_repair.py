"""Repair of a conversation's structure at least cost: keep, rerole, delete and insert turns.

A repaired conversation is empty, or has an optional system turn and then pairs
of user and assistant. The turns that stay, kept or reroled, are a subsequence.
The cheapest one ends in each of four states (nothing, system, user, assistant);
the turns between two that stay are deleted, which a prefix sum of deletions
prices, so the best way into a state is a running minimum of cost less that sum.
The roles of two neighbours tell what is inserted between them. Among equal costs
the audit, the edits' initials in order, is the least in ASCII; audits of
different states differ and none begins another, so their order is enough and no
audit is written before the end.

Turns are sorted by ranges of conversation and place, so a conversation lies in
one partition, or in several that follow one another. Those wholly inside one
are repaired there at once. The first and the last of a partition may go on in
the next: their segments are each solved from all four states (costs add up,
orders compose), chained by conversation, and written from the state that the
chain chose. So a conversation of any share of the table is dealt out, and a
task has no more of it than a partition. A repeated turn is found by the first
place of its role and text, which is a minimum by key. Only the digest of a
repaired text, one hash over all of it, is fed by one task, piece by piece.

Cases: null roles and texts are one space, so such a turn is blank; a null turn
number comes first and counts in no gap. Turns of one number are ordered by role
and a hash of the text. A null conversation is a conversation. Roles other than
user, assistant and system are known by their first letter, an empty role by
none. Texts of any length are taken whole. Conversations without turns have
zeros, an empty audit and the hash of the empty text. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.llm.crc_sql import crc32_sql
from meshnet.plans.scratch import bound_arrow_batches, materialize
from meshnet.plans.tables import read_table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Fixed value: white space, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
_FAR = float("inf")
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def inserted(state: int, target: int) -> tuple[int, ...] | None:
    """The roles put between a turn of ``state`` and one of ``target``; None if they can't follow."""
    if target == SYSTEM:
        return () if state == NOTHING else None
    if target == USER:
        return (ASSISTANT,) if state == USER else ()
    return () if state == USER else (USER,)


def ending(state: int) -> tuple[int, ...]:
    """The roles put after the last turn."""
    return {NOTHING: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


#: For each role that a turn can take: state before it and the inserts between.
_WAYS = {t: [(s, inserted(s, t)) for s in range(4) if inserted(s, t) is not None] for t in ROLES}


class Walk:
    """The cheapest ways through turns from the state ``start`` into each state.

    ``turns`` are ``(initial, staying)``: what it costs beyond the edit if the turn stays, None if it can't.
    ``gain`` is cost less all deletions, ``rank`` the order of the audits so far.
    """

    def __init__(self, turns: list[tuple[str, int | None]], start: int):
        gain, rank, last = [_FAR] * 4, [0, 1, 2, 3], [-1] * 4
        gain[start] = 0
        self.nodes: list[tuple[int, int, str, int]] = []  # turn, role it takes, edit, node before
        for i, (initial, staying) in enumerate(turns):
            if staying is None:  # every way deletes it: their order stays
                continue
            ways = {s: (gain[s], rank[s], "D", s) for s in range(4) if gain[s] < _FAR}
            fresh = {}
            for target, before in _WAYS.items():
                keep = initial == ROLES[target][0]
                if not keep and target == SYSTEM:
                    continue
                price = staying + (0 if keep else REROLE) - DELETE
                found = [
                    (gain[s] + INSERT * len(put) + price, rank[s], "I" * len(put) + ("K" if keep else "R"), s)
                    for s, put in before
                    if gain[s] < _FAR
                ]
                best = min(found, default=None)
                if best and (target not in ways or best < ways[target]):
                    fresh[target] = best
            if fresh:
                ways |= fresh
                parents = list(last)
                for s, (cost, _, letters, before) in fresh.items():
                    gain[s] = cost
                    last[s] = len(self.nodes)
                    self.nodes.append((i, s, letters[-1], parents[before]))
                for place, s in enumerate(sorted(ways, key=lambda s: ways[s][1:3])):
                    rank[s] = place
        self.gain, self.rank, self.last, self.start, self.turns = gain, rank, last, start, len(turns)

    def cost(self, state: int) -> float:
        return self.gain[state] + DELETE * self.turns

    def edits(self, state: int, done: bool) -> list[tuple[str, int, int]]:
        """``(edit, turn, role)`` in order, on the way into ``state``; ``done``: with what ends the conversation. Inserts have turn -1."""
        chain, at = [], self.last[state]
        while at >= 0:
            chain.append(self.nodes[at])
            at = self.nodes[at][3]
        out, now, upto = [], self.start, 0
        for turn, role, edit, _ in reversed(chain):
            out += [("D", i, 0) for i in range(upto, turn)]
            out += [("I", -1, r) for r in inserted(now, role)]
            out.append((edit, turn, role))
            now, upto = role, turn + 1
        out += [("D", i, 0) for i in range(upto, self.turns)]
        return out + [("I", -1, r) for r in ending(now)] if done else out


def last_state(gain: list[float], rank: list[int]) -> int:
    """The state in which to end: least in cost with what it takes to end there, then in audit."""
    return min(range(4), key=lambda s: (gain[s] + INSERT * len(ending(s)), rank[s]))


class Turns:
    """Turns of a conversation, or of a segment of one, and their first faults."""

    def __init__(self, rows: list[tuple[int | None, str, str, bool]]):
        """``rows`` are ``(turn, role, text, repeated)``; repeated turns have their role and text earlier."""
        self.rows = rows
        self.blank = self.duplicate = self.truncated = 0
        self.priced: list[tuple[str, int | None]] = []
        for _, role, text, repeated in rows:
            bare = text.rstrip(BLANKS)
            staying: int | None = 0
            if not bare:
                self.blank += 1
                staying = None
            elif repeated:
                self.duplicate += 1
                staying = None
            elif bare[-1] not in ".!?":
                self.truncated += 1
                staying = TRUNCATED
            self.priced.append((role[:1], staying))
        initials = [r for r, _ in self.priced]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        known = [t for t, *_ in rows if t is not None]
        self.low, self.high, self.distinct = min(known, default=None), max(known, default=None), len(set(known))
        self.first, self.last = (initials[0], initials[-1]) if initials else (None, None)

    def written(self, edits: list[tuple[str, int, int]]) -> list[tuple[str, str, str]]:
        """``(edit, role, text)`` of the turns of the repaired conversation."""
        out = []
        for edit, i, role in edits:
            if edit == "K":
                out.append((edit, self.rows[i][1], self.rows[i][2]))
            elif edit != "D":
                out.append((edit, ROLES[role], self.rows[i][2] if i >= 0 else ""))
        return out


def _text(written: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in written)


_ROWS = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("there", pa.bool_())]
)
_TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_DONE = pa.schema([*((c, pa.int64()) for c in SUMMARY), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", pa.list_(_TURN))])
_SQL_ROWS = "key string, part int, n long, turn long, role string, text string, there boolean"
_SQL_DONE = ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, repaired_sha256 string, turns array<struct<edit:string,role:string,text:string>>"


def _whole(rows: list[dict], with_turns: bool) -> dict:
    """The result of a conversation of which all rows are here, in order."""
    seen, marked = set(), []
    for r in rows:
        if r["there"]:
            marked.append((r["turn"], r["role"], r["text"], (r["role"], r["text"]) in seen))
            seen.add((r["role"], r["text"]))
    turns = Turns(marked)
    walk = Walk(turns.priced, NOTHING)
    state = last_state(walk.gain, walk.rank)
    edits = walk.edits(state, True)
    written = turns.written(edits)
    return {
        "gaps": 0 if turns.low is None else turns.high - turns.low + 1 - turns.distinct,
        "blank": turns.blank, "duplicate": turns.duplicate, "truncated": turns.truncated, "illegal": turns.illegal,
        "cost": int(walk.cost(state)) + INSERT * len(ending(state)),
        "audit": "".join(e for e, _, _ in edits),
        "repaired_sha256": hashlib.sha256(_text(written).encode()).hexdigest(),
        "turns": [dict(zip(("edit", "role", "text"), w, strict=True)) for w in written] if with_turns else None,
    }


def _inside(with_turns: bool):
    """mapInArrow function over sorted turns: results of the conversations between the first and the last, and the rows of those two."""
    schema = pa.schema([*_ROWS, *_DONE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, now, rows, sent = None, None, [], 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first = r["key"] if first is None else first
                if r["key"] == first:  # it may have begun in an earlier partition, so it goes on as it comes
                    out.append(r | {"part": part, "n": sent})
                    sent += 1
                    continue
                if r["key"] != now:
                    if rows:
                        out.append({"key": now} | _whole(rows, with_turns))
                    now, rows = r["key"], []
                rows.append(r)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([r | {"part": part, "n": i} for i, r in enumerate(rows)], schema)

    return run


_SEGMENT = (
    "key string, part int, gain array<double>, ranks array<int>, turns long, blank long, duplicate long, truncated long, illegal long, "
    "low long, high long, distinct long, first string, last string"
)
_CHOICE = "key string, part int, start int, end int, done boolean, " + ", ".join(f"{c} long" for c in SUMMARY)


def _marked(group: pa.Table) -> Turns:
    rows = sorted(group.to_pylist(), key=lambda r: r["n"])
    return Turns([(r["turn"], r["role"], r["text"], r["repeated"]) for r in rows if r["there"]])


def _segment(key: tuple, group: pa.Table) -> pa.Table:
    """A segment, solved from each state into each."""
    turns = _marked(group)
    walks = [Walk(turns.priced, s) for s in range(4)]
    row = {
        "key": key[0].as_py(), "part": key[1].as_py(), "gain": [g for w in walks for g in w.gain], "ranks": [r for w in walks for r in w.rank],
        "turns": len(turns.rows), "blank": turns.blank, "duplicate": turns.duplicate, "truncated": turns.truncated, "illegal": turns.illegal,
        "low": turns.low, "high": turns.high, "distinct": turns.distinct, "first": turns.first, "last": turns.last,
    }
    kinds = [
        ("key", pa.string()), ("part", pa.int32()), ("gain", pa.list_(pa.float64())), ("ranks", pa.list_(pa.int32())),
        *((c, pa.int64()) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "distinct")),
        ("first", pa.string()), ("last", pa.string()),
    ]
    return pa.Table.from_pylist([row], pa.schema(kinds))


def _chain(key: tuple, group: pa.Table) -> pa.Table:
    """The states between the segments of a conversation, and its sums: a row a segment, of which there is one a partition at most."""
    segments = sorted(group.to_pylist(), key=lambda r: r["part"])
    gain, rank = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3]
    came = []
    total = dict.fromkeys(SUMMARY, 0)
    low = high = initial = None
    distinct = 0
    for r in segments:
        # Audits of different states differ, so their order alone decides between ways into a state.
        ways = {}
        for t in range(4):
            found = [(gain[s] + r["gain"][4 * s + t], rank[s], r["ranks"][4 * s + t], s) for s in range(4) if gain[s] + r["gain"][4 * s + t] < _FAR]
            if found:
                ways[t] = min(found)
        came.append({t: w[3] for t, w in ways.items()})
        gain = [ways[t][0] if t in ways else _FAR for t in range(4)]
        for place, t in enumerate(sorted(ways, key=lambda t: ways[t][1:3])):
            rank[t] = place
        for c in ("blank", "duplicate", "truncated", "illegal"):
            total[c] += r[c]
        if r["turns"]:
            total["illegal"] += initial is not None and initial + r["first"] not in LEGAL
            initial = r["last"]
        if r["low"] is not None:
            distinct += r["distinct"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
    state = last_state(gain, rank)
    total["gaps"] = 0 if low is None else high - low + 1 - distinct
    total["cost"] = int(gain[state]) + DELETE * sum(r["turns"] for r in segments) + INSERT * len(ending(state))
    out, end = [], state
    for r, before in zip(reversed(segments), reversed(came), strict=True):
        out.append({"key": key[0].as_py(), "part": r["part"], "start": before[end], "end": end, "done": not out} | total)
        end = before[end]
    kinds = [("key", pa.string()), ("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("done", pa.bool_()), *((c, pa.int64()) for c in SUMMARY)]
    return pa.Table.from_pylist(out, pa.schema(kinds))


_PIECE = pa.schema(
    [("key", pa.string()), ("part", pa.int32()), *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string()), ("kept", pa.int64()), ("text", pa.string()), ("turns", pa.list_(_TURN))]
)
_SQL_PIECE = "key string, part int, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, kept long, text string, turns array<struct<edit:string,role:string,text:string>>"


def _piece(with_turns: bool):
    """Function over a segment and its row of the chain: the piece of the repaired conversation."""

    def run(group: pa.Table, choice: pa.Table) -> pa.Table:
        turns, chosen = _marked(group), choice.to_pylist()[0]
        edits = Walk(turns.priced, chosen["start"]).edits(chosen["end"], chosen["done"])
        written = turns.written(edits)
        row = chosen | {
            "audit": "".join(e for e, _, _ in edits), "kept": len(written), "text": _text(written),
            "turns": [dict(zip(("edit", "role", "text"), w, strict=True)) for w in written] if with_turns else None,
        }
        return pa.Table.from_pylist([row], _PIECE)

    return run


def _joined(with_turns: bool):
    """mapInArrow function over pieces, sorted: the results of their conversations."""
    schema = pa.schema([("key", pa.string()), *_DONE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = audit = turns = sha = kept = None

        def result() -> pa.RecordBatch:
            done = {c: now[c] for c in ("key", *SUMMARY)}
            done |= {"audit": "".join(audit), "repaired_sha256": sha.hexdigest(), "turns": turns if with_turns else None}
            return pa.RecordBatch.from_pylist([done], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if now is None or r["key"] != now["key"]:
                    if now is not None:
                        yield result()
                    now, audit, turns, sha, kept = {c: r[c] for c in ("key", *SUMMARY)}, [], [], hashlib.sha256(), 0
                audit.append(r["audit"])
                turns += r["turns"] or []
                if r["kept"]:
                    sha.update(("\n" if kept else "").encode())
                    sha.update(r["text"].encode())
                    kept += r["kept"]
        if now is not None:
            yield result()

    return run


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there: Column | None = None,
    with_turns: bool = False,
) -> DataFrame:
    """One row a conversation: ``conv_id``, its faults and ``cost``, ``audit``, ``repaired_sha256``, and ``turns`` if asked for.

    Rows that ``there`` is not true for only name their conversation. ``turns`` are ``edit, role, text``
    of what the repaired conversation says.
    """
    spark = turns.sparkSession
    bound_arrow_batches(spark)
    there = F.lit(True) if there is None else F.coalesce(there, F.lit(False))
    kind = turns.schema[conv_col].dataType
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))]
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"),
        F.col(turn_col).cast("long").alias("turn"), *blank, there.alias("there"), F.monotonically_increasing_id().alias("any"),
    ).withColumn("th", F.xxhash64("text"))
    place = [F.asc_nulls_first(c) for c in ("key", "turn", "role", "th")]
    # Equal turns may be told apart by anything: then even those of a hot conversation are dealt out.
    ranges = rows.repartitionByRange(*place, "any").sortWithinPartitions(*place, "text")
    slim = ranges.select("key", "turn", "role", "text", "there")
    first = materialize(slim.mapInArrow(_inside(with_turns), f"{_SQL_ROWS}, {_SQL_DONE}"), "turns")
    names = ["key", *SUMMARY, "audit", "repaired_sha256", "turns"]
    done = first.where("part is null").select(names)

    digest = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2")]
    open_rows = first.where("part is not null").select("key", "part", "n", "turn", "role", "text", "there", *digest)
    seen = open_rows.where("there").groupBy("key", "k1", "k2").agg(F.min(F.struct("part", "n")).alias("at"))
    marked = materialize(
        open_rows.join(seen.hint("merge"), ["key", "k1", "k2"], "left").select(
            *_ROWS.names, F.coalesce(F.struct("part", "n") > F.col("at"), F.lit(False)).alias("repeated")
        ),
        "segments",
    )
    segments = marked.groupBy("key", "part").applyInArrow(_segment, _SEGMENT)
    chosen = segments.groupBy("key").applyInArrow(_chain, _CHOICE)
    pieces = marked.groupBy("key", "part").cogroup(chosen.groupBy("key", "part")).applyInArrow(_piece(with_turns), _SQL_PIECE)
    joined = pieces.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_joined(with_turns), f"key string, {_SQL_DONE}")
    conv = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv_id")
    out = done.unionByName(joined).select(conv, *names[1:])
    return out if with_turns else out.drop("turns")


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there`` with faults put in by the CRC-32 of conversation and turn; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("code") != 0))).alias("there"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All damaged rows of ``conversations``."""
    return repair(damage(read_table(spark, sf_dir, "conversations")), there=F.col("there"))


_CODE = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CODE} % 20 AS code FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS (
  SELECT *, rtrim(text, {_SPACE}) AS bare, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), turns AS (
  SELECT conv_id, i, turn, role, text, initial, bare = '' AS blank, bare <> '' AND again AS duplicate,
         bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM turns GROUP BY conv_id
), ways(state, target, put) AS (
  VALUES ('', 's', []), ('', 'u', []), ('s', 'u', []), ('a', 'u', []), ('u', 'u', ['assistant:']),
         ('u', 'a', []), ('', 'a', ['user:']), ('s', 'a', ['user:']), ('a', 'a', ['user:'])
), states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, said FROM (
    SELECT t.conv_id, t.i, w.target AS state,
           s.cost + CASE WHEN w.edit = 'D' THEN 2 ELSE len(w.put) * 5 + (w.edit = 'R')::BIGINT + CASE WHEN t.truncated THEN 5 ELSE 0 END END AS cost,
           s.audit || repeat('I', len(w.put)) || w.edit AS audit,
           CASE w.edit WHEN 'D' THEN s.said WHEN 'K' THEN list_append(list_concat(s.said, w.put), t.role || ':' || t.text)
                ELSE list_append(list_concat(s.said, w.put), CASE w.target WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text) END AS said
    FROM states s JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1
    JOIN (SELECT state, target, put, edit FROM ways, (VALUES ('K'), ('R')) e(edit)
          UNION ALL SELECT unnest(['', 's', 'u', 'a']), NULL, [], 'D') x(state, target0, put, edit) ON x.state = s.state
    CROSS JOIN LATERAL (SELECT coalesce(x.target0, x.state) AS target, x.put AS put, x.edit AS edit) w
    WHERE w.edit = 'D' OR NOT t.blank AND NOT t.duplicate AND (w.edit = 'K' AND w.target = t.initial OR w.edit = 'R' AND w.target <> 's')
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1
), ended AS (
  SELECT s.conv_id, s.cost + 5 * len(e.put) AS cost, s.audit || repeat('I', len(e.put)) AS audit, list_concat(s.said, e.put) AS said
  FROM states s JOIN (VALUES ('', []::VARCHAR[]), ('a', []), ('u', ['assistant:']), ('s', ['user:', 'assistant:'])) e(state, put) ON e.state = s.state
  WHERE s.i = (SELECT count(*) FROM turns t WHERE t.conv_id IS NOT DISTINCT FROM s.conv_id)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 5 * len(e.put), s.audit || repeat('I', len(e.put))) = 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
