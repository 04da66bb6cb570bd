"""Conversation structure repair by a forward Viterbi pass over four grammar states.

A conversation is legal when its roles' initials read ``(s?(ua)+)?``. The states are what has been kept so far: nothing,
a leading system turn, a user turn, an assistant turn. Each row is kept (0), rerolled to the role the grammar asks for
(1) or deleted (2); turns may be inserted anywhere (5). A layer holds, for each state, the least cost and the place of its
audit string among the layer's audits; the next row's moves go through the insert transitions that close the layer, of
which two in a row at most can matter.

Audits are compared without being carried: within a layer all have as many letters other than ``I`` and end in such a
letter, so none is a prefix of another, and whatever is appended leaves their order as it is. Costs count from the layer's
least one, so there are few layers and their moves are looked up. A conversation's rows arrive in order from Spark's sort
and are not held: a row leaves a few bytes for the way back, and each state carries the digest of its repaired text.

Defined cases: a null role, text, turn or id counts as one space where text is asked for; null turns come first; rows of
one turn follow in the order of role and text. Repeated rows are duplicates of each other. A row of another role than
system, user or assistant (by its first letter; an empty role has none) can be rerolled or deleted. Rows without an id are one conversation. A
conversation without rows after damage has zeros and the digest of the empty string. An empty table gives an empty
result; other columns are ignored. One digest of a whole conversation can be formed only from its start to its end, so
the rows of a conversation pass through one task, sorted by Spark and one batch at a time; what is gathered before
(repeated rows) is pre-aggregated by digest, and its join is one that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import table

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What an inserted or rerolled turn becomes after each state.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_SPACE = "\\x20\\x09-\\x0D"

#: A layer: per state None, or (cost over the least, place of the audit). A step: the new layer, what the least cost
#: grows by, and per new state None or (state before, letters).
Layer = tuple[tuple[int, int] | None, ...]
Step = tuple[Layer, int, tuple[tuple[int, str] | None, ...]]
FIRST: Layer = ((0, 0), None, None, None)


def _closed(state: int) -> Iterator[tuple[int, int]]:
    """(state, inserts) reachable from a state by inserts, each state once."""
    seen, inserts = {state}, 0
    yield state, 0
    while _NEXT[state] not in seen:
        state, inserts = _NEXT[state], inserts + 1
        seen.add(state)
        yield state, inserts


def _step(layer: Layer, initial: str, forced: bool, truncated: bool) -> Step:
    """One row's moves. ``forced`` rows can only be deleted."""
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(to: int, cost: int, before: int, letters: str) -> None:
        key = (cost, layer[before][1], letters, before)
        if to not in found or key < found[to]:
            found[to] = key

    for before, held in enumerate(layer):
        if held is None:
            continue
        offer(before, held[0] + DELETE, before, "D")  # deleting after an insert costs the same and reads later
        for state, inserts in () if forced else _closed(before):
            cost, letters = held[0] + INSERT * inserts + TRUNCATED * truncated, "I" * inserts
            wanted = _NEXT[state]
            if initial == "ua"[wanted == ASSISTANT]:
                offer(wanted, cost + KEEP, before, letters + "K")
            else:
                offer(wanted, cost + REROLE, before, letters + "R")
            if initial == "s" and state == NOTHING:
                offer(SYSTEM, cost + KEEP, before, letters + "K")
    whole = min(found[s][0] + INSERT * n for s in found for q, n in _closed(s) if q == ASSISTANT)
    # what follows a kept system turn, or nothing, can follow an assistant turn too; only a later system turn could not be kept
    for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
        if state in found and found[state][0] > whole + more:
            del found[state]
    least = min(key[0] for key in found.values())
    order = {key[1:3]: i for i, key in enumerate(sorted(found.values(), key=lambda k: k[1:3]))}
    new = tuple((found[s][0] - least, order[found[s][1:3]]) if s in found else None for s in range(4))
    return new, least, tuple((found[s][3], found[s][2]) if s in found else None for s in range(4))


def _last(layer: Layer) -> tuple[int, int, int]:
    """(cost, state, inserts) of the best legal end."""
    ends = [
        (held[0] + INSERT * inserts, held[1], inserts, before)
        for before, held in enumerate(layer) if held
        for state, inserts in _closed(before) if state == ASSISTANT or state == NOTHING
    ]
    cost, _, inserts, before = min(ends)
    return cost, before, inserts


class Steps:
    """Moves by layer and kind of row, each worked out once."""

    def __init__(self) -> None:
        self.known: dict[tuple[Layer, str, bool, bool], int] = {}
        self.steps: list[Step] = []

    def of(self, layer: Layer, initial: str, forced: bool, truncated: bool) -> int:
        initial = initial if initial in ("s", "u", "a") else ""
        key = (layer, "", True, False) if forced else (layer, initial, forced, truncated)
        if key not in self.known:
            self.known[key] = len(self.steps)
            self.steps.append(_step(*key))
        return self.known[key]


def _written(digest: Any, state: int, letters: str, role: str, text: str) -> int:
    """Append what a move keeps to the digest; the state after it."""
    for letter in letters:
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            new = SYSTEM
        else:
            new = _NEXT[state]
        piece = f"{role if letter == 'K' else _ROLES[new]}:{'' if letter == 'I' else text}"
        digest.update((piece if state == NOTHING else "\n" + piece).encode("utf-8", "surrogatepass"))
        state = new
    return state


class Conversation:
    """One conversation's rows, in order; ``close`` gives its line of the result."""

    def __init__(self, conv_id: Any, steps: Steps) -> None:
        self.conv_id, self.steps = conv_id, steps
        self.layer, self.cost, self.path = FIRST, 0, array("i")
        self.digests: list[Any] = [hashlib.sha256(), None, None, None]
        self.low = self.high = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: tuple | None = None  # turn, role, text of the row before

    def add(self, turn: Any, role: str, text: str, blank: bool, repeated: bool, cut: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.turn
            self.high = self.turn = turn
        repeated = repeated or self.before == (turn, role, text)
        duplicate = repeated and not blank
        cut = cut and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.before = (turn, role, text)
        step = self.steps.of(self.layer, role[:1], blank or duplicate, cut)
        self.path.append(step)
        self.layer, more, back = self.steps.steps[step]
        self.cost += more
        old, self.digests = self.digests, [None] * 4
        for state, move in enumerate(back):
            if move is not None:
                self.digests[state] = old[move[0]].copy() if move[1] != "D" else old[move[0]]
                _written(self.digests[state], move[0], move[1], role, text)

    def close(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        cost, state, inserts = _last(self.layer)
        digest = self.digests[state].copy()
        _written(digest, state, "I" * inserts, "", "")
        letters = ["I" * inserts]
        for step in reversed(self.path):
            state, edit = self.steps.steps[step][2][state]
            letters.append(edit)
        audit = "".join(reversed(letters))
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, audit, digest.hexdigest(),
        )


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after the planned damage. Dropped rows stay, marked, for their ids."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("how"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumn("copy", copies).select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        (F.col("how") == 0).alias("gone"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with their faults; ``repeated`` says that role and text stand at an earlier turn."""
    marked = rows.select(
        "conv_id", "turn", "role", "text", "gone",
        (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"),
        (~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).alias("digest"),
    )
    there = marked.filter(~F.col("gone") & ~F.col("blank"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    repeats = there.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1")
    repeats = repeats.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    here = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    return marked.join(repeats, same, "left").select(
        "conv_id", "turn", "role", "text", "gone", "blank", "cut", F.coalesce(here > F.col("first"), F.lit(False)).alias("repeated")
    )


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repair_rows(rows: DataFrame) -> DataFrame:
    """One line per conversation of ``rows(conv_id, turn, role, text, gone)``: faults, cost, audit, digest."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, now, lines = Steps(), None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*lines), types)]
            lines.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            for conv_id, turn, role, text, gone, blank, cut, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        lines.append(now.close())
                    now = Conversation(conv_id, steps)
                if not gone:
                    now.add(turn, role, text, blank, repeated, cut)
            if len(lines) > 1 << 12:
                yield flush()
        if now is not None:
            lines.append(now.close())
            yield flush()

    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return _in_order(_marked(rows)).mapInArrow(run, schema)


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as they are, for ``repair_rows``."""
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *text, F.lit(False).alias("gone"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the repaired conversations, turn by turn, as their audits say.

    The audits are joined to the rows they name, and each conversation is walked once more in the same order.
    """
    found = repair_rows(rows).select(F.col("conv_id").alias("_conv"), "audit")
    there = rows.filter(~F.col("gone")).join(found, F.col("conv_id").eqNullSafe(F.col("_conv")))
    kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, state, place, out = (), "", 0, NOTHING, 0, []

        def inserted() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state, at = _NEXT[state], at + 1
                out.append((now[0], place, None, _ROLES[state], "", "I"))
                place += 1

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), batch.schema.field(1).type, pa.string(), pa.string(), pa.string()]
            for conv_id, turn, role, text, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv_id,):
                    now, audit, at, state, place = (conv_id,), letters, 0, NOTHING, 0
                inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = SYSTEM if edit == "K" and role[:1] == "s" else _NEXT[state]
                    out.append((conv_id, place, turn, role if edit == "K" else _ROLES[state], text, edit))
                    place += 1
                if "D" not in audit[at:] and "K" not in audit[at:] and "R" not in audit[at:]:
                    inserted()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "place", "turn", "role", "text", "edit"])
                out = []

    schema = f"conv_id {kind}, place long, turn {turn_kind}, role string, text string, edit string"
    return _in_order(there.select("conv_id", "turn", "role", "text", "audit")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_rows(damaged(table(spark, sf_dir, "conversations")))


#: The moves as a table: state before, role's initial ('*': any other than the wanted one), letters, state after, cost.
_MOVES = ", ".join(
    f"({before}, '{initial}', '{'I' * inserts}{letter}', {to}, {INSERT * inserts + cost})"
    for before in range(4)
    for state, inserts in _closed(before)
    for initial, letter, to, cost in (
        ("ua"[_NEXT[state] == ASSISTANT], "K", _NEXT[state], KEEP),
        *(((c, "R", _NEXT[state], REROLE)) for c in "sua*" if c != "ua"[_NEXT[state] == ASSISTANT]),
        *([("s", "K", SYSTEM, KEEP)] if state == NOTHING else []),
    )
)
_ENDS = ", ".join(f"({s}, '{'I' * n}', {INSERT * n})" for s in range(4) for q, n in _closed(s) if q in (NOTHING, ASSISTANT))
_TEXT_OF = """
  CASE m.letters WHEN 'K' THEN s || r.role || ':' || r.text
    WHEN 'R' THEN s || CASE WHEN v.st = 2 THEN 'assistant:' ELSE 'user:' END || r.text
    WHEN 'IK' THEN s || CASE WHEN v.st = 2 THEN 'assistant:' ELSE 'user:' END || chr(10) || r.role || ':' || r.text
    WHEN 'IR' THEN s || CASE WHEN v.st = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || r.text
    WHEN 'IIK' THEN s || 'user:' || chr(10) || 'assistant:' || chr(10) || r.role || ':' || r.text
    WHEN 'IIR' THEN s || 'user:' || chr(10) || 'assistant:' || chr(10) || 'user:' || r.text END"""

ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS how
  FROM keyed),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) AS c(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM rows_after),
faults AS (
  SELECT *, core = '' AS blank,
    core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
    lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
r AS (
  SELECT *, NOT blank AND NOT duplicate AND right(core, 1) NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '*' END AS initial
  FROM faults),
m(st, initial, letters, nxt, cost) AS (VALUES {_MOVES}),
e(st, letters, cost) AS (VALUES {_ENDS}),
v AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS st, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, st, min(best) FROM (
    SELECT v.conv_id, r.pos, v.st, {{'c': v.best.c + {DELETE}, 'a': v.best.a || 'D', 't': v.best.t}} AS best
    FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.pos = v.pos + 1
    UNION ALL
    SELECT v.conv_id, r.pos, m.nxt, {{'c': v.best.c + m.cost + CASE WHEN r.truncated THEN {TRUNCATED} ELSE 0 END, 'a': v.best.a || m.letters,
      't': {_TEXT_OF.replace(" s ||", " v.best.t || CASE WHEN v.st = 0 THEN '' ELSE chr(10) END ||")}}}
    FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.pos = v.pos + 1
      JOIN m ON m.st = v.st AND m.initial = r.initial WHERE NOT r.blank AND NOT r.duplicate)
  GROUP BY conv_id, pos, st),
n AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM r GROUP BY conv_id),
ends AS (
  SELECT v.conv_id, v.pos, min({{'c': v.best.c + e.cost, 'a': v.best.a || e.letters,
    't': v.best.t || CASE e.letters WHEN '' THEN '' WHEN 'I' THEN chr(10) || 'assistant:'
      ELSE CASE WHEN v.st = 0 THEN '' ELSE chr(10) END || 'user:' || chr(10) || 'assistant:' END}}) AS best
  FROM v JOIN e ON e.st = v.st GROUP BY v.conv_id, v.pos)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM ends LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ends.conv_id WHERE ends.pos = coalesce(n.n, 0)
"""
