"""Repair of the role structure of conversations by a Viterbi search with survivor coalescence.

A conversation is read turn by turn. For each state of the grammar ``(s?(ua)+)?`` (nothing yet, system
said, user said, assistant said) the cheapest edits that lead there survive, as a tip of a backpointer
tree whose nodes count their children. A node without children and without a survivor goes. As soon as
all survivors descend from one child of the root, that child's edit is certain: it is emitted and the
child becomes the root. So memory holds what is still open, not the conversation. A survivor that
cannot win any more goes at once: if another state can follow any future of its state for at most d
more and is cheaper by more than d (strictly, so ties stay). Without this the path that deletes
everything would survive for ever and keep the root from moving. Rows stay open only as long as the
grammar itself leaves them open, such as a run of rows that all need another role, whose parity only
the end decides. Of equally cheap
edits the ones whose letters are least in ASCII order survive: the two open suffixes are compared in
full, back to the node where they part (a row's letters are inserts and then one edit, so neither
suffix is a prefix of the other).

On Spark the rows are placed by conversation and sorted by turn inside each partition; a task streams
through them and holds one conversation's open rows at a time. Repeated messages are found before by
an aggregation over digests (partial in each task), so no task remembers what it has seen. The digest
of a repaired conversation (SHA-256 over its text) is sequential by nature: one task reads a whole
conversation, in bounded memory, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
#: States: nothing yet, system said, user said, assistant said; where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_TO = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that a message of the due role leads to.
_DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


@dataclass(frozen=True)
class Costs:
    """Costs of the edits; ``truncated`` is added for a truncated message that is not deleted."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class _Node:
    """An edit of one row (with the inserts in front of it) on the way from the root to a survivor."""

    __slots__ = ("parent", "letters", "state", "row", "children")

    def __init__(self, parent: _Node | None, letters: str, state: int, row):
        self.parent, self.letters, self.state, self.row = parent, letters, state, row
        self.children: dict[int, _Node] = {}  # its length is the reference count
        if parent is not None:
            parent.children[id(self)] = self


def _letters(a: _Node, b: _Node, a_last: str, b_last: str) -> tuple[str, str]:
    """The open letters of two paths of equal row count, from where they part."""
    left, right = [a_last], [b_last]
    while a is not b:
        left.append(a.letters)
        right.append(b.letters)
        a, b = a.parent, b.parent
    return "".join(reversed(left)), "".join(reversed(right))


def _follow_costs(costs: Costs) -> list[list[int]]:
    """[x][y]: what following any future of state y costs at most more from state x. The start and an
    assistant's message allow the same next letters, but for a system message, which can be deleted
    instead; what follows a system message may follow both. An insert leads on to the next state."""
    far = 1 << 30
    d = [[0 if x == y else far for y in range(4)] for x in range(4)]
    d[START][ASSISTANT] = d[START][SYSTEM] = d[ASSISTANT][SYSTEM] = 0
    d[ASSISTANT][START] = max(0, costs.delete - costs.keep)
    for x in range(4):
        d[x][_DUE[x]] = min(d[x][_DUE[x]], costs.insert)
    for via in range(4):
        d = [[min(d[x][y], d[x][via] + d[via][y]) for y in range(4)] for x in range(4)]
    return d


class Repair:
    """The search over one conversation: ``step`` per row, then ``finish``; both return the edits that
    have become certain, as (letter, state after it, row), an insert's row being None."""

    def __init__(self, costs: Costs = Costs()):
        if costs.insert <= 0:
            raise ValueError("an insert must cost something")
        self.costs, self._moves = costs, {}
        self.reach = _follow_costs(costs)
        self.reset()

    def reset(self) -> None:
        self.root = _Node(None, "", START, None)
        self.alive: dict[int, tuple[int, _Node]] = {START: (0, self.root)}

    def moves(self, initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, str, int]]:
        """(from, to, letters, cost) of all ways to treat a row, with the fewest inserts for each end."""
        key = (initial, must_go, truncated)
        if key in self._moves:
            return self._moves[key]
        c, found = self.costs, {}
        extra = c.truncated if truncated else 0
        for start in range(4):
            state, inserts = start, 0
            while inserts < 4:
                ways = [(state, "D", c.delete)]
                if not must_go:
                    ways.append((_DUE[state], "R", c.rerole + extra))
                    if state in _TO.get(initial, {}):
                        ways.append((_TO[initial][state], "K", c.keep + extra))
                for to, letter, cost in ways:
                    found.setdefault((start, to, letter), ("I" * inserts + letter, inserts * c.insert + cost))
                state, inserts = _DUE[state], inserts + 1
        self._moves[key] = [(a, b, letters, cost) for (a, b, _), (letters, cost) in found.items()]
        return self._moves[key]

    def step(self, initial: str, must_go: bool, truncated: bool, row) -> list[tuple[str, int, object]]:
        best: dict[int, tuple[int, _Node, str]] = {}
        for start, to, letters, cost in self.moves(initial, must_go, truncated):
            if start not in self.alive:
                continue
            total, node = self.alive[start][0] + cost, self.alive[start][1]
            now = best.get(to)
            if now is not None and (total > now[0] or (total == now[0] and not self._before(node, letters, now[1], now[2]))):
                continue
            best[to] = (total, node, letters)
        old = [node for _, node in self.alive.values()]
        best = {y: b for y, b in best.items() if all(a[0] + self.reach[x][y] >= b[0] for x, a in best.items())}
        self.alive = {to: (total, _Node(node, letters, to, row)) for to, (total, node, letters) in best.items()}
        for node in old:
            self._drop(node)
        return self._certain()

    @staticmethod
    def _before(a: _Node, a_last: str, b: _Node, b_last: str) -> bool:
        left, right = _letters(a, b, a_last, b_last)
        return left < right

    def _drop(self, node: _Node) -> None:
        """Nodes without children go, up to the first that has others."""
        while node is not self.root and not node.children:
            up = node.parent
            del up.children[id(node)]
            node = up

    def _certain(self) -> list[tuple[str, int, object]]:
        """What all survivors share."""
        out = []
        while len(self.root.children) == 1:
            (child,) = self.root.children.values()
            out += self._spelt(self.root.state, child)
            child.parent, self.root = None, child
        return out

    @staticmethod
    def _spelt(state: int, node: _Node) -> list[tuple[str, int, object]]:
        out = []
        for letter in node.letters:
            if letter == "I":
                state = _DUE[state]
                out.append(("I", state, None))
            else:
                out.append((letter, node.state, node.row))
        return out

    def finish(self) -> tuple[int, list[tuple[str, int, object]]]:
        """The cost of the whole and the edits that were still open; ready for the next conversation."""
        best: tuple[int, _Node, str] | None = None
        for state, (total, node) in self.alive.items():
            inserts, at = 0, state
            while at not in FINAL:
                at, inserts = _DUE[at], inserts + 1
            total += inserts * self.costs.insert
            if best is None or total < best[0] or (total == best[0] and self._before(node, "I" * inserts, best[1], best[2])):
                best = (total, node, "I" * inserts)
        total, node, last = best
        path, tip = [], node
        while tip is not self.root:
            path.append(tip)
            tip = tip.parent
        out, state = [], self.root.state
        for tip in reversed(path):
            out += self._spelt(state, tip)
            state = tip.state
        for letter in last:
            state = _DUE[state]
            out.append((letter, state, None))
        self.reset()
        return total, out


def fault_of(text: str, repeated: bool) -> str:
    """The first fault of a message: blank, duplicate, truncated, or ''."""
    said = text.rstrip(SPACE)
    if not said:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if said.endswith(ENDINGS) else "truncated"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive): test damage by crc32('conv:turn') % 20. 0 drops a row (not
    alive), 1 empties its text, 2 deletes its sentence endings, 3 repeats it, 4 makes it a user's.
    Nulls read as one space; a null turn stays null for the order."""

    def read(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    conv, turn, role, text = (F.col(c) for c in (conv_col, turn_col, role_col, text_col))
    kind = F.crc32(F.concat(read(conv), F.lit(":"), read(turn)).cast("binary")) % 20
    base = rows.select(conv.alias("conv"), turn.cast("long").alias("turn"), read(role).alias("role"), read(text).alias("text"), kind.alias("kind"))
    hurt = base.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("alive"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    gone = F.lit(None).cast("string")
    return hurt.select("conv", "turn", *[F.when(F.col("alive"), F.col(c)).otherwise(gone).alias(c) for c in ("role", "text")], "alive")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``later``: the same role and text stands at an earlier turn of the conversation (null turns
    come first). Only digests are grouped, and only those of several turns are joined back."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    keyed = rows.withColumn("digest", F.when(F.col("alive") & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), digest))
    nulls = F.max(F.col("turn").isNull())
    seen = keyed.where("digest is not null").groupBy("conv", "digest")
    seen = seen.agg(F.min("turn").alias("least"), F.max("turn").alias("most"), nulls.alias("nulls"))
    seen = seen.where((F.col("least") < F.col("most")) | (F.col("nulls") & F.col("least").isNotNull()))
    seen = seen.select(F.col("conv").alias("c2"), F.col("digest").alias("d2"), F.when(~F.col("nulls"), F.col("least")).alias("first_turn"), F.lit(True).alias("several"))
    met = keyed.join(seen, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("digest") == F.col("d2")), "left")
    later = F.col("several").isNotNull() & F.col("turn").isNotNull() & (F.col("first_turn").isNull() | (F.col("turn") > F.col("first_turn")))
    return met.select("conv", "turn", "role", "text", "alive", later.alias("later"))


_EDIT = "seq long, edit string, turn long, was_role string, fault string, role string, text string, cost long"
_NAMES = ["conv", "seq", "edit", "turn", "was_role", "fault", "role", "text", "cost"]
#: Rows of an output batch, and characters of text at which it goes earlier.
_BATCH_ROWS, _BATCH_CHARS = 4096, 4_000_000


def repair_conversations(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``, one row per edit.

    ``rows``: (conv, turn, role, text[, alive]); rows that are not alive only name their conversation.
    Output, in order inside each conversation: conv, seq, edit (K keep, R rerole, D delete, I insert),
    turn, was_role and fault of the row, role and text after the edit (null if deleted), cost. A
    conversation without rows has one row with a null edit. Turns are read nulls first, rows of one
    turn by role and text. Blank and duplicate messages must be deleted. Roles count by their first
    letter (s, u, a); others have to be reroled or deleted. Null conversations are one conversation.
    Null roles and texts read as one space. Texts stay whole."""
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    space = F.lit(" ")
    held = [F.when(F.col("alive"), F.coalesce(F.col(c).cast("string"), space)).alias(c) for c in ("role", "text")]
    flagged = _with_repeats(rows.select("conv", F.col("turn").cast("long").alias("turn"), *held, "alive"))
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Repair(costs)
        out: list[tuple] = []
        chars, seq, arrow_type = 0, 0, None
        conv, open_, before, any_row = None, False, None, False

        def told(edits) -> None:
            nonlocal seq, chars
            for letter, state, row in edits:
                if row is None:
                    line = (conv, seq, letter, None, None, None, ROLE[state], "", costs.insert)
                else:
                    turn, role, text, fault = row
                    worse = costs.truncated if fault == "truncated" else 0
                    if letter == "D":
                        line = (conv, seq, letter, turn, role, fault, None, None, costs.delete)
                    elif letter == "R":
                        line = (conv, seq, letter, turn, role, fault, ROLE[state], text, costs.rerole + worse)
                    else:
                        line = (conv, seq, letter, turn, role, fault, role, text, costs.keep + worse)
                out.append(line)
                seq += 1
                chars += len(line[7] or "")

        def flush() -> pa.RecordBatch:
            nonlocal out, chars
            kinds = [arrow_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)
            out, chars = [], 0
            return batch

        def close() -> None:
            if open_:
                if any_row:
                    told(search.finish()[1])
                else:
                    out.append((conv, None, None, None, None, None, None, None, 0))

        for b in batches:
            arrow_type = b.schema.field(0).type
            for i in range(b.num_rows):
                c, turn, role, text, alive, later = (b.column(k)[i].as_py() for k in range(6))
                if not open_ or c != conv:
                    close()
                    conv, open_, before, any_row, seq = c, True, None, False, 0
                if alive:
                    any_row = True
                    repeated = later or before == (turn, role, text)
                    before = (turn, role, text)
                    fault = fault_of(text, repeated)
                    told(search.step(role[:1], fault in ("blank", "duplicate"), fault == "truncated", (turn, role, text, fault)))
                if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    yield flush()
        close()
        if out:
            yield flush()

    placed = flagged.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return placed.mapInArrow(run, f"conv {kind}, {_EDIT}")


def repair_digests(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair_conversations`` (as it returns them: a
    conversation's edits are neighbours, in order): conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256. The rows are folded as they stream by."""
    kind = edits.schema["conv"].dataType.simpleString()
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: _Fold | None = None
        arrow_type = None

        def flush() -> pa.RecordBatch:
            nonlocal done
            kinds = [arrow_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done = []
            return batch

        for b in batches:
            arrow_type = b.schema.field(0).type
            for i in range(b.num_rows):
                conv, _, edit, turn, was, fault, role, text, cost = (b.column(k)[i].as_py() for k in range(9))
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                    now = _Fold(conv)
                if edit is not None:
                    now.add(edit, turn, was, fault, role, text, cost)
                if len(done) >= _BATCH_ROWS:
                    yield flush()
        if now is not None:
            done.append(now.result())
        if done:
            yield flush()

    schema = f"conv {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string"
    return edits.mapInArrow(run, schema)


class _Fold:
    """Running figures of one conversation."""

    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.first = conv, bytearray(), hashlib.sha256(), True
        self.least = self.most = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.initial: str | None = None

    def add(self, edit, turn, was, fault, role, text, cost) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            if turn is not None and turn != self.turn:  # turns come in order
                self.turns += 1
                self.least = turn if self.least is None else self.least
                self.most = self.turn = turn
            if fault:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
        if edit != "D":
            if not self.first:
                self.sha.update(b"\n")
            self.first = False
            self.sha.update(f"{role}:{text}".encode())

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        f = self.faults
        return (self.conv, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def conversation_repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()
) -> DataFrame:
    """One row per conversation of ``rows`` after test damage and repair: ``conv_col``, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null conversations are one conversation with a null id; null turns come first and have no gaps;
    rows of one turn are read by role, then text. Repeated rows are duplicates. An empty table gives
    an empty result; other columns, whatever their names, are ignored."""
    edits = repair_conversations(damaged(rows, conv_col, turn_col, role_col, text_col), costs)
    return repair_digests(edits).withColumnRenamed("conv", conv_col)


def oracle_sql() -> str:
    """The query on ``conversations`` in SQL: CRC-32 bit by bit, one recursion step per row that holds
    the best (cost, audit, text) per state; the least such struct wins."""
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(key) + 1), "
        "lambda i: list_transform(range(8), lambda b: (ascii(substr(key, i, 1)) >> b) & 1)))), "
        "lambda crc, bit: xor(crc >> 1, CASE WHEN (xor(crc, bit) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    )

    def put(state: int, letter: str, cost: str, line: str | None) -> str:
        text = f"s{state}.t" if line is None else f"CASE WHEN s{state}.t IS NULL THEN {line} ELSE s{state}.t || chr(10) || {line} END"
        return f"CASE WHEN s{state} IS NOT NULL THEN {{'c': s{state}.c + {cost}, 'a': s{state}.a || '{letter}', 't': {text}}} END"

    kept, made = "role || ':' || text", "'{}:' || text"
    costs = Costs()
    worse = f"CASE WHEN fault = 'truncated' THEN {costs.truncated} ELSE 0 END"

    def may(expr: str, cond: str = "true") -> str:
        return f"CASE WHEN NOT must AND {cond} THEN {expr} END"

    into = {
        START: [put(START, "D", str(costs.delete), None)],
        SYSTEM: [put(SYSTEM, "D", str(costs.delete), None), may(put(START, "K", f"{costs.keep} + {worse}", kept), "ini = 's'")],
        USER: [put(USER, "D", str(costs.delete), None)],
        ASSISTANT: [put(ASSISTANT, "D", str(costs.delete), None)],
    }
    for a in (START, SYSTEM, ASSISTANT):
        into[USER].append(may(put(a, "K", f"{costs.keep} + {worse}", kept), "ini = 'u'"))
        into[USER].append(may(put(a, "R", f"{costs.rerole} + {worse}", made.format("user"))))
    into[ASSISTANT].append(may(put(USER, "K", f"{costs.keep} + {worse}", kept), "ini = 'a'"))
    into[ASSISTANT].append(may(put(USER, "R", f"{costs.rerole} + {worse}", made.format("assistant"))))
    # inserts in front of a row: the state they start from is read through an insert first
    said = {USER: "'user:'", ASSISTANT: "'assistant:'"}
    opened = {s: [f"s{s}"] for s in range(4)}
    opened[USER] += [put(a, "I", str(costs.insert), said[USER]) for a in (START, SYSTEM, ASSISTANT)]
    opened[ASSISTANT] += [put(USER, "I", str(costs.insert), said[ASSISTANT])]
    least = lambda xs: f"list_min(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
    pre = ", ".join(f"{least(opened[s])} AS s{s}" for s in range(4))
    post = ", ".join(f"{least(into[s])} AS s{s}" for s in range(4))
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS MATERIALIZED (SELECT key, {crc} % 20 AS kind FROM (SELECT DISTINCT key FROM raw)),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw JOIN kinds USING (key) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM hurt),
marked AS MATERIALIZED (
  SELECT conv_id, turn, role, text, n, role[1:1] AS ini,
         CASE WHEN said = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(said, '[.!?]$') OR said LIKE '%' || chr(10) THEN 'truncated' ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) AS prev
  FROM placed),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
  FROM marked GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
step AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 't': NULL::VARCHAR}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s1,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s3 FROM ids
  UNION ALL
  SELECT conv_id, n, {post}
  FROM (SELECT o.conv_id, m.n, m.role, m.text, m.ini, m.fault, m.fault IN ('blank', 'duplicate') AS must, s0, s1, s2, s3
        FROM (SELECT conv_id, n, {pre} FROM step) o JOIN marked m ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.n = o.n + 1)
),
ends AS (
  SELECT conv_id, n, {least(["s0", "s3", put(USER, "I", str(costs.insert), said[ASSISTANT])])} AS best FROM step)
SELECT i.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
       coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, e.best.c::BIGINT AS cost,
       e.best.a AS audit, sha256(coalesce(e.best.t, '')) AS repaired_sha256
FROM ids i LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id AND e.n = coalesce(f.last, 0)
"""
