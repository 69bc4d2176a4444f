"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation's role initials are ``(s?(ua)+)?``. Its rows are edited
in order: K keeps a row, R gives it the role that is due, D deletes it, I
inserts an empty row of the role that is due. The edits form a lattice of (rows
read, last role written); A* walks it by (cost so far + heuristic, edits so far),
the heuristic being the suffix sums of what cannot be avoided: deleting blank
and repeated rows, and the charge on cut-off ones. It never exceeds the true
rest and shrinks by no more than an edit costs, so the first goal reached has
the least cost and, among those, the least edits in ASCII order.

Rows are sorted by range of (conversation, turn, role, text), so a conversation
of any size is spread over tasks. One that lies within a partition is solved
there. Those at a partition's edge, or longer than BLOCK_ROWS, are solved in
blocks: each gives the least (cost, edits) from every state to every state, and
blocks are chained in order, a path being given out as soon as all states agree
on it. Only the digest of a repaired text runs through it in one task, row
after row, because SHA-256 cannot be put together from parts.

Results at the edges: a null role or text counts as one space, a null turn comes
first and is no turn for the gaps; a null conversation id is a conversation;
equal turns are ordered by role, then text; rows that are wholly equal are
repeats; a conversation without rows left has zeros, no edits and the digest of
the empty text; very long texts are carried once through the sort and never
cut; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, read_table, small_side

#: Rows of one conversation that are solved together.
BLOCK_ROWS = 512

BLANKS = " \t\n\x0b\x0c\r"

#: Faults of a row.
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3

#: States: nothing written yet, or the last initial written.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
STATES = (START, SYSTEM, USER, ASSISTANT)
#: What may be kept in each state, and the role due there with the state after it.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
DUE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ENDS = (START, ASSISTANT)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults put in by a hash of conversation and turn; ``gone`` marks those to be dropped.

    Of 20 hashes 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3
    repeats the row, 4 makes its role user.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    fate = F.crc32(F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    new_text = F.when(fate <= 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"), new_text.alias("text"),
        (fate == 0).alias("gone"), F.explode(times).alias("copy"),
    ).drop("copy")


def fault(text: Column, repeated: Column) -> Column:
    """The first fault of a row."""
    end = F.rtrim(text, F.lit(BLANKS))
    return F.when(end == "", BLANK).when(repeated, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)


def marked(rows: DataFrame, number: str) -> DataFrame:
    """``rows`` with each live row's fault. Repeats are found by the least place of each (conversation, role, text)."""
    live = rows.filter(~F.col("gone"))
    place = F.struct(F.col("turn"), F.col(number))
    first = live.groupBy("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min(place).alias("first"))
    repeats = live.select(number).join(first.select(F.col(f"first.{number}").alias(number)), number, "left_anti")
    found = rows.join(small_side(repeats.withColumn("repeated", F.lit(True))), number, "left")
    return found.select("conv_id", "turn", "role", "text", "gone", fault(F.col("text"), F.coalesce("repeated", F.lit(False))).alias("fault"))


def unavoidable(faults: list[int]) -> list[int]:
    """Suffix sums of the least charge of each row."""
    out = [0] * (len(faults) + 1)
    for i in range(len(faults) - 1, -1, -1):
        out[i] = out[i + 1] + (3 if faults[i] in (BLANK, DUPLICATE) else 1 if faults[i] == TRUNCATED else 0)
    return out


def search(faults: list[int], initials: list[str], start: int, all_ends: bool) -> dict[int, tuple[int, str]]:
    """(cost, edits) by end state: of the first end in ENDS, or of all states."""
    rest, n = unavoidable(faults), len(faults)
    heap: list[tuple[int, str, int, int]] = [(rest[0], "", 0, start)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while heap:
        total, edits, i, s = heapq.heappop(heap)
        if (i, s) in closed:
            continue
        closed.add((i, s))
        if i == n and (all_ends or s in ENDS):
            found[s] = (total, edits)
            if not all_ends:
                break
        cost = total - rest[i]
        due = DUE[s][1]
        if (i, due) not in closed:
            heapq.heappush(heap, (total + 2, edits + "I", i, due))
        if i == n:
            continue
        after = cost + rest[i + 1]
        heapq.heappush(heap, (after + 3, edits + "D", i + 1, s))
        if faults[i] in (BLANK, DUPLICATE):
            continue
        charge = 1 if faults[i] == TRUNCATED else 0
        heapq.heappush(heap, (after + 2 + charge, edits + "R", i + 1, due))
        to = KEPT[s].get(initials[i])
        if to is not None:
            heapq.heappush(heap, (after + charge, edits + "K", i + 1, to))
    return found


def actions(edits: str, state: int, initials: list[str]) -> tuple[list[tuple[list[str], str | None, bool]], list[str], int]:
    """For each row: roles inserted before it, its role if it is given one, whether it stays; roles inserted at the end; the last state."""
    out: list[tuple[list[str], str | None, bool]] = []
    before: list[str] = []
    for e in edits:
        if e == "I":
            role, state = DUE[state]
            before.append(role)
            continue
        if e == "D":
            out.append((before, None, False))
        elif e == "R":
            role, state = DUE[state]
            out.append((before, role, True))
        else:
            state = KEPT[state][initials[len(out)]]
            out.append((before, None, True))
        before = []
    return out, before, state


class Digest:
    """SHA-256 of lines joined by line feeds, line by line."""

    def __init__(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def add_row(self, before: list[str], role: str | None, stays: bool, row_role: str, row_text: str) -> None:
        for r in before:
            self.add(r, "")
        if stays:
            self.add(role or row_role, row_text)


class Summary:
    """Counts over rows in order; also over blocks in order."""

    def __init__(self) -> None:
        self.least = self.most = self.last_turn = self.first_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.join(turn, turn, turn, turn, int(turn is not None), int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0, initial, initial)

    def join(self, least, most, first_turn, last_turn, turns, blank, duplicate, truncated, illegal, first, last) -> None:
        if first is None:
            return
        if least is not None:
            self.turns += turns - int(self.last_turn is not None and self.last_turn == first_turn)
            self.least = least if self.least is None else min(self.least, least)
            self.most = most if self.most is None else max(self.most, most)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + int(self.last is not None and self.last + first not in ("su", "ua", "au"))
        self.first = first if self.first is None else self.first
        self.last = last

    def values(self) -> list:
        return [self.least, self.most, self.first_turn, self.last_turn, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last]

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


SUMMARY = "least bigint, most bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _blocks(rows: Iterator[tuple], size: int) -> Iterator[tuple[int, object, list[tuple], bool]]:
    """(number, conversation, rows, whole): runs of one conversation, cut at ``size`` rows.

    The first and last run of a partition may go on in another one.
    """
    number, held, ahead = 0, [], None
    runs = groupby(rows, key=lambda r: r[0])
    for n, (conv, members) in enumerate(runs):
        if ahead:
            yield ahead
            ahead = None
        part: list[tuple] = []
        split = False
        for row in members:
            if len(part) == size:
                yield number, conv, part, False
                number, part, split = number + 1, [], True
            part.append(row)
        ahead = (number, conv, part, n > 0 and not split)
        number += 1
    if ahead:
        yield ahead[0], ahead[1], ahead[2], False


def solved(placed: DataFrame, block_rows: int) -> DataFrame:
    """A row for each whole conversation with its result, and for each block of the others with its paths."""
    kind = dict(placed.dtypes)["conv_id"]
    ddl = f"conv_id {kind}, part int, block int, whole boolean, {SUMMARY}, cost bigint, audit string, digest string, initials array<string>, paths array<struct<start:int,end:int,cost:bigint,edits:string>>"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def results() -> Iterator[tuple]:
            for number, conv, rows, whole in _blocks(_rows(batches), block_rows):
                live = [r for r in rows if not r[4]]
                initials, faults = [r[2][:1] for r in live], [r[5] for r in live]
                s = Summary()
                for r, i in zip(live, initials):
                    s.add(r[1], i, r[5])
                if whole:
                    ((cost, edits),) = search(faults, initials, START, False).values()
                    acts, tail, _ = actions(edits, START, initials)
                    d = Digest()
                    for r, act in zip(live, acts):
                        d.add_row(*act, r[2], r[3])
                    d.add_row(tail, None, False, "", "")
                    yield conv, part, number, True, *s.values(), cost, edits, d.sha.hexdigest(), None, None
                else:
                    paths = [{"start": a, "end": b, "cost": c, "edits": e} for a in STATES for b, (c, e) in search(faults, initials, a, True).items()]
                    yield conv, part, number, False, *s.values(), None, None, None, initials, paths

        yield from _batches(results(), schema)

    return placed.mapInArrow(run, ddl)


class Chain:
    """Blocks of one conversation in order: the best path to each state, given out as far as all states agree."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}
        self.open: list[tuple[object, dict[int, tuple[int, str]]]] = []  # block, then by its end: start and edits
        self.spent: list[str] = []

    def add(self, block: object, paths: list[dict]) -> Iterator[tuple]:
        """Take one more block; gives (block, start state, edits) of those that are settled."""
        best: dict[int, tuple[int, str]] = {}
        via: dict[int, tuple[int, str]] = {}
        for p in paths:
            if p["start"] in self.best:
                cost, edits = self.best[p["start"]]
                key = (cost + p["cost"], edits + p["edits"])
                if p["end"] not in best or key < best[p["end"]]:
                    best[p["end"]], via[p["end"]] = key, (p["start"], p["edits"])
        self.best = best
        self.open.append((block, via))
        states, at = set(best), len(self.open)
        while at and len(states) > 1:
            at -= 1
            states = {self.open[at][1][s][0] for s in states}
        if at < len(self.open) and len(states) == 1:
            yield from self._settle(at, states.pop())

    def _settle(self, upto: int, state: int) -> Iterator[tuple]:
        """Give out the first ``upto`` blocks, on the path that ends in ``state``."""
        done = []
        for block, via in reversed(self.open[:upto]):
            start, edits = via[state]
            done.append((block, start, edits))
            state = start
        self.open = self.open[upto:]
        size = sum(len(e) for _, _, e in done)
        self.best = {s: (c, e[size:]) for s, (c, e) in self.best.items()}
        self.spent += [e for _, _, e in reversed(done)]
        yield from reversed(done)

    def end(self) -> Iterator[tuple]:
        """Settle the rest, on the best path to an end."""
        _, state = min((self.best[s], s) for s in ENDS if s in self.best)
        self.cost = self.best[state][0]
        yield from self._settle(len(self.open), state)


def chained(open_blocks: DataFrame) -> DataFrame:
    """For each row of a conversation in blocks what is done to it; then, with ``at`` null, the conversation's counts, cost and edits."""
    kind = dict(open_blocks.dtypes)["conv_id"]
    ddl = f"conv_id {kind}, part int, block int, at int, before array<string>, new_role string, stays boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv, blocks in groupby(_rows(batches), key=lambda r: r[0]):
                chain, s = Chain(), Summary()

                def told(done: Iterator[tuple]) -> Iterator[tuple]:
                    for (part, block, initials), start, edits in done:
                        acts, tail, _ = actions(edits, start, initials)
                        for at, (before, role, stays) in enumerate(acts):
                            yield conv, part, block, at, before, role, stays, *[None] * 7
                        if tail:
                            yield conv, part, block, len(acts), tail, None, False, *[None] * 7

                for _, part, block, *rest in blocks:
                    s.join(*rest[:11])
                    yield from told(chain.add((part, block, rest[11]), rest[12]))
                yield from told(chain.end())
                yield conv, None, None, None, None, None, None, s.gaps(), s.blank, s.duplicate, s.truncated, s.illegal, chain.cost, "".join(chain.spent)

        yield from _batches(results(), schema)

    names = ["conv_id", "part", "block", *(c.split(" ")[0] for c in SUMMARY.split(", ")), "initials", "paths"]
    return open_blocks.select(names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, ddl)


def open_rows(placed: DataFrame, block_rows: int) -> DataFrame:
    """Live rows of the conversations in blocks: part, block, at, role, text."""
    ddl = "part int, block int, at int, role string, text string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def results() -> Iterator[tuple]:
            for number, _, rows, whole in _blocks(_rows(batches), block_rows):
                if not whole:
                    for at, r in enumerate(r for r in rows if not r[4]):
                        yield part, number, at, r[2], r[3]

        yield from _batches(results(), schema)

    return placed.mapInArrow(run, ddl)


def digests(told: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations in blocks, rows in order through one digest."""
    kind = dict(told.dtypes)["conv_id"]
    ddl = f"conv_id {kind}, repaired_sha256 string"
    full = told.select("conv_id", "part", "block", "at", "before", "new_role", "stays").join(rows, ["part", "block", "at"], "left")
    names = ["conv_id", "part", "block", "at", "before", "new_role", "stays", "role", "text"]
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv, members in groupby(_rows(batches), key=lambda r: r[0]):
                d = Digest()
                for r in members:
                    if r[3] is not None:
                        d.add_row(r[4], r[5], r[6], r[7], r[8])
                yield conv, d.sha.hexdigest()

        yield from _batches(results(), schema)

    return full.select(names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "at").mapInArrow(run, ddl)


def repair(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, and its cheapest repair.

    ``df`` has (conv_id, turn, role, text) and ``gone``, true for rows that
    don't count but whose conversation does.
    """
    rows, number = numbered(df.select("conv_id", "turn", "role", "text", "gone"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = cut(marked(rows, number).repartitionByRange(*order).sortWithinPartitions(*order))
    blocks = cut(solved(placed, block_rows))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    whole = blocks.filter("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    told = cut(chained(blocks.filter("NOT whole")))
    found = told.filter("at IS NULL").drop("part", "block", "at", "before", "new_role", "stays")
    hashed = digests(told, open_rows(placed, block_rows)).withColumnRenamed("conv_id", "__conv")
    pieced = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", *RESULT)
    return whole.select("conv_id", *RESULT).unionByName(pieced)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all conversations, damaged by hash and repaired."""
    return repair(damage(read_table(spark, sf_dir, "conversations")))


#: The same by a recursive table over (rows read, last initial), with crc32 bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::UBIGINT)), lambda acc, b:
                      list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 20 AS fate FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS tail FROM d),
m AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(tail, '[.!?]$') THEN 3 ELSE 0 END AS fault,
             substr(role, 1, 1) AS initial, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) AS before FROM o),
-- the cheapest edits that read i rows and end in a state: 0 nothing written, else the last initial
r AS (SELECT conv_id, 0::BIGINT AS i, '0' AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM (SELECT DISTINCT conv_id FROM m)
      UNION ALL
      (SELECT conv_id, i, s, cost, audit, said FROM (
         SELECT e.conv_id, m.i,
                CASE a.edit WHEN 'D' THEN e.here WHEN 'K' THEN m.initial ELSE e.due END AS s,
                e.cost + CASE a.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN a.edit <> 'D' AND m.fault = 3 THEN 1 ELSE 0 END AS cost,
                e.audit || a.edit AS audit,
                CASE a.edit WHEN 'D' THEN e.said WHEN 'K' THEN list_append(e.said, m.role || ':' || m.text)
                            ELSE list_append(e.said, CASE e.due WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text) END AS said
         FROM (SELECT *, CASE WHEN here = 'u' THEN 'a' ELSE 'u' END AS due FROM (
                 SELECT conv_id, i, cost + 2 * n AS cost, audit || repeat('I', n) AS audit,
                        CASE WHEN n = 0 THEN s WHEN (s = 'u') = (n = 1) THEN 'a' ELSE 'u' END AS here,
                        CASE n WHEN 0 THEN said WHEN 1 THEN list_append(said, CASE WHEN s = 'u' THEN 'assistant:' ELSE 'user:' END)
                               ELSE said || CASE WHEN s = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END AS said
                 FROM r, unnest([0, 1, 2]) AS u(n))) e
         JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i + 1
         JOIN (VALUES ('K'), ('R'), ('D')) AS a(edit)
           ON a.edit = 'D' OR m.fault NOT IN (1, 2) AND (a.edit = 'R' OR m.initial = e.due OR e.here = '0' AND m.initial = 's'))
       QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1)),
ended AS (SELECT r.conv_id, cost + 2 * n AS cost, audit || repeat('I', n) AS audit,
                 CASE n WHEN 0 THEN said WHEN 1 THEN list_append(said, 'assistant:') ELSE said || ['user:', 'assistant:'] END AS said
          FROM r JOIN (SELECT conv_id, max(i) AS last FROM m GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = z.last,
               unnest(CASE s WHEN 'u' THEN [1] WHEN 's' THEN [2] ELSE [0] END) AS u(n)),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""
