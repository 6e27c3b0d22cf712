"""Repair of conversation structure: the cheapest edits that make roles alternate.

A conversation's rows and the states of the pattern of roles span a lattice: node (i, q) stands for i rows read and the
pattern in state q; keeping, relabelling or deleting a row leads to (i + 1, .), inserting a row to (i, .). Dijkstra's
search runs from both ends, on two heaps. It goes on until no path through unsettled nodes can be as cheap as the best
crossing, so all equally cheap crossings are known, and takes the one whose two halves make the least audit.

Conversations of ordinary length are repaired where their rows meet. A longer one is never brought together: its rows are
dealt out in order, cut into segments, and a segment is searched from every state to every state. These tables compose
as rows do, so the same search over segments finds the path, and each segment then renders its own part of the text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.workers import map_batches
from workforce_signals.plans.stored import store

# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Rows and bytes beyond which a conversation is dealt out, and those of one segment.
LONG, LONG_BYTES = 1_000, 16 << 20
SEGMENT, SEGMENT_BYTES = 256, 1 << 20
# Tables composed at once.
FAN = 16

# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. The first and the last may end it.
STATES, ENDS = (0, 1, 2, 3), (0, 3)
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# A row made by relabelling or inserting takes the only role that may follow.
_MADE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
_LEGAL = {"su", "ua", "au"}

_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"

Edge = tuple[int, int, int, str]  # from state, to state, cost, audit


def edges_of(deleted: int, initial: str = "", truncated: bool = False) -> list[Edge]:
    """Edges over one row, or over ``deleted`` rows in a run that can only be deleted.

    An insertion within such a run would only move an I before a D, which is never the least audit.
    """
    if deleted:
        return [(q, q, DELETE * deleted, "D" * deleted) for q in STATES]
    more = TRUNCATED if truncated else 0
    found = [(q, q, DELETE, "D") for q in STATES]
    found += [(q, to, more, "K") for q, to in _KEEP.get(initial, {}).items()]
    return found + [(q, to, REROLE + more, "R") for q, (to, _) in _MADE.items()]


def search(columns: list[list[Edge]], start: int, goals: tuple[int, ...], inserts: bool = True):
    """(cost, audit, states before every column and at the end) of the cheapest path, of several the one with the least audit."""
    n = len(columns)
    into = [{}, {}]  # edges by column and state: forward, reverse
    for i, edges in enumerate(columns):
        for a, b, cost, audit in edges:
            into[0].setdefault((i, a), []).append((i + 1, b, cost, audit))
            into[1].setdefault((i + 1, b), []).append((i, a, cost, audit))
    labels = [{(0, start): (0, "")}, {(n, q): (0, "") for q in goals}]
    via: list[dict] = [{}, {}]
    heaps, done, best = [[(0, 0, start)], [(0, 0, q) for q in goals]], [set(), set()], None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, step, q = heapq.heappop(heaps[side])
        here = (step, q) if side == 0 else (n - step, q)
        if here in done[side]:
            continue
        done[side].add(here)
        audit, mine, other, heap = labels[side][here][1], labels[side], labels[1 - side], heaps[side]
        around = into[side].get(here, ())
        if inserts:
            near = [_MADE[q][0]] if side == 0 else [p for p in STATES if _MADE[p][0] == q]
            around = [*around, *((here[0], p, INSERT, "I") for p in near)]
        for i, p, more, piece in around:
            node, label = (i, p), (cost + more, audit + piece if side == 0 else piece + audit)
            # Edges without cost lead to the next column, so nodes of one cost are settled in the order of their columns,
            # and a label cannot improve once its node is settled.
            if node not in mine or label < mine[node]:
                if node not in mine or label[0] < mine[node][0]:
                    heapq.heappush(heap, (label[0], i if side == 0 else n - i, p))
                mine[node], via[side][node] = label, here
                if node in other and (best is None or label[0] + other[node][0] < best):
                    best = label[0] + other[node][0]
        if here in other and (best is None or cost + other[here][0] < best):
            best = cost + other[here][0]
    if best is None:
        return None
    cost, audit, node = min((c + labels[1][v][0], a + labels[1][v][1], v) for v, (c, a) in labels[0].items() if v in labels[1])
    path = [node]
    while path[0] in via[0]:
        path.insert(0, via[0][path[0]])
    while path[-1] in via[1]:
        path.append(via[1][path[-1]])
    states = dict(path)  # inserts stay in a column: its row is read from the last node there
    return cost, audit, [states[i] for i in range(n + 1)]


Table = dict[tuple[int, int], tuple[int, str]]


def table_of(columns: list[list[Edge]], inserts: bool = True) -> Table:
    """(cost, audit) from every state to every state that can be reached."""
    found = {(a, b): search(columns, a, (b,), inserts) for a in STATES for b in STATES}
    return {k: v[:2] for k, v in found.items() if v is not None}


def _as_column(table: Table) -> list[Edge]:
    return [(a, b, cost, audit) for (a, b), (cost, audit) in table.items()]


def compose(tables: list[Table]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cheapest cost, least audit, and for every segment the state it is entered in and its part of the audit."""
    levels = [tables]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([table_of([_as_column(t) for t in last[i : i + FAN]], False) for i in range(0, len(last), FAN)])
    cost, audit, states = search([_as_column(levels[-1][0])], 0, ENDS, False)
    chosen = [(states[0], states[1])]
    for below in reversed(levels[:-1]):
        finer = []
        for k, (a, b) in enumerate(chosen):
            _, _, states = search([_as_column(t) for t in below[k * FAN : (k + 1) * FAN]], a, (b,), False)
            finer += zip(states[:-1], states[1:], strict=True)
        chosen = finer
    return cost, audit, [(a, table[a, b][1]) for table, (a, b) in zip(tables, chosen, strict=True)]


def rendered(rows: list[tuple[int, str, str]], state: int, audit: str) -> list[str]:
    """Lines ``role:text`` after the edits, from columns (deleted rows, role, text)."""
    lines, p = [], 0
    for deleted, role, text in [*rows, (0, "", "")]:
        while p < len(audit) and audit[p] == "I":
            state, made = _MADE[state]
            lines.append(f"{made}:")
            p += 1
        if p == len(audit):
            break
        if deleted or audit[p] == "D":
            p += max(deleted, 1)
            continue
        if audit[p] == "R":
            state, role = _MADE[state]
        else:
            state = _KEEP[role[:1]][state]
        lines.append(f"{role}:{text}")
        p += 1
    return lines


class Faults:
    """Counts over the rows of a conversation or segment in order, and its columns for the search."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.bytes = self.rows = 0
        self.first = self.last = None  # initials
        self.first_turn = self.last_turn = None  # of rows that have one
        self.turns = 0
        self.columns: list[tuple[int, str, str, bool]] = []

    def add(self, turn, role: str, text: str, copies: int, new: bool) -> None:
        """``copies`` equal rows, of which the first is ``new`` unless an equal role and text came before."""
        initial = role[:1]
        self.illegal += copies - 1 + (self.rows > 0 and self.last + initial not in _LEGAL)
        self.first, self.last = (initial if self.rows == 0 else self.first), initial
        self.rows += copies
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = (turn if self.first_turn is None else self.first_turn), turn
        if not _SEEN.search(text):
            self.blank += copies
            self._delete(copies)
            return
        if new:
            cut = text.rstrip(_BLANKS)[-1] not in ".!?"
            self.truncated += cut
            self.columns.append((0, role, text, cut))
            self.bytes += len(text)
        self.duplicate += copies - new
        self._delete(copies - new)

    def _delete(self, n: int) -> None:
        if n and self.columns and self.columns[-1][0]:
            self.columns[-1] = (self.columns[-1][0] + n, "", "", False)
        elif n:
            self.columns.append((n, "", "", False))

    @property
    def lattice(self) -> list[list[Edge]]:
        return [edges_of(n, role[:1], cut) for n, role, _, cut in self.columns]

    @property
    def plain(self) -> list[tuple[int, str, str]]:
        return [c[:3] for c in self.columns]


def _gaps(first, last, turns: int) -> int:
    return last - first + 1 - turns if turns else 0


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id {key}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _result_schema(key: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in _COUNTS]
    return pa.schema([("conv_id", key), *counts, ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows with, first, whether they begin another conversation than the row before."""
    before, started = None, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (not started or row[0] != before), row
            before, started = row[0], True


def _repair(key: pa.DataType):
    """Whole conversations, sorted: rows (conv_id, turn, role, text, copies)."""
    schema = _result_schema(key)

    def finish(conv, faults: Faults) -> tuple:
        cost, audit, _ = search(faults.lattice, 0, ENDS)
        digest = hashlib.sha256("\n".join(rendered(faults.plain, 0, audit)).encode("utf-8")).hexdigest()
        gaps = _gaps(faults.first_turn, faults.last_turn, faults.turns)
        return conv, gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, faults, seen = [], None, None, set()
        for begins, (of, turn, role, text, copies) in _by_conversation(batches):
            if begins:
                if faults is not None:
                    out.append(finish(conv, faults))
                if len(out) >= 4096:
                    yield _batch(out, schema)
                    out = []
                conv, faults, seen = of, Faults(), set()
            if copies:
                faults.add(turn, role, text, copies, (role, text) not in seen)
                seen.add((role, text))
        if faults is not None:
            out.append(finish(conv, faults))
        yield _batch(out, schema)

    return run


_INSIDE = "first string, last string, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_SEGMENT = "conv_id {key}, part int, seq bigint, " + _INSIDE + ", pairs array<int>, costs array<bigint>, audits array<string>, deleted array<bigint>, roles array<string>, texts array<string>"


def _segments(key: pa.DataType):
    """Segments with their tables: rows (conv_id, turn, role, text, copies, new, part) in order."""
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    schema = pa.schema(
        [("conv_id", key), ("part", pa.int32()), ("seq", pa.int64()), ("first", pa.string()), ("last", pa.string())]
        + [(c, pa.int64()) for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")]
        + [("pairs", pa.list_(pa.int32())), ("costs", longs), ("audits", texts), ("deleted", longs), ("roles", texts), ("texts", texts)]
    )

    def finish(conv, part: int, seq: int, f: Faults) -> pa.RecordBatch:
        table = sorted(table_of(f.lattice).items())
        row = (conv, part, seq, f.first, f.last, f.first_turn, f.last_turn, f.turns, f.blank, f.duplicate, f.truncated, f.illegal)
        row += ([a * 4 + b for (a, b), _ in table], [c for _, (c, _) in table], [s for _, (_, s) in table])
        return _batch([(*row, *([c[k] for c in f.columns] for k in range(3)))], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, seq, faults = None, 0, 0, None
        for begins, (of, turn, role, text, copies, new, at) in _by_conversation(batches):
            if begins or len(faults.columns) >= SEGMENT or faults.bytes >= SEGMENT_BYTES:
                if faults is not None:
                    yield finish(conv, part, seq, faults)
                conv, part, seq, faults = of, at, seq + 1, Faults()
            faults.add(turn, role, text, copies, new)
        if faults is not None:
            yield finish(conv, part, seq, faults)

    return run


_CHOSEN = "conv_id {key}, part int, seq bigint, state int, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string"


def _compose(key: pa.DataType):
    """From the tables of conversations' segments, in order: a row of results each (part -1), and every segment's part of the audit."""
    schema = pa.schema(
        [("conv_id", key), ("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int32())]
        + [(c, pa.int64()) for c in _COUNTS]
        + [("audit", pa.string())]
    )

    def finish(conv, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        tables = [{divmod(p, 4): (c, a) for p, c, a in zip(*r[12:15], strict=True)} for r in rows]
        cost, audit, parts = compose(tables)
        turns, last_turn, first_turn = 0, None, None
        for r in rows:
            if r[7]:
                turns += r[7] - (r[5] == last_turn)
                first_turn, last_turn = (r[5] if first_turn is None else first_turn), r[6]
        illegal = sum(r[11] for r in rows) + sum(a[4] + b[3] not in _LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True))
        sums = [sum(r[k] for r in rows) for k in (8, 9, 10)]
        yield _batch([(conv, -1, 0, 0, _gaps(first_turn, last_turn, turns), *sums, illegal, cost, audit)], schema)
        none = [None] * len(_COUNTS)
        out = [(conv, r[1], r[2], state, *none, piece) for r, (state, piece) in zip(rows, parts, strict=True)]
        for i in range(0, len(out), 1024):
            yield _batch(out[i : i + 1024], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for begins, row in _by_conversation(batches):
            if begins and rows:
                yield from finish(rows[0][0], rows)
                rows = []
            rows.append(row)
        if rows:
            yield from finish(rows[0][0], rows)

    return run


def _render(key: pa.DataType):
    schema = pa.schema([("conv_id", key), ("part", pa.int32()), ("seq", pa.int64()), ("lines", pa.int64()), ("rendered", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, seq, state, audit, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = rendered(list(zip(*columns, strict=True)), state, audit)
                yield _batch([(conv, part, seq, len(lines), "\n".join(lines))], schema)

    return run


def _digest(key: pa.DataType):
    """Hashes the rendered segments of a conversation one after the other; its row of results comes first."""
    schema = _result_schema(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, any_line = None, None, False
        for begins, row in _by_conversation(batches):
            if begins:
                if head is not None:
                    yield _batch([(*head, digest.hexdigest())], schema)
                head, digest, any_line = (row[0], *row[5:]), hashlib.sha256(), False
            elif row[3]:
                digest.update((("\n" if any_line else "") + row[4]).encode("utf-8"))
                any_line = True
        if head is not None:
            yield _batch([(*head, digest.hexdigest())], schema)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of every row of ``rows`` after damage; 0 copies, without role and text, if dropped.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the
    row, 4 makes its role user. NULLs count as one space in that text, in roles and in texts.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    # Fixed values: the kinds of damage.
    kind = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(spaced["text"], "[.!?]", "")).otherwise(spaced["text"])
    role = F.when(kind == 4, F.lit("user")).otherwise(spaced["role"])
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind != 0, role).alias("role"),
        F.when(kind != 0, text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """A row (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation.

    ``rows`` holds (conv_id, turn, role, text, copies): that many equal rows; 0 stands for a conversation that may have
    none, whose counts are 0 and whose audit is empty. Rows come in the order of their turns, NULL first, ties by role, then
    by the hash of the text. NULL is a conversation like others. Roles other than those beginning with s, u or a can only
    be relabelled or deleted. Other columns are ignored, whatever their names.

    Conversations of more than LONG rows are not brought together. By contract their audit is one value, which one task
    composes from 16 bytes a row and level, and their hash is one over all lines, which one task reads in pieces; their
    texts are otherwise spread over all tasks, also where a conversation holds most rows or one role and text most of them.
    """
    spark = rows.sparkSession
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = pa.from_numpy_dtype("int64") if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("conv_id", F.col("conv_id").cast("string")), "string"
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) * F.col("copies"))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), size.alias("bytes"))
    long = store(sizes.where((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("_long")), "conversations-long")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = rows if long.is_empty else rows.join(long.for_join(), same, "left_anti")
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    repaired = map_batches(short, _repair(key), _RESULT.format(key=kind))
    if long.is_empty:
        return repaired
    some = rows.where("copies > 0").join(long.for_join(), same, "left_semi")
    # Equal rows become one, and of an equal role and text the first is told from the others, before rows are put in order.
    some = store(some.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "conversations-rows").df
    firsts = some.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t"))
    firsts = firsts.agg(F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_none"))
    here = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t"))
    new = F.when(F.col("_none"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_first"))
    some = some.join(firsts, here).select("conv_id", "turn", "role", "text", "copies", new.alias("new"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = some.repartitionByRange(tasks, F.col("conv_id"), *order).sortWithinPartitions("conv_id", *order)
    some = some.withColumn("part", F.spark_partition_id())
    segments = store(map_batches(some, _segments(key), _SEGMENT.format(key=kind)), "conversations-segments").df
    tables = segments.drop("deleted", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    chosen = store(map_batches(tables, _compose(key), _CHOSEN.format(key=kind)), "conversations-chosen").df
    parts = segments.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "deleted", "roles", "texts")
    parts = chosen.where("part >= 0").join(parts, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")))
    parts = parts.select("conv_id", "part", "seq", "state", "audit", "deleted", "roles", "texts")
    lines = map_batches(parts, _render(key), f"conv_id {kind}, part int, seq bigint, lines bigint, rendered string")
    heads = chosen.where("part < 0").select("conv_id", "part", "seq", *_COUNTS, "audit")
    both = lines.unionByName(heads, allowMissingColumns=True).select("conv_id", "part", "seq", "lines", "rendered", *_COUNTS, "audit")
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return repaired.unionByName(map_batches(both, _digest(key), _RESULT.format(key=kind)))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows of a conversation table; one row for every conversation of it, dropped rows or not."""
    return repair(damaged(conversations))


def oracle_sql() -> str:
    """The same rows in DuckDB: row by row, the least (cost, audit) of every state of the pattern, with the lines made so far."""
    state = "STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[])"

    def least(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"

    def step(q: int, cost: str, edit: str, said: str = "", when: str = "true", of: str = "a.s") -> str:
        lines = f"list_append({of}[{q + 1}].said, {said})" if said else f"{of}[{q + 1}].said"
        put = f"{{'cost': {of}[{q + 1}].cost + {cost}, 'audit': {of}[{q + 1}].audit || '{edit}', 'said': {lines}}}"
        return f"CASE WHEN {of}[{q + 1}] IS NOT NULL AND {when} THEN {put} END"

    def inserted(q: int, role: str, of: str) -> str:
        return step(q, "2", "I", f"'{role}:'", of=of)

    def closed(states: str) -> str:
        """States that insertions reach as well: user after 0, 1 and 3, assistant after user."""
        user = least(f"{states}[3]", *(inserted(q, "user", states) for q in (0, 1, 3)))
        both = f"[{states}[1], {states}[2], {user}, {states}[4]]"
        return f"list_transform([{both}], lambda u: [u[1], u[2], u[3], {least('u[4]', inserted(2, 'assistant', 'u'))}])[1]"

    free, extra = "x.fault NOT IN ('blank', 'duplicate')", "(x.fault = 'truncated')::BIGINT"
    line, initial = "x.role || ':' || x.text", "x.role[1]"

    def reached(to: int) -> str:
        ways = [step(to, "3", "D")]
        for begins, moves in _KEEP.items():
            ways += [step(q, extra, "K", line, f"{free} AND {initial} = '{begins}'") for q, end in moves.items() if end == to]
        ways += [step(q, f"2 + {extra}", "R", f"'{role}:' || x.text", free) for q, (end, role) in _MADE.items() if end == to]
        return least(*ways)

    nothing = f"NULL::{state}"
    begin = f"[{{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}}, {nothing}, {nothing}, {nothing}]"
    after = f"list_transform([[{', '.join(reached(q) for q in STATES)}]], lambda r: {closed('r')})[1]"
    return rf"""
WITH bits AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda h: ord(h)::BIGINT)),
        lambda c, h: xor(c >> 8, t[(xor(c, h) & 255) + 1]))) % 20 AS kind
    FROM conversations, bits
), rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM rows
), judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
        WHEN regexp_extract(text, '([^ 	-])[ 	-]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair
    FROM placed
), folded AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'role': role, 'text': text, 'fault': fault, 's': NULL::{state}[]}} ORDER BY n) AS rows
    FROM judged GROUP BY conv_id
), ends AS (
    SELECT * EXCLUDE (rows), list_reduce(list_prepend(
        {{'role': '', 'text': '', 'fault': '', 's': list_transform([{begin}], lambda r: {closed('r')})[1]}}, rows),
        lambda a, x: {{'role': '', 'text': '', 'fault': '', 's': {after}}}).s AS s
    FROM folded
), best AS (
    SELECT * EXCLUDE (s), list_sort(list_filter([s[1], s[4]], lambda o: o IS NOT NULL))[1] AS b FROM ends
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
    sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id
"""
