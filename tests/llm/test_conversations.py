import hashlib
import itertools
import random
import re
import zlib

import pytest
from compare import difference, duck
from fixtures_llm import SF, needs_tables

from workforce_signals.llm import conversations as c
from workforce_signals.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """The damage by the letter, row by row."""
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def faults(rows):
    seen = set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def all_edits(rows, found, most_inserts):
    """Every sequence of edits with at most so many inserts before each row: (cost, audit, lines)."""
    inserted = [list(p) for n in range(most_inserts + 1) for p in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        extra = fault == "truncated"
        one = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            one += [(extra, "K", (role, text))] + [(2 + extra, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(one)
    for edits in itertools.product(*choices):
        for more in itertools.product(inserted, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                cost, audit = cost + 2 * len(more[i]), audit + "I" * len(more[i])
                lines += [(r, "") for r in more[i]]
                if i < len(rows):
                    cost, audit = cost + edits[i][0], audit + edits[i][1]
                    lines += [edits[i][2]] if edits[i][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                yield cost, audit, lines


def by_rows(rows, found):
    """Cheapest edits by going through the rows: for every state the least (cost, audit) and its lines."""
    keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    made = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def filled(best):
        for _ in range(4):
            for q, (to, role) in made.items():
                if q in best:
                    cost, audit, lines = best[q]
                    best[to] = min(best.get(to, (10**9, "", [])), (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return best

    now = filled({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, found, strict=True):
        then = {}

        def put(q, value, then=then):
            then[q] = min(then.get(q, value), value)

        extra = int(fault == "truncated")
        for q, (cost, audit, lines) in now.items():
            put(q, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                if q in keep.get(role[:1], {}):
                    put(keep[role[:1]][q], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                put(made[q][0], (cost + 2 + extra, audit + "R", [*lines, f"{made[q][1]}:{text}"]))
        now = filled(then)
    return min(now[q] for q in (0, 3) if q in now)


def expected(table):
    out = []
    key = lambda t: (t is not None, t or 0)
    for conv in {r[0] for r in table}:
        rows = sorted(damage([r for r in table if r[0] == conv]), key=lambda r: key(r[0]))
        found = list(faults(rows))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows[:-1], rows[1:], strict=True)] if rows else []
        cost, audit, lines = by_rows(rows, found)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=lambda r: key(r[0]))


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def columns_of(rows, found):
    return [c.edges_of(int(f in ("blank", "duplicate")), r[1][:1], f == "truncated") for r, f in zip(rows, found, strict=True)]


def random_rows(rng, n):
    return [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", " ", "a.", "b", "c!", "d?\n"])) for i in range(n)]


def test_search_against_every_sequence_of_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(4))
        found = list(faults(rows))
        cost, audit, lines = min(all_edits(rows, found, 2 if len(rows) < 3 else 1), key=lambda e: e[:2])
        if len(rows) == 3 and by_rows(rows, found)[:2] != (cost, audit):
            continue  # two inserts in one place were needed
        assert c.search(columns_of(rows, found), 0, c.ENDS)[:2] == (cost, audit)
        plain = [(int(f in ("blank", "duplicate")), r[1], r[2]) for r, f in zip(rows, found, strict=True)]
        assert c.rendered(plain, 0, audit) == [f"{r}:{t}" for r, t in lines]


@pytest.mark.parametrize("size", [1, 5, 40, 300])
def test_search_and_composition_against_rows_in_turn(size):
    rng = random.Random(size)
    for _ in range(max(2, 200 // size)):
        rows = random_rows(rng, size)
        found = list(faults(rows))
        cost, audit, lines = by_rows(rows, found)
        columns = columns_of(rows, found)
        assert c.search(columns, 0, c.ENDS)[:2] == (cost, audit)
        cuts = sorted({0, size, *(rng.randrange(size + 1) for _ in range(20))})
        parts = [columns[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        total, whole, pieces = c.compose([c.table_of(p) for p in parts])
        assert (total, whole) == (cost, audit) and "".join(p for _, p in pieces) == audit
        plain, out = [(int(f in ("blank", "duplicate")), r[1], r[2]) for r, f in zip(rows, found, strict=True)], []
        for (a, b), (state, piece) in zip(zip(cuts[:-1], cuts[1:], strict=True), pieces, strict=True):
            out += c.rendered(plain[a:b], state, piece)
        assert out == lines


def test_runs_of_deleted_rows_are_one_step():
    apart = [c.edges_of(0, "u"), *[c.edges_of(1)] * 5, c.edges_of(0, "u")]
    joint = [c.edges_of(0, "u"), c.edges_of(5), c.edges_of(0, "u")]
    assert c.search(apart, 0, c.ENDS)[:2] == c.search(joint, 0, c.ENDS)[:2]


ODD = [
    (None, None, None, None),
    (None, 1, "user", "Hello."),
    (None, 2, "assistant", "Hello!"),
    (1, None, "user", "no turn"),
    (1, 5, "assistant", " \t\n"),
    (1, 9, "assistant", "Done."),
    (2, 0, "user", "same."),
    (2, 1, "user", "same."),
    (2, 1, "user", "same."),
    (2, -3, "tool", "x" * 200_000 + "."),
    (3, None, "user", None),
    (3, None, None, "a."),
    (4, 0, "", "漢字。"),
    (4, 1, "user", "ünï 😀."),
    (4, 2, "assistant", "a\nb."),
]


def with_clashes(spark, table):
    rows = [(*r, "x", "y", 1, "z") for r in table]
    return spark.createDataFrame(rows, f"{SCHEMA}, copies string, new string, part int, _long string")


def test_odd_rows(spark):
    assert got(c.repair_damaged(with_clashes(spark, ODD))) == expected(sorted(ODD, key=lambda r: (r[2] or " ", r[3] or " ")))
    assert c.repair_damaged(with_clashes(spark, ODD).limit(0)).count() == 0


def test_conversation_whose_rows_are_all_dropped(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    found = got(c.repair_damaged(spark.createDataFrame([(7, turn, "user", "a.")], SCHEMA)))
    assert found == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("segment", [4, 256])
def test_long_conversations_are_dealt_out(spark, monkeypatch, segment):
    rng = random.Random(3)
    said = [f"line {i}{'.' if i % 3 else ''}" for i in range(60)]
    table = [(conv, t, rng.choice(["user", "assistant"]), rng.choice(said)) for conv in (1, 2, 3) for t in rng.sample(range(300), 200)]
    table += [(9, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)]
    table += [(None, None, "user", "again.")] * 70 + [(None, t, "assistant", "again.") for t in range(70)]
    table += [(5, t, "user", "again.") for t in range(90)]
    monkeypatch.setattr(c, "LONG", 50)
    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "FAN", 3)
    assert got(c.repair_damaged(spark.createDataFrame(table, SCHEMA))) == expected(table)


@needs_tables
def test_whole_table(spark):
    assert difference(op12_conversation_repair(spark, SF), duck(SF), c.oracle_sql()) == ""
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(c.repair_damaged(table)) == expected(rows)
