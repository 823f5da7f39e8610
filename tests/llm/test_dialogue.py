"""Repair of conversations against a search over all edits, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.llm import dialogue, queries

ROOT = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, at long, piece int, code int"
ENDING = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """Best-first search over (cost, audit); a state is what was passed and the last initials, cut to what matters."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        state = (at, initials[-1:])
        if at == len(rows) and ENDING.fullmatch(initials):
            counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
            illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
            return *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if state in done:
            continue
        done.add(state)

        def push(more, letter, step, role, text):
            now = initials + (role[0] if role else "")
            if role and not any(ENDING.fullmatch(now + rest) for rest in ("", "a", "ua")):
                return
            now = "ua" if now.endswith("a") else now[-1:]
            heapq.heappush(heap, (cost + more, audit + letter, at + step, now, (*lines, f"{role}:{text}") if role else lines))

        for role in ("user", "assistant"):
            push(5, "I", 0, role, "")
        if at < len(rows):
            push(2, "D", 1, None, None)
            if faults[at] in ("", "truncated"):
                extra = 5 if faults[at] else 0
                role, text = rows[at]
                if role[:1] in ("s", "u", "a"):
                    push(extra, "K", 1, role, text)
                for new in ("user", "assistant"):
                    push(extra + 1, "R", 1, new, text)


def plain(rows):
    """The contract's rows from original (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(named.encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        own = convs[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own.extend([(turn, role, text)] * (2 if fault == 3 else 1))
    out = {}
    for conv, own in convs.items():
        digest = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *plain_repair([r[1:] for r in own]))
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def made(seed, convs, turns):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "sys"], ["One.", "Two", "", " \n", None, "Why?", "a.b", "ok! \t", "é", "x" * 50]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rnd.randint(1, turns)):
            turn = rnd.choice([turn, turn, turn, turn + 3, None, -turn])
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"Text {rnd.random()}" + rnd.choice([".", "?", "!", "", ". "])
            rows.append((conv, turn, rnd.choices(roles, weights)[0], text))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_repair_equals_search_over_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(dialogue, "PIECE_BITS", bits)
    rows = made(bits, 150, 9)
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(queries, "read_table", lambda *_: table)
    own = found(queries.op11_path_ranking(spark, ROOT))
    want = plain(rows)
    assert own.keys() == want.keys()
    assert {k: (own[k], want[k]) for k in own if own[k] != want[k]} == {}


def test_repair_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_path_ranking(spark, ROOT)) == plain(rows)


def test_repair_of_a_long_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE_BITS", 5)
    rnd = random.Random(4)
    rows = [(1, i, rnd.choice(["user", "assistant", "system"]), f"{i}" + rnd.choice([".", "."])) for i in range(1500)]
    rows += [(1, 7, "user", "Same.")] * 300 + [(2, None, "user", "Same.")] * 300 + [(3, 1, "assistant", "t" * 3_000_000 + ".")]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(7)
    monkeypatch.setattr(queries, "read_table", lambda *_: table)
    assert found(queries.op11_path_ranking(spark, ROOT)) == plain(rows)


def test_ranks_select_the_least_paths():
    rnd = random.Random(8)
    for _ in range(50):
        pieces = [[(i, rnd.choice([0, 4, 5, 6, 7, 13, 14, 15]), rnd.randint(1, 2)) for i in range(rnd.randint(1, 6))] for _ in range(4)]
        steps = dialogue.Steps(pieces, dialogue.Costs())
        ends = dialogue.np.array([[rnd.randint(0, 9) for _ in range(4)] for _ in pieces])
        starts = [(p, s) for p in range(4) for s in range(4)]
        cost = steps.back(ends)
        crossed = dialogue.crossing_costs(steps)
        assert ((crossed + ends[:, None, :]).min(axis=2) == cost).all()
        paths = dialogue.least_paths(steps, ends, dialogue.np.zeros(4, bool), starts)
        for (piece, state), (leads, letters) in zip(starts, paths):
            at, spent, now = int(steps.start[piece]), 0, state
            for c in letters:
                kind = int(steps.kind[at]) if c != "I" else 0
                held = 5 if kind >= 0 and kind & 8 else 0
                spent += {"I": 5, "D": 2 * int(steps.weight[at]) if c == "D" else 0, "K": held, "R": held + 1}[c]
                now = int(dialogue.FITTING[now] if c in "IR" else dialogue.KEPT[kind & 3, now] if c == "K" else now)
                at += c != "I"
            assert now == leads and spent + ends[piece][leads] == cost[piece][state]


def test_repair_of_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "read_table", lambda *_: spark.createDataFrame([], SCHEMA))
    assert queries.op11_path_ranking(spark, ROOT).collect() == []


def test_lines_are_the_repaired_conversation(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "user", "Why?"), (1, 4, "assistant", "So.")]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    done = dialogue.repair(table)
    lines = [(r["action"], r["role"], r["text"]) for r in done.lines.orderBy("at", "line").collect()]
    assert lines == [("K", "user", "Why?"), ("K", "assistant", "So.")]
    assert done.report.select("cost", "audit").first() == (4, "DKDK")
    assert done.lines.columns == ["conv_id", "at", "line", "action", "role", "text"] and F is not None
