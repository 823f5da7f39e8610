"""Repair of conversation structure: cheapest edits by cost DP, the least audit by prefix-doubling path ranking.

A repaired conversation has role initials ``(s?(ua)+)?``. Every row is kept (K), given the role that fits (R) or
deleted (D), and empty rows are inserted (I). A blank row (no character but blanks) and a row whose role and text
were seen earlier in its conversation must be deleted; a truncated row (last character not one of ``.!?``) costs
extra where it stays. Of all cheapest edits those with the ASCII-least letters are taken.

How it runs. Equal rows of one turn become one row with a count, and each conversation is cut into pieces of at most
``PIECE`` such rows, so that a conversation of any length is spread over tasks. Three passes over the pieces, which
hold a few bytes a row and no text:

1. costs from each of the four states before a piece to each one after it;
2. backwards over the pieces of a conversation: the cost from the end of every piece to the end of all;
3. inside a piece, whose cost at the end is now known: optimal arcs, ranks of nodes for audits of 1, 2, 4, ... letters,
   doubled pointers, and the least path from each state it may be entered in.

Then the pieces of a conversation are followed from the first one on. An audit letter fixes the edit in a given state,
so a least path is least in every part. The pieces of one conversation meet in one row of at most 2^31 / ``PIECE``
entries, as an audit is one string; texts never do.

Edge cases: null roles and texts count as one blank; null turns come first; equal turns are ordered by digest; a null
key is a conversation of its own; a role that begins with none of s, u, a is never kept; other columns are ignored; an
empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docketry.llm.common import bound_batches
from docketry.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
#: Rows of a piece (a power of two, as pieces are cut by the bits of the row's place).
PIECE_BITS = 12
PIECE = 1 << PIECE_BITS
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. 0 and 3 may end a conversation.
#: The cost of what cannot be.
NEVER = np.int64(1 << 60)
#: Where a user or assistant row leads, whichever fits: rerole and insert.
FITTING = np.array([2, 2, 3, 2])
#: Where a kept row leads, by its class (0 other, 1 system, 2 user, 3 assistant) and the state; -1: nowhere.
KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
LEGAL = {(1, 2), (2, 3), (3, 2)}
LETTERS = np.array([b"", b"D", b"I", b"K", b"R"])


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Repaired:
    """``lines``: the repaired rows (key, at, line, action, role, text), ordered by at and line; ``report``: one row a
    conversation (key, gaps, blank, duplicate, truncated, illegal, cost, audit)."""

    lines: DataFrame
    report: DataFrame


class Steps:
    """The steps of many pieces side by side: a row that may stay, or a run of rows that must go."""

    def __init__(self, pieces: list[list[tuple[int, int, int]]], costs: Costs):
        kinds, weights, sizes, self.rows = [], [], [], []
        for piece in pieces:
            before = len(kinds)
            for at, code, copies in piece:
                stays = code & 4
                if stays:
                    kinds.append(code)
                    weights.append(1)
                    self.rows.append(at)
                if copies > 1 or not stays:
                    kinds.append(-1)
                    weights.append(copies - (1 if stays else 0))
                    self.rows.append(at)
            sizes.append(len(kinds) - before)
        self.costs = costs
        self.kind = np.array(kinds, dtype=np.int64)
        self.weight = np.array(weights, dtype=np.int64)
        self.size = np.array(sizes, dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def arcs(self, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs of D, I, K, R for the steps ``at``: shape (steps, states, letters, ...), given costs ``after`` them.

        The cost of I is left at NEVER; ``closed`` adds it.
        """
        kind, spent = self.kind[at], self.weight[at] * self.costs.delete
        out = np.full((len(at), 4, 5) + after.shape[2:], NEVER, dtype=np.int64)
        wide = (slice(None),) + (None,) * (after.ndim - 2)
        held = np.where(kind & 8, self.costs.truncated, 0)
        free = kind >= 0
        for state in range(4):
            out[:, state, 1] = after[:, state] + spent[wide]
            out[free, state, 4] = after[free, FITTING[state]] + (held[free] + self.costs.rerole)[wide]
            for role in (1, 2, 3):
                to = KEPT[role, state]
                if to >= 0:
                    own = free & (kind & 3 == role)
                    out[own, state, 3] = after[own, to] + held[own][wide]
        return out

    def closed(self, best: np.ndarray) -> np.ndarray:
        """Costs by state when rows may be inserted first; ``best``: without inserting."""
        out, insert = best.copy(), self.costs.insert
        out[:, 2] = np.minimum(best[:, 2], best[:, 3] + insert)
        out[:, 3] = np.minimum(best[:, 3], best[:, 2] + insert)
        for state in (0, 1):
            out[:, state] = np.minimum(best[:, state], out[:, 2] + insert)
        return out

    def back(self, ends: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Costs before each piece, given costs after it (pieces, states, ...): all pieces step back side by side.

        ``keep`` gets (steps, arc costs, costs) of every round.
        """
        order = np.argsort(-self.size, kind="stable")
        ends, size, last = ends[order].copy(), self.size[order], (self.start + self.size)[order]
        for back in range(1, (int(size[0]) if len(size) else 0) + 1):
            live = int(np.searchsorted(-size, -back, side="right"))
            at = last[:live] - back
            arcs = self.arcs(at, ends[:live])
            ends[:live] = self.closed(arcs.min(axis=2))
            if keep is not None:
                keep.append((at, arcs, ends[:live].copy()))
        out = np.empty_like(ends)
        out[order] = ends
        return out


def crossing_costs(steps: Steps) -> np.ndarray:
    """Costs (pieces, entry state, exit state)."""
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    return np.minimum(steps.back(np.repeat(unit[None], len(steps.size), axis=0)), NEVER)


def rank_arcs(letter: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The arc of each node (row of ``letter``, 0: no arc) that begins its least audit; -1 for nodes without arcs.

    Round k ranks the optimal arcs by the least audits of 2^k letters that begin with them: the pair of an arc's own
    rank and the rank of the node it has led to, which is that of the node's best arc. The ranks of full length
    select the arcs.
    """
    nodes, some = np.arange(len(letter)), letter > 0
    end = ~some.any(axis=1)
    rank, to = np.where(some, letter, 1 << 40), target
    while True:
        best = rank.argmin(axis=1)
        ahead, onward = np.where(end, 0, rank[nodes, best]), np.where(end, nodes, to[nodes, best])
        if end[to[some]].all():
            return np.where(end, -1, best)
        pair = rank[some] * (int(ahead.max()) + 1) + ahead[to[some]]
        rank, to = rank.copy(), to.copy()
        rank[some], to[some] = np.unique(pair, return_inverse=True)[1] + 1, onward[to[some]]


def least_paths(steps: Steps, ends: np.ndarray, last: np.ndarray, starts: list[tuple[int, int]]):
    """The least path from each (piece, state) of ``starts``: its exit state and its letters, one per step or insert.

    ``ends`` are the costs after each piece; after a ``last`` piece of a conversation rows may still be inserted.
    """
    pieces = len(steps.size)
    base = 4 * (steps.start + np.arange(pieces))  # node = base of the piece + 4 * step + state
    letter = np.zeros((4 * (int(steps.size.sum()) + pieces), 4), dtype=np.int64)
    target = np.zeros_like(letter)
    owner = np.repeat(np.arange(pieces), steps.size)
    kept: list = []
    steps.back(ends, kept)
    for at, arcs, cost in kept:
        node = base[owner[at]] + 4 * (at - steps.start[owner[at]])
        for state in range(4):
            for to in ("D", "I", "K", "R"):
                name = " DIKR".index(to)
                if to == "I":
                    best, nexts = cost[:, FITTING[state]] + steps.costs.insert, node + FITTING[state]
                else:
                    best = arcs[:, state, name]
                    move = FITTING[state] if to == "R" else state if to == "D" else KEPT[steps.kind[at] & 3, state]
                    nexts = node + 4 + move
                good = (best == cost[:, state]) & (best < NEVER)
                letter[node[good] + state, name - 1] = name
                target[node[good] + state, name - 1] = np.broadcast_to(nexts, node.shape)[good]
    final = (base + 4 * steps.size)[last]
    for state in (1, 2):
        letter[final + state, 1] = 2
        target[final + state, 1] = final + FITTING[state]
    choice, nodes = rank_arcs(letter, target), np.arange(len(letter))
    first = np.where(choice < 0, 0, letter[nodes, choice])
    pointers = [np.where(choice < 0, nodes, target[nodes, choice])]
    while first[pointers[-1]].any():
        pointers.append(pointers[-1][pointers[-1]])
    begin = np.array([base[p] + s for p, s in starts], dtype=np.int64)
    found, start, offset = begin, np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64)
    alive = first[found] > 0
    found, start, offset = found[alive], start[alive], offset[alive]
    for k in range(len(pointers) - 1, -1, -1):
        more = pointers[k][found]
        alive = first[more] > 0
        found = np.concatenate([found, more[alive]])
        start = np.concatenate([start, start[alive]])
        offset = np.concatenate([offset, offset[alive] + (1 << k)])
    order = np.lexsort((offset, start))
    letters = LETTERS[first[found[order]]]
    bounds = np.searchsorted(start[order], np.arange(len(begin) + 1))
    which = np.array([p for p, _ in starts], dtype=np.int64)
    exits = pointers[-1][begin] - (base + 4 * steps.size)[which] if len(begin) else begin
    return [(int(e), b"".join(letters[a:b]).decode()) for e, a, b in zip(exits, bounds[:-1], bounds[1:])]


def _skeleton(turns: DataFrame, key: str, order: str) -> DataFrame:
    """One row per distinct row of a turn, in order: key, order, digest, copies, code, trouble, at.

    ``code``: class of the role, plus 4 if one copy may stay, plus 8 if it is truncated.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    groups = turns.groupBy(key, order, "digest").agg(
        F.count(F.lit(1)).alias("copies"),
        F.bool_and(body == "").alias("blank"),
        F.bool_and(~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.max(F.instr(F.lit("sua"), F.left("role", F.lit(1))) * (F.col("role") != "").cast("int")).alias("class"),
    )
    firsts = groups.groupBy(F.col(key).alias("of_key"), F.col("digest").alias("of_digest")).agg(F.min(F.struct(order)).alias("first"))
    own = F.col(key).eqNullSafe(F.col("of_key")) & (F.col("digest") == F.col("of_digest"))
    stays = ~F.col("blank") & F.col("first")[order].eqNullSafe(F.col(order))
    rows = groups.join(firsts, own).select(
        key, order, "digest", "copies", "blank",
        (F.col("class") + F.when(stays, 4).otherwise(0) + F.when(stays & F.col("open"), 8).otherwise(0)).cast("int").alias("code"),
    )
    sorted_rows = rows.repartitionByRange(F.asc_nulls_first(key), F.asc_nulls_first(order), "digest").sortWithinPartitions(
        F.asc_nulls_first(key), F.asc_nulls_first(order), "digest"
    )
    return cut_lineage(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "dialogue-rows")


def _over_pieces(pieces: DataFrame, schema: str, work) -> DataFrame:
    """``work`` gets the rows of a batch as dictionaries and returns rows for ``schema``."""
    bound_batches(pieces.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_pylist(work(batch.slice(at, 500).to_pylist()), schema=arrow)

    return pieces.mapInArrow(run, schema)


def _steps_of(rows: list[dict], costs: Costs) -> Steps:
    return Steps([[(s["at"], s["code"], s["copies"]) for s in row["steps"]] for row in rows], costs)


def _illegal(classes: list[int]) -> int:
    return sum((a, b) not in LEGAL for a, b in zip(classes, classes[1:]))


def repair(turns: DataFrame, key: str = "conv_id", order: str = "turn", costs: Costs = Costs()) -> Repaired:
    """Repair every conversation of ``turns`` (columns ``key``, ``order``, role, text)."""
    # Columns get names of their own, so that other columns and odd key names cannot clash.
    turns = turns.select(
        F.col(key).alias("key"), F.col(order).alias("order"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    key_type = turns.schema["key"].dataType.simpleString()
    rows = _skeleton(turns, "key", "order")
    pieces = rows.groupBy("key", F.shiftright("at", PIECE_BITS).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code", F.col("copies").cast("bigint").alias("copies")))).alias("steps"),
    )

    def crossings(batch):
        costs_of = crossing_costs(_steps_of(batch, costs))
        out = []
        for row, table in zip(batch, costs_of):
            classes = [s["code"] & 3 for s in row["steps"]]
            repeats = sum(s["copies"] - 1 for s in row["steps"])
            out.append(row | {
                "costs": table.ravel().tolist(), "illegal": _illegal(classes) + repeats, "head": classes[0], "tail": classes[-1],
            })
        return out

    piece = f"key {key_type}, piece bigint, steps array<struct<at bigint, code int, copies bigint>>"
    crossed = cut_lineage(
        _over_pieces(pieces, f"{piece}, costs array<bigint>, illegal bigint, head int, tail int", crossings), "dialogue-pieces"
    )

    def chain(batch):
        out = []
        for row in batch:
            ends, parts = np.array([0, 2 * costs.insert, costs.insert, 0], dtype=np.int64), []
            for at, part in enumerate(reversed(row["pieces"])):
                parts.append({"piece": part["piece"], "ends": ends.tolist(), "last": at == 0})
                ends = (np.array(part["costs"], dtype=np.int64).reshape(4, 4) + ends).min(axis=1)
            parts[-1]["first"] = True
            borders = [c for part in row["pieces"] for c in (part["head"], part["tail"])]
            illegal = sum(part["illegal"] for part in row["pieces"]) + sum((a, b) not in LEGAL for a, b in zip(borders[1::2], borders[2::2]))
            out.append({"key": row["key"], "cost": int(ends[0]), "illegal": illegal, "parts": [{"first": False} | p for p in parts]})
        return out

    whole = crossed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "costs", "illegal", "head", "tail"))).alias("pieces"))
    chained = cut_lineage(
        _over_pieces(
            whole,
            f"key {key_type}, cost bigint, illegal bigint, parts array<struct<piece bigint, ends array<bigint>, last boolean, first boolean>>",
            chain,
        ),
        "dialogue-chains",
    )
    known = chained.select(F.col("key").alias("of_key"), F.inline("parts").alias("of_piece", "ends", "last", "first"))
    same = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("piece") == F.col("of_piece"))

    def paths(batch):
        steps = _steps_of(batch, costs)
        starts = [(i, s) for i, row in enumerate(batch) for s in ([0] if row["first"] else range(4))]
        ends = np.array([row["ends"] for row in batch], dtype=np.int64)
        last = np.array([row["last"] for row in batch], dtype=bool)
        out = [row | {"paths": []} for row in batch]
        for (i, state), (leads, letters) in zip(starts, least_paths(steps, ends, last, starts)):
            out[i]["paths"].append({"state": state, "exit": leads, "letters": letters})
        return out

    path = "array<struct<state int, exit int, letters string>>"
    inside = crossed.select("key", "piece", "steps").join(known, same).select("key", "piece", "steps", "ends", "last", "first")
    walked = cut_lineage(_over_pieces(inside, f"{piece}, paths {path}", paths), "dialogue-paths")

    def follow(batch):
        out = []
        for row in batch:
            state, chosen = 0, []
            for part in row["pieces"]:
                chosen.append({"piece": part["piece"], "state": state})
                state = next(e["exit"] for e in part["exits"] if e["state"] == state)
            out.append({"key": row["key"], "chosen": chosen})
        return out

    exits = F.transform("paths", lambda p: F.struct(p["state"].alias("state"), p["exit"].alias("exit"))).alias("exits")
    entered = _over_pieces(
        walked.select("key", F.struct("piece", exits).alias("part")).groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("pieces")),
        f"key {key_type}, chosen array<struct<piece bigint, state int>>",
        follow,
    ).select(F.col("key").alias("of_key"), F.inline("chosen").alias("of_piece", "entry"))

    def edits(batch):
        out = []
        for row in batch:
            steps, audit, done, state = _steps_of([row], costs), [], [], row["entry"]
            way = next(p["letters"] for p in row["paths"] if p["state"] == row["entry"])
            at, lead = 0, []
            for letter in way:
                if letter == "I":
                    state = int(FITTING[state])
                    lead.append(state)
                    audit.append("I")
                    continue
                kind, place = int(steps.kind[at]), steps.rows[at]
                audit.append(letter * int(steps.weight[at]))
                state = int(FITTING[state] if letter == "R" else KEPT[kind & 3, state] if letter == "K" else state)
                if lead or letter != "D":
                    done.append({"at": place, "step": at, "lead": lead, "action": letter, "state": state})
                at, lead = at + 1, []
            if lead:
                done.append({"at": steps.rows[-1], "step": at, "lead": lead, "action": "I", "state": state})
            out.append({"key": row["key"], "piece": row["piece"], "audit": "".join(audit), "edits": done})
        return out

    edited = cut_lineage(
        _over_pieces(
            walked.join(entered, same).select("key", "piece", "steps", "paths", "entry"),
            f"key {key_type}, piece bigint, audit string, edits array<struct<at bigint, step int, lead array<int>, action string, state int>>",
            edits,
        ),
        "dialogue-edits",
    )
    return Repaired(_lines(turns, rows, edited, key), _report(rows, chained, edited, key))


def _lines(turns: DataFrame, rows: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """Repaired rows: inserted ones, then the row itself where it stays."""
    placed = rows.select(F.col("key").alias("of_key"), F.col("order").alias("of_order"), F.col("digest").alias("of_digest"), "at")
    changes = edited.select(F.inline("edits").alias("at", "step", "lead", "action", "state"))
    texts = turns.groupBy("key", "order", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    own = F.col("key").eqNullSafe(F.col("of_key")) & F.col("order").eqNullSafe(F.col("of_order")) & (F.col("digest") == F.col("of_digest"))
    fitting = lambda state: F.when(state == 2, F.lit("user")).otherwise(F.lit("assistant"))
    row = lambda action, role, text: F.struct(action.alias("action"), role.alias("role"), text.alias("text"))
    inserted = F.transform("lead", lambda s: row(F.lit("I"), fitting(s), F.lit("")))
    itself = F.when(
        F.col("action").isin("K", "R"),
        F.array(row(F.col("action"), F.when(F.col("action") == "K", F.col("role")).otherwise(fitting(F.col("state"))), F.col("text"))),
    ).otherwise(F.array().cast("array<struct<action:string,role:string,text:string>>"))
    joined = changes.join(placed, "at").join(texts, own)
    return joined.select(
        F.col("of_key").alias(key), "at", "step", F.posexplode(F.concat(inserted, itself)).alias("place", "row")
    ).select(key, "at", (F.col("step") * 65536 + F.col("place")).cast("bigint").alias("line"), "row.*")


def _report(rows: DataFrame, chained: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    stays, n = F.col("code").bitwiseAND(F.lit(4)) > 0, F.col("copies")
    by_turn = rows.groupBy("key", "order").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(n - stays.cast("int"))).alias("duplicate"),
        F.count_if(F.col("code").bitwiseAND(F.lit(8)) > 0).alias("truncated"),
    )
    turn = F.col("order").cast("decimal(20,0)")
    counts = by_turn.groupBy("key").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("order"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    audits = edited.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit")
    )
    other = lambda df, tag: df.withColumnRenamed("key", tag)
    return (
        counts.join(other(chained.select("key", "cost", "illegal"), "k1"), F.col("key").eqNullSafe(F.col("k1")))
        .join(other(audits, "k2"), F.col("key").eqNullSafe(F.col("k2")))
        .select(
            F.col("key").alias(key), F.least(F.col("gaps"), F.lit((1 << 63) - 1)).cast("bigint").alias("gaps"),
            "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        )
    )


def line_digests(lines: DataFrame, key: str) -> DataFrame:
    """sha256 of ``role:text`` of each conversation's lines in order, joined by newlines: key, repaired_sha256.

    A digest runs over its bytes in order, so the lines of a conversation pass one task, batch by batch, sorted by
    Spark outside of Python; the task holds one batch and the digest so far.
    """
    bound_batches(lines.sparkSession)
    type_of = lines.schema[key].dataType.simpleString()
    ordered = lines.select(F.col(key).alias("key"), "at", "line", F.concat_ws(":", "role", "text").alias("text")).repartition("key")
    schema = f"key {type_of}, repaired_sha256 string"

    def run(batches):
        now, digest = None, None
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), []
            for own, text in zip(keys, batch.column(1).to_pylist()):
                if digest is None or own != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode("utf-8", "surrogatepass"))
            if done:
                yield _digest_rows(done, batch.schema.field(0).type)
        if digest is not None:
            yield _digest_rows([(now, digest.hexdigest())], batch.schema.field(0).type)

    return (
        ordered.sortWithinPartitions("key", "at", "line").select("key", "text").mapInArrow(run, schema).withColumnRenamed("key", key)
    )


def _digest_rows(rows: list[tuple], type_of: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], type_of), pa.array([d for _, d in rows], pa.string())], names=["key", "repaired_sha256"]
    )
