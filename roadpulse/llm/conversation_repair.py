"""Operator 13: the cheapest edits that give a damaged conversation a legal order of roles.

The rows of a conversation and the states of the grammar ``(s?(ua)+)?`` span an edit lattice:
keeping, re-labelling or deleting a row moves on to the next row, inserting an empty turn
changes the state in place. Bidirectional Dijkstra searches it: two heaps grow from the first
and the last node, stop when no cheaper or equal crossing can remain, and among all cheapest
paths the one with the least audit (its edits' initials) is read off the nodes that lie on
such a path.

Rows are dealt by ranges of (conversation, turn), so a conversation with a third of all rows
spreads over many tasks. Only what decides about edits travels there: an initial, a fault, a
digest. A task solves the conversations that lie inside it; longer ones leave it in blocks,
each with the cheapest way between every pair of grammar states at its edges, and the blocks
of one conversation are joined afterwards. Texts are shuffled once, to apply the audit in
order; that pass holds one batch of rows, never a conversation.

Inputs: rows with conv_id, turn, role and text; other columns, whatever their names, are
ignored. A null role or text is one space; rows with a null conv_id form one conversation.
Rows are taken by turn, nulls first; equal turns by a digest of role and text, so equal rows
stand together. Repeated rows are duplicates like any other. A conversation all of whose rows
were dropped is returned with zeros and empty strings. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from roadpulse.llm.word_table import chunk_number, shuffle_parts

BLOCK = 2048
SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = 4
KEPT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})   # state and initial -> next state
LABELLED = (2, 2, 3, 2)                                                # state after a turn that edits may name freely
ACCEPTED = (0, 3)
DELETE, INSERT, RELABEL, CUT_OFF = 3, 2, 2, 1                          # costs; keeping is free
CLOSING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}  # from a state to an accepted one after the last row
FREE = [[p for p in range(STATES) if LABELLED[p] == s] for s in range(STATES)]


# --- the search -----------------------------------------------------------------------

def steps(codes: list[int], faults: list[int], node: int, tail: bool) -> Iterator[tuple[str, int, int]]:
    """(initial, next node, cost) of the edits at a node (row * STATES + state), initials in ASCII order."""
    row, state = divmod(node, STATES)
    inside = row < len(codes)
    if inside:
        yield "D", node + STATES, DELETE
    if inside or tail:
        yield "I", row * STATES + LABELLED[state], INSERT
    if inside and faults[row] not in (BLANK, DUPLICATE):
        extra = CUT_OFF if faults[row] == TRUNCATED else 0
        kept = KEPT[state].get(codes[row])
        if kept is not None:
            yield "K", (row + 1) * STATES + kept, extra
        yield "R", (row + 1) * STATES + LABELLED[state], RELABEL + extra


def steps_back(codes: list[int], faults: list[int], node: int, tail: bool) -> Iterator[tuple[int, int]]:
    """(previous node, cost) of the edits that lead to a node."""
    row, state = divmod(node, STATES)
    if row < len(codes) or tail:
        for before in FREE[state]:
            yield row * STATES + before, INSERT
    if row:
        base = (row - 1) * STATES
        yield base + state, DELETE
        if faults[row - 1] not in (BLANK, DUPLICATE):
            extra = CUT_OFF if faults[row - 1] == TRUNCATED else 0
            for before in range(STATES):
                if KEPT[before].get(codes[row - 1]) == state:
                    yield base + before, extra
            for before in FREE[state]:
                yield base + before, RELABEL + extra


def cheapest(codes: list[int], faults: list[int], entry: int, exits: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Cost and least audit from ``entry`` before the first row to one of ``exits`` after the last.

    ``tail``: turns may be inserted after the last row. None where no edits lead there.
    """
    far = float("inf")
    size = (len(codes) + 1) * STATES
    ends = [len(codes) * STATES + e for e in exits]
    ahead, back = [far] * size, [far] * size
    ahead[entry] = 0
    for e in ends:
        back[e] = 0
    best = 0 if entry in ends else far
    forward, reverse = [(0, entry)], [(0, e) for e in ends]
    # While both tops add up to the best cost a crossing of equal cost may still be open.
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0][0] <= reverse[0][0]:
            cost, node = heappop(forward)
            if cost == ahead[node]:
                for _, after, c in steps(codes, faults, node, tail):
                    if cost + c < ahead[after]:
                        ahead[after] = cost + c
                        heappush(forward, (cost + c, after))
                        best = min(best, cost + c + back[after])
        else:
            cost, node = heappop(reverse)
            if cost == back[node]:
                for before, c in steps_back(codes, faults, node, tail):
                    if cost + c < back[before]:
                        back[before] = cost + c
                        heappush(reverse, (cost + c, before))
                        best = min(best, cost + c + ahead[before])
    if best == far:
        return None
    # Nodes of cheapest paths, with the cost up to them: from the crossings both ways.
    place = {node: ahead[node] for node in range(size) if ahead[node] + back[node] == best}
    todo = list(place)
    while todo:
        node = todo.pop()
        for before, c in steps_back(codes, faults, node, tail):
            if before not in place and ahead[before] + c == ahead[node]:
                place[before] = ahead[before]
                todo.append(before)
    todo = [node for node in place if back[node] < far and ahead[node] + back[node] == best]
    while todo:
        node = todo.pop()
        for _, after, c in steps(codes, faults, node, tail):
            if after not in place and back[after] + c == back[node]:
                place[after] = best - back[after]
                todo.append(after)
    audit, node = [], entry
    while not (node in ends and place[node] == best):
        initial, node = next((i, after) for i, after, c in steps(codes, faults, node, tail)
                             if place.get(after) == place[node] + c)
        audit.append(initial)
    return int(best), "".join(audit)


# --- rows -----------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a row's CRC-32 calls for."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(name) % 20).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_digest(rows: DataFrame) -> DataFrame:
    """With a digest of role and text (equal digests are taken for equal rows: 128 bits)."""
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def marked(rows: DataFrame) -> DataFrame:
    """What decides about edits: initial, fault (a later turn's duplicates included), digest; no text."""
    ink = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(ink == "", BLANK).when(~F.substring(ink, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    narrow = with_digest(rows).select("conv_id", "turn", "digest", _initial().alias("code"), fault.alias("fault"))
    moment = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # nulls first
    seen = (narrow.groupBy(F.col("conv_id").alias("d_conv"), F.col("digest").alias("d_digest"))
            .agg(F.min(moment).alias("first"), F.max(moment).alias("last")).where("first != last"))
    both = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("d_conv")) & (F.col("digest") == F.col("d_digest")), "left")
    return both.select("conv_id", "turn", "digest", "code", "fault", F.coalesce(moment > F.col("first"), F.lit(False)).alias("later"))


# --- segments: whole conversations, or blocks of long and cut ones -----------------------

SEGMENT = ("conv_id bigint, place bigint, whole boolean, first_turn bigint, last_turn bigint, turns bigint, first_code int, last_code int, "
           "blank bigint, duplicate bigint, truncated bigint, illegal bigint, costs array<bigint>, audits array<string>")
NAMES = [part.split()[0] for part in SEGMENT.split(", ")]
TOTALS = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def segment(conv, place: int, whole: bool, turns: list, codes: list[int], faults: list[int]) -> dict:
    known = [t for t in turns if t is not None]
    if whole:
        ways = [cheapest(codes, faults, 0, ACCEPTED, True)]
    else:
        ways = [cheapest(codes, faults, e, (x,), False) for e in range(STATES) for x in range(STATES)]
    return {"conv_id": conv, "place": place, "whole": whole, "first_turn": known[0] if known else None,
            "last_turn": known[-1] if known else None, "turns": len(set(known)), "first_code": codes[0], "last_code": codes[-1],
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(pair not in LEGAL_PAIRS for pair in zip(codes, codes[1:])),
            "costs": [w[0] if w else None for w in ways], "audits": [w[1] if w else None for w in ways]}


def segmenting(block: int):
    """Over rows sorted by (conv_id, turn, digest): conversations inside the task are solved, others leave in blocks."""
    kind = pa.schema([(name, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
                              "array<string>": pa.list_(pa.string())}[part.split()[1]]) for name, part in zip(NAMES, SEGMENT.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, index, opened = None, None, 0, True   # opened: the conversation may have begun before
        turns, codes, faults, out = [], [], [], []

        def close(whole: bool):
            nonlocal index, turns, codes, faults
            if codes:
                out.append(segment(conv, chunk_number(index), whole, turns, codes, faults))
                index, turns, codes, faults = index + 1, [], [], []

        started = False
        for batch in batches:
            for own, turn, digest, code, fault, later in zip(*(column.to_pylist() for column in batch.columns)):
                if started and own != conv:
                    close(not opened)
                    opened = False
                elif len(codes) == block:
                    close(False)
                    opened = True
                started = True
                conv = own
                if fault != BLANK and (later or last == (own, turn, digest)):
                    fault = DUPLICATE
                last = (own, turn, digest)
                turns.append(turn)
                codes.append(code)
                faults.append(fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out.clear()
        close(False)  # the conversation may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
    return run


def joined(parts: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one conversation, in order, as one row of totals."""
    parts = parts.sort_values("place")
    rows = parts.to_dict("records")
    go = [{s: c for s, (c, _) in CLOSING.items()}]   # cheapest cost from a state to the end, from the last block back
    for row in reversed(rows):
        costs = [None if c is None or c != c else int(c) for c in row["costs"]]
        go.append({e: min((costs[e * STATES + x] + go[-1][x] for x in range(STATES) if costs[e * STATES + x] is not None and x in go[-1]),
                          default=None) for e in range(STATES)})
        go[-1] = {e: c for e, c in go[-1].items() if c is not None}
    go.reverse()
    state, audit = 0, []
    for k, row in enumerate(rows):
        # Audits of a block all end with an edit of its last row, so none begins another: the least one decides.
        found, state = min((row["audits"][state * STATES + x], x) for x in range(STATES) if x in go[k + 1]
                           and row["audits"][state * STATES + x] is not None
                           and row["costs"][state * STATES + x] + go[k + 1][x] == go[k][state])
        audit.append(found)
    audit.append(CLOSING[state][1])
    turns, illegal, known, last = 0, 0, [], None
    for before, row in zip([None, *rows], rows):
        illegal += int(row["illegal"]) + (before is not None and (before["last_code"], row["first_code"]) not in LEGAL_PAIRS)
        if row["turns"]:
            turns += int(row["turns"]) - (row["first_turn"] == last)
            last = row["last_turn"]
            known += [int(row["first_turn"]), int(row["last_turn"])]
    conv = rows[0]["conv_id"]
    return pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv) else int(conv)], "Int64"),
                         "gaps": [known[-1] - known[0] + 1 - turns if known else 0], **{n: [int(parts[n].sum())] for n in ("blank", "duplicate", "truncated")},
                         "illegal": [illegal], "cost": [int(go[0][0])], "audit": ["".join(audit)]})


def totals(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, cheapest cost and audit of every conversation that has rows (after ``damaged`` or as they are)."""
    narrow = marked(rows)
    parts = shuffle_parts(rows)   # Spark's guess of a join's size would be their product
    order = ("conv_id", "turn", "digest")
    segments = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(segmenting(block), SEGMENT)
    whole = segments.where("whole").select(
        "conv_id", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    return whole.unionByName(segments.where("not whole").groupBy("conv_id").applyInPandas(joined, TOTALS))


# --- applying an audit -------------------------------------------------------------------

class Applied:
    """Turns of one conversation as its rows come, by the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _named(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            yield self._named(), "", "I"
            self.at, self.state = self.at + 1, LABELLED[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield role, text, edit
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        elif edit == "R":
            yield self._named(), text, edit
            self.state = LABELLED[self.state]


def _with_audits(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows behind the head of their conversation (its audit in ``text``), in order; a task holds whole conversations."""
    parts = shuffle_parts(rows)
    both = with_digest(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text").unionByName(
        heads.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(b"").alias("digest"),
                     F.lit("").alias("role"), F.col("audit").alias("text")))
    return both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest").select("conv_id", "kind", "role", "text")


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of every repaired conversation, in order from place 0."""
    def run(batches):
        for batch in batches:
            out = []
            for conv, kind, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                if kind == 0:
                    if run.applied:
                        out += [(run.conv, *turn) for turn in run.applied.inserted()]
                    run.applied, run.conv = Applied(text), conv
                else:
                    out += [(conv, *turn) for turn in run.applied.row(role, text)]
            yield out
        yield [(run.conv, *turn) for turn in run.applied.inserted()] if run.applied else []

    def placed(batches):
        run.applied, run.conv, place, before = None, None, 0, object()
        for out in run(batches):
            rows_ = []
            for conv, role, text, edit in out:
                place = place + 1 if conv == before else 0
                before = conv
                rows_.append((conv, place, role, text, edit))
            yield pa.record_batch([pa.array([r[i] for r in rows_], kind) for i, kind in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text", "edit"])
    return _with_audits(rows, totals(rows, block)).mapInArrow(placed, "conv_id bigint, place bigint, role string, text string, edit string")


def repaired_hashes(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) for every head (conv_id, audit): of ``role:text`` lines, hashed as they come."""
    def run(batches):
        conv, applied, sha, first = None, None, None, True

        def add(turns):
            nonlocal first
            for role, text, _ in turns:
                sha.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False

        out = []
        for batch in batches:
            for own, kind, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                if kind == 0:
                    if applied:
                        add(applied.inserted())
                        out.append((conv, sha.hexdigest()))
                    conv, applied, sha, first = own, Applied(text), hashlib.sha256(), True
                else:
                    add(applied.row(role, text))
            yield table(out)
            out = []
        if applied:
            add(applied.inserted())
            yield table([(conv, sha.hexdigest())])

    def table(out):
        return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "repaired_sha256"])
    return _with_audits(rows, heads).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_report(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every original conversation: gaps, faults, cost, audit and the hash of what the edits leave."""
    from roadpulse.session import settle
    rows = damaged(conversations)
    found = totals(rows, block).withColumnRenamed("conv_id", "t_conv")
    original = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = settle(original.join(found, F.col("conv_id").eqNullSafe(F.col("t_conv")), "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit")), "audits")
    hashes = repaired_hashes(rows, report).withColumnRenamed("conv_id", "h_conv")
    return report.join(hashes, F.col("conv_id").eqNullSafe(F.col("h_conv"))).drop("h_conv")
