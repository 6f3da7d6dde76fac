"""Repair of conversations against all edit sequences and a plain rewrite of the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from roadpulse.llm import conversation_repair as repair
from roadpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
sys.setrecursionlimit(20_000)   # the plain solution goes one call deeper for every edit
INK = re.compile(r"[^\x20\x09-\x0D]")


def plain_cheapest(initials: str, faults: list[str]) -> tuple[int, str]:
    """Least (cost, audit) by trying every edit at every place, from the end back."""
    n = len(initials)

    @lru_cache(None)
    def from_(row, built, spent_inserts):
        """``built``: what the output so far ends with ('' or its last initial)."""
        found = [(0, "")] if row == n and built in ("", "a") else []
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[built]
        free = "a" if built == "u" else "u"
        if spent_inserts < 2:
            found.append((2, "I", from_(row, free, spent_inserts + 1)))
        if row < n:
            found.append((3, "D", from_(row + 1, built, 0)))
            if faults[row] not in ("blank", "duplicate"):
                extra = faults[row] == "truncated"
                if initials[row] in nexts:
                    found.append((extra, "K", from_(row + 1, initials[row], 0)))
                found.append((2 + extra, "R", from_(row + 1, free, 0)))
        whole = [f if len(f) == 2 else (f[0] + f[2][0], f[1] + f[2][1]) for f in found]
        return min(whole, default=(10 ** 9, ""))
    return from_(0, "", 0)


def plain_report(rows):
    """``rows``: (conv_id, turn, role, text); what op13 returns, one conversation after the other."""
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [(turn, role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in kept:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] if role[:1] in ("s", "u", "a") else "x" for _, role, _ in kept]
        cost, audit = plain_cheapest("".join(initials), faults)
        lines, at, last = [], 0, ""
        for edit in audit:
            free = "assistant" if last == "a-next" else "user"
            if edit == "I":
                lines.append(f"{free}:")
            else:
                _, role, text = kept[at]
                at += 1
                if edit == "D":
                    continue
                lines.append(f"{role if edit == 'K' else free}:{text}")
            last = "a-next" if lines[-1][0] == "u" else ""
        turns = [t for t, _, _ in kept if t is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", True) for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, kind int, digest string, whole boolean")


def random_rows(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2) * 3,
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "cut", " ", "", None, "Why?\n", "Same.", f"t{rng.random()}."])))
    return rows


def test_search_equals_all_edit_sequences():
    rng = random.Random(3)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(2500):
        n = rng.randrange(10)
        codes, faults = [rng.randrange(4) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        want = plain_cheapest("".join("suax"[c] for c in codes), [names[f] for f in faults])
        assert repair.cheapest(codes, faults, 0, repair.ACCEPTED, True) == want, (codes, faults)


@pytest.mark.parametrize("block", [1, 3, repair.BLOCK])
def test_report_equals_the_plain_rewrite(spark, block):
    rows = random_rows(block, 60, 14)
    rows += [(None, t, r, x) for _, t, r, x in random_rows(9, 2, 30)]
    rows += rows[:7]                                                       # repeated rows
    rows += [(500, t, "user", "x.") for t in range(40) if zlib.crc32(f"500:{t}".encode()) % 20 == 0]   # all dropped
    rows += [(501, None, "user", "Long. " * 20_000), (502, 3, "u", "A."), (503, 2 ** 62, "assistant", "B."), (503, -(2 ** 61), "user", "B.")]
    assert found(repair.repair_report(frame(spark, rows).repartition(3), block)) == plain_report(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(1, t, random.Random(t).choice(["user", "assistant", "system"]), random.Random(-t).choice(["Yes.", "no", f"{t}."])) for t in range(400)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    assert found(repair.repair_report(frame(spark, rows).repartition(5), 16)) == plain_report(rows)


def test_repaired_turns_are_legal(spark):
    rows = repair.damaged(frame(spark, random_rows(5, 40, 12)))
    by_conversation = {}
    for r in sorted(repair.repaired_turns(rows, 4).collect(), key=lambda r: (r.conv_id, r.place)):
        assert r.place == len(by_conversation.setdefault(r.conv_id, []))
        by_conversation[r.conv_id].append(r.role[0])
    assert by_conversation and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by_conversation.values())


def test_empty_table(spark):
    assert repair.repair_report(frame(spark, [])).count() == 0


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_bidirectional_repair"](spark, SF)) == plain_report(rows)
