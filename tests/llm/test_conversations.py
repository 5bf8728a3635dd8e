"""Conversation repair against a plain search over all edits, and against a plain reading of the damage."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from samples import shipped  # noqa: F401
from vitrina.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(turns):
    """Least (cost, audit) and the repaired turns, by uniform-cost search over edits; ``turns``: (role, text, fault)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        state = made[-1:] if made != "s" else "s"
        if i == len(turns) and GRAMMAR.fullmatch(made):
            return cost, audit, made
        if (i, state, made == "") in done:
            continue
        done.add((i, state, made == ""))

        def go(price, edit, at, role):
            if role is None or re.fullmatch("s?(ua)*u?", made + role):
                heapq.heappush(heap, (cost + price, audit + edit, at, made + (role or "")))

        for role in "ua":
            go(5, "I", i, role)
        if i < len(turns):
            role, _, fault = turns[i]
            go(2, "D", i + 1, None)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1]:
                    go(extra, "K", i + 1, role[:1])
                for other in "ua":
                    go(1 + extra, "R", i + 1, other)
    raise AssertionError


def plain(rows, harm=True):
    """The contract, row by row."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talk = talks[conv]
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20 if harm else 19
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        talk += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults, seen = [], set()
        for _, role, text in talk:
            visible = SOLID.findall(text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, *_ in talk if t is not None}
        cost, audit, made = cheapest([(r, t, f) for (_, r, t), f in zip(talk, faults, strict=True)])
        lines, i, j = [], 0, 0
        for edit in audit:
            if edit != "D":
                role = talk[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[made[j]]
                lines.append(f"{role}:{'' if edit == 'I' else talk[i][2]}")
                j += 1
            i += edit != "I"
        initials = [r[:1] for _, r, _ in talk]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk_rows(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "Ünder", "", None])
            text = draw.choice(["Yes.", "No!", "And so", "", " \n", None, f"One {draw.random()}?", f"Two {draw.random()}", "End. \t"])
            rows.append((draw.choice([conv, conv, conv, None]) if conv < 3 else conv, draw.choice([turn, turn, turn + 2, None, -turn]), role, text))
    return rows + rows[:5]


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("seed,n,longest", [(1, 150, 7), (2, 30, 30)])
def test_against_plain(spark, seed, n, longest):
    rows = talk_rows(seed, n, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("dropped_", F.lit(1)).withColumn("fault", F.lit("x")).withColumn("nth", F.lit(9))
    assert result(conversations.repair(conversations.damage(df), with_turns=False)) == plain(rows)


def test_runs_compose(spark, monkeypatch):
    """Short runs give what one alignment of the whole gives."""
    rows = talk_rows(3, 40, 25)
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda t: (t[1] is not None, t[1] or 0, (t[2] or " ").encode(), (t[3] or " ").encode())):
        by_conv[r[0]].append(r)
    want = plain(rows, harm=False)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(conversations, "RUN", size)
        for conv, turns in by_conv.items():
            talk, seen = conversations.Conversation(with_turns=True), set()
            for _, turn, role, text in turns:
                role, text = role if role is not None else " ", text if text is not None else " "
                visible = SOLID.findall(text)
                fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
                seen.add((role, text))
                talk.add(turn, role, text, fault)
            got = talk.end()
            assert got[:8] == want[conv], (size, conv)
            kept = [t for t in got[8] if t["edit"] != "D"]
            assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in kept).encode()).hexdigest() == got[7]
            assert GRAMMAR.fullmatch("".join(t["role"][:1] for t in kept))


def test_every_short_conversation():
    """All conversations of up to five turns over roles and faults."""
    turns = [a + b for a in "uas " for b in "-.+"]
    fault = {"-": "blank", ".": "", "+": "truncated"}
    for n in range(4):
        for k in range(len(turns) ** n):
            picked = [turns[k // len(turns) ** i % len(turns)] for i in range(n)]
            found = conversations.align_run("".join(picked), "", True)
            cost, audit, _ = min(found.values())
            assert (cost, audit) == cheapest([(t[0], "", fault[t[1]]) for t in picked])[:2], picked


def test_long_conversation_and_nothing(spark):
    n = 20_000
    df = spark.range(n).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("Text "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    (row,) = conversations.repair(df, with_turns=False).collect()
    assert row["audit"] == "K" * n and row["cost"] == 0
    whole = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Text {i}." for i in range(n))
    assert row["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    (row,) = conversations.repair(conversations.damage(df), with_turns=False).collect()
    assert row["conv_id"] == 7 and len(row["audit"]) > 0.9 * n
    assert conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = result(conversations.repair(conversations.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
