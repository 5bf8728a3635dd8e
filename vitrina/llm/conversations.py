"""Conversation structure repair by Wagner-Fischer alignment to an alternating grammar.

The grammar of role initials is ``(s?(ua)+)?``: nothing, or an optional system turn and then
user and assistant in turn.  For every feasible length the grammar has one string, so a
conversation is aligned to the string of each length: keep a turn (0), give it another role
(1), delete it (2, the only edit of blank and duplicate turns), insert an empty turn (5);
truncated turns that stay cost 5 more.  The cheapest alignment found so far bounds the
lengths worth trying and, after Ukkonen, the diagonals of each matrix; among equal costs the
backtraced audits (initials of the edits) are compared and the ASCII-least stays.

A conversation is read as a sorted stream and aligned in runs of at most ``RUN`` turns: a run
is aligned from every state of the grammar in which the runs before it can end, and the
cheapest way into each state goes on, with a running hash of what it repaired.  Ways into
one state differ in nothing that follows, so the result is that of one alignment of the
whole, and a task holds one run of texts and up to four audits, however long the
conversation is.  All turns of a conversation pass one task, as a hash over its repaired text
must; they come through a shuffle and sort that spill.

Edge cases: a null role or text reads as one space, so a null text is blank; in the key that
chooses the damage a null id or turn is one space too.  Turns are ordered by number, nulls
first, equal ones by role and text (bytes), so repeated rows stand side by side and the later
are duplicates.  Rows without id are one conversation.  A conversation without rows has
zeros, an empty audit and the hash of the empty string.  Empty tables give an empty result.
``gaps`` beyond a long is the greatest long.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vitrina.llm.common import slices

#: Turns (and bytes of text) of a run.
RUN, RUN_BYTES = 48, 1 << 23
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""
_INFINITE = 1 << 60
#: States of the grammar: nothing yet (the empty state), or the last role initial.
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_END = ("", "a")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` after the damage that crc32 of ``conv_id:turn`` modulo 20 chooses.

    Dropped rows stay as marks without text, so that no conversation is lost.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _string(state: str, length: int) -> Iterator[str]:
    """The strings of ``length`` initials that may follow ``state``: one, and one more with a system turn at the very start."""
    first = _NEXT[state]
    alternating = ("ua" if first == "u" else "au") * (length // 2 + 1)
    yield alternating[:length]
    if state == "" and length:
        yield "s" + alternating[:length - 1]


def _align(turns: str, target: str, bound: int) -> tuple[int, str] | None:
    """Cheapest edits of ``turns`` into ``target``, ASCII-least among equals; None if they cost more than ``bound``.

    ``turns`` has two characters per turn: role initial and ``-`` (must go), ``.`` (sound) or ``+`` (truncated).  Costs
    are those of the rest, so the walk that reads the audit goes forward.  Only cells are
    filled whose diagonal can be reached and left within ``bound``.
    """
    n, m = len(turns) // 2, len(target)

    def least(i: int, j: int) -> int:
        """What the lengths alone cost, from ``i`` turns to ``j`` initials."""
        return DELETE * (i - j) if i > j else INSERT * (j - i)

    cost = [[_INFINITE] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        row, below = cost[i], cost[i + 1]
        # The diagonals of a bound: reached from the start and left to the end within it.
        low, high = max(0, i - bound // DELETE, m - (n - i) - bound // INSERT), min(m, i + bound // INSERT, m - (n - i) + bound // DELETE)
        initial, state = turns[2 * i:2 * i + 1], turns[2 * i + 1:2 * i + 2]
        for j in range(high, low - 1, -1):
            if least(i, j) + least(n - i, m - j) > bound:
                continue
            if i == n and j == m:
                row[j] = 0
                continue
            best = below[j] + DELETE if i < n else _INFINITE
            if j < m:
                if target[j] != "s":
                    best = min(best, row[j + 1] + INSERT)
                if i < n and state != "-":
                    extra = TRUNCATED if state == "+" else 0
                    if initial == target[j]:
                        best = min(best, below[j + 1] + extra)
                    elif target[j] != "s":
                        best = min(best, below[j + 1] + REROLE + extra)
            row[j] = best
    if cost[0][0] > bound:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        left = cost[i][j]
        if i < n and cost[i + 1][j] + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and cost[i][j + 1] + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[2 * i] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


@lru_cache(maxsize=50_000)
def align_run(turns: str, state: str, last: bool) -> dict[str, tuple[int, str, str]]:
    """Per state in which a run may end, from ``state``: ``(cost, audit, target)``; only states of the grammar's end if it is the ``last``.

    Lengths are tried from that of the turns that may stay outwards; a length is tried no
    more once the difference of lengths alone costs more than what is known.
    """
    n, found = len(turns) // 2, {}
    stay = n - turns[1::2].count("-")
    everything = DELETE * n
    for length in sorted(range(n + everything // INSERT + 2), key=lambda m: (abs(m - stay), m)):
        for target in _string(state, length):
            end = target[-1:] or state
            if last and end not in _END:
                continue
            # Whatever reaches this end state costs at most what is known for it; at the end of all, for any.
            known = min((c for c, *_ in found.values()), default=_INFINITE) if last else found.get(end, (_INFINITE,))[0]
            bound = min(known, everything + INSERT * (length + 1))
            if DELETE * (n - stay) + (DELETE * max(0, stay - length) + INSERT * max(0, length - stay)) > bound:
                continue
            way = _align(turns, target, bound)
            if way is not None and (end not in found or way < found[end][:2]):
                found[end] = (*way, target)
    return found


@dataclass(frozen=True)
class Way:
    """The cheapest repair so far that ends in one state of the grammar.

    ``chain`` leads back through the runs: (chain before, audit of the run, its edited turns).
    """

    cost: int
    chain: tuple | None
    hash: "hashlib._Hash"
    empty: bool

    def follow(self, cost: int, audit: str, target: str, texts: list[tuple[str, str]], with_turns: bool) -> "Way":
        done, empty, turns = self.hash.copy(), self.empty, []
        i = j = 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else texts[i]
            i += edit != "I"
            if edit != "D":
                role = role if edit == "K" else ROLES[target[j]]
                j += 1
                done.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
            if with_turns:
                turns.append((edit, role, text))
        return Way(self.cost + cost, (self.chain, audit, turns), done, empty)

    def runs(self) -> list[tuple[str, list]]:
        """Audit and edited turns of every run, in order."""
        out, chain = [], self.chain
        while chain is not None:
            chain, audit, turns = chain
            out.append((audit, turns))
        return out[::-1]


def _spelt_less(a: tuple, b: tuple) -> bool:
    """Whether chain ``a`` spells the smaller audit; runs that both share aren't looked at."""
    left, right = "", ""
    while a is not b:
        left, right = a[1] + left, b[1] + right
        a, b = a[0], b[0]
    return left < right


class Conversation:
    """Turns in, in order; the findings and the repair out."""

    def __init__(self, with_turns: bool):
        self.ways: dict[str, Way] = {"": Way(0, None, hashlib.sha256(), True)}
        self.with_turns = with_turns
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, SOUND: 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.codes: list[str] = []
        self.texts: list[tuple[str, str]] = []
        self.held = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if self.held >= RUN_BYTES or len(self.texts) >= RUN:
            self._run(last=False)
        self.counts[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.codes.append((role[:1] or " ") + ("-" if fault in (BLANK, DUPLICATE) else "+" if fault == CUT else "."))
        self.texts.append((role, text))
        self.held += len(text)

    def _run(self, last: bool) -> None:
        turns, after = "".join(self.codes), {}
        for state, way in self.ways.items():
            for end, (cost, audit, target) in align_run(turns, state, last).items():
                slot = _END if last else end
                total, chain = way.cost + cost, (way.chain, audit)
                known = after.get(slot)
                if known is None or total < known[0] or total == known[0] and _spelt_less(chain, known[1]):
                    after[slot] = (total, chain, end, way, cost, audit, target)
        self.ways = {
            end: way.follow(cost, audit, target, self.texts, self.with_turns)
            for _, _, end, way, cost, audit, target in after.values()}
        self.codes, self.texts, self.held = [], [], 0

    def end(self) -> tuple:
        self._run(last=True)
        (way,) = self.ways.values()
        runs = way.runs()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        turns = [{"edit": e, "role": r, "text": t} for _, edited in runs for e, r, t in edited] if self.with_turns else None
        return (gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, way.cost,
                "".join(audit for audit, _ in runs), way.hash.hexdigest(), turns)


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, " \
    "turns array<struct<edit:string,role:string,text:string>>"


def repair(rows: DataFrame, with_turns: bool = True) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``, perhaps ``dropped``, as :func:`damage` gives them).

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` and, ``with_turns``, the repaired turns in
    order with their edits (deleted ones too), all in one cell.
    """
    rows = rows.withColumn("dropped", F.lit(False)) if "dropped" not in rows.columns else rows
    seen = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    solid = r"[^\x20\x09-\x0D]"
    fault = (
        F.when(~F.col("text").rlike(solid), BLANK).when(F.col("nth") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND))
    # One shuffle: the window and the order both hold inside the partitions by conversation.
    ordered = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
        .repartition("conv_id").withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
        .select("conv_id", "turn", "role", "text", "dropped", "fault"))
    kind = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL(_FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        types = [None, *[pa.int64()] * 6, pa.string(), pa.string(),
                 pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))]
        done: list[tuple] = []
        held, current, talk = 0, None, None

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        for part in slices(batches):
            types[0] = types[0] or part.schema.field(0).type
            for conv, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if talk is None or conv != current:
                    if talk is not None:
                        done.append((current, *talk.end()))
                        held += 200 + len(done[-1][7]) + sum(len(t["text"]) for t in done[-1][9] or ())
                        if held > 1 << 22:
                            yield batch()
                            held = 0
                    current, talk = conv, Conversation(with_turns)
                if not dropped:
                    talk.add(turn, role, text, fault)
        if talk is not None:
            done.append((current, *talk.end()))
            yield batch()

    out = ordered.mapInArrow(run, schema)
    return out if with_turns else out.drop("turns")
