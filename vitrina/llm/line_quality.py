"""Quality rules, line first.

Every line of a text is judged on its own by punctuation, navigation and boilerplate
rules.  Lines that fail are removed; a document that loses more than ``max_loss`` of
its words goes as a whole, as does one that fails the base rules on its whole text.

Edge cases: a null or empty text has no words, fails the base rule on length and is not
kept.  A text without line breaks is one line.  Rows are judged one by one, so repeated
rows, equal ids and a null id need no rule.  Columns beyond the two that are named are
not read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import slices, text_bytes

SYMBOLS = rb"#*$%&|<>"
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_END = (".", "!", "?", "…", ":", ";", "。", "！", "？", "」", "\"", "'", ")", "]", "»", "”", "’")
_MENU = re.compile(r"\||»|›|>|•|·|::")
_SHOUT = re.compile(r"[!?#*$%&<>|~=_^]{2,}(?!\S)|(?<!\S)[!?#*$%&<>|~=_^]{2,}")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript",
    "lorem ipsum", "click here", "read more", "sign in", "sign up", "log in", "subscribe", "newsletter",
    "share this", "skip to content", "skip to main content", "copyright", "©", "back to top", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the base rules of a document."""

    max_shouted: float = 0.3          #: share of words that carry runs of punctuation or symbols
    menu_items: int = 3               #: separators from which a line may be navigation
    menu_words: float = 3.0           #: ... if at most so many words stand between two
    short_words: int = 4              #: words up to which a line without end punctuation is a fragment
    boilerplate_words: int = 25       #: words up to which a boilerplate phrase condemns the line
    max_echo: float = 0.5             #: share of words equal to the word before
    max_loss: float = 0.5             #: share of words that a document may lose
    min_words: int = 20               #: base rule
    max_repeat: float = 0.30          #: base rule: share of words inside repeated windows
    window: int = 8                   #: words of such a window


def line_fault(line: str, n_words: int, rules: LineRules, seen: bool, phrases: list[str]) -> str | None:
    """The rule that a line fails: ``repeated``, ``navigation``, ``punctuation`` or ``boilerplate``; else None.

    ``phrases``: the boilerplate phrases that occur anywhere in the text, in lower case.
    """
    if seen:
        return "repeated"
    marks = len(_MENU.findall(line))
    if marks >= rules.menu_items and n_words <= (marks + 1) * (rules.menu_words + 1):
        return "navigation"
    if n_words > 1 and len(_SHOUT.findall(line)) > rules.max_shouted * n_words:
        return "punctuation"
    if n_words <= rules.short_words and not line.rstrip().endswith(_END):
        return "punctuation"
    if phrases and n_words <= rules.boilerplate_words and any(x in line.lower() for x in phrases):
        return "boilerplate"
    words = line.split()
    if sum(map(str.__eq__, words, words[1:])) > rules.max_echo * len(words):
        return "boilerplate"
    return None


def clean_lines(text: bytes, rules: LineRules) -> tuple[list[str], int, int]:
    """Lines that stay, number of words in them, number of lines (with a word) equal to an earlier one."""
    kept, words, repeated, seen = [], 0, 0, set()
    whole = text.decode("utf-8", "replace").lower()
    phrases = [x for x in BOILERPLATE if x in whole]
    for raw in text.split(b"\n"):
        if own := len(raw.split()):
            again = raw in seen
            seen.add(raw)
            repeated += again
            line = raw.decode("utf-8", "replace")
            if line_fault(line, own, rules, again, phrases) is None:
                kept.append(line)
                words += own
    return kept, words, repeated


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    # Equal windows have equal hashes: most texts end here.
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + (mixed[k:k + n] ^ (mixed[k:k + n] >> np.uint64(31)))
    hashed.sort()
    if (hashed[1:] != hashed[:-1]).all():
        return 0
    # By doubling, pairs of exact codes become one exact code.
    code, width = ids.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        pairs = code[: len(code) - step] * np.int64(len(words) + 1) + code[step:]
        code = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width += step
    starts = np.flatnonzero(np.bincount(code)[code] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def judge(text: bytes, rules: LineRules) -> dict:
    words = text.split()
    kept, kept_words, repeated = clean_lines(text, rules)
    again = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * again > round(100 * rules.max_repeat) * len(words)
    return {
        "text": "\n".join(kept), "n_words": len(words), "n_kept_words": kept_words,
        "word_chars": len(b"".join(words).decode("utf-8", "replace")), "n_symbols": len(_SYMBOL.findall(text)),
        "n_dup_lines": repeated, "n_repeat_words": again, "base_failed": failed,
        "kept": not failed and kept_words >= (1 - rules.max_loss) * len(words),
    }


SCHEMA = (
    "doc_id long, text string, n_words long, n_kept_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean"
)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per document: the cleaned text, the counts of its whole text and the verdict.

    Needs ``doc_id`` and ``text``.  No shuffle; a task holds a slice of a batch.
    """
    out = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), *((c, pa.int64()) for c in (
            "n_words", "n_kept_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = judge(text, rules)
                if not with_text:
                    row["text"] = None
                rows.append({"doc_id": doc_id, **row})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, SCHEMA)
