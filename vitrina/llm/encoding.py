"""Encoding whole texts with a public tokenizer, exactly and fast.

Byte-pair encoders work inside pieces: runs of letters, runs of marks, white space.  A
space starts the piece after it or is dropped.  A text is therefore cut at single spaces
between visible characters, and a chunk of the usual form (letters, marks, perhaps a line
break and the same again) into its runs.  Runs of letters are encoded many at once in one
string and remembered, as are chunks of the usual form; other chunks are encoded as they are.  Where a border isn't of that
kind (runs of spaces, control characters), chunks stay joined, so the ids are those of the
whole text.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

from vitrina.llm.common import KEPT

#: Runs and chunks that a worker process remembers, and those of one batch; a full memory is emptied before the next batch.
REMEMBERED = 600_000
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_USUAL = re.compile(f"({_LETTERS})({_MARKS})(?:(\n)({_LETTERS})({_MARKS}))?")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible(c: str) -> bool:
    return c.isprintable() and not c.isspace()


class TextEncoder:
    """``encode_many(texts)``: the ids of each text as little-endian unsigned 32-bit integers.

    ``spaces_join``: a space belongs to the word after it (byte-level vocabularies);
    otherwise the vocabulary drops white space and marks the ends of pieces.  Strings of
    special tokens that occur in a text are encoded as ordinary text.
    """

    def __init__(self, path: str, spaces_join: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces_join, self.remembered = spaces_join, REMEMBERED
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(pieces.values()) + 1, bool)
        for piece, i in pieces.items():
            self.border[i] = piece.startswith("Ġ") if spaces_join else piece.endswith("</w>")
        self.line = self._encode(["\n"])[0]
        #: Ids of runs of letters and of chunks made of them, by what stands before them, and of runs of marks.
        self.known: dict[str, dict[str, bytes | None]] = {" ": {}, "": {}}
        self.marks: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str, spaces_join: bool, remembered: int | None = None) -> "TextEncoder":
        """One encoder per worker process and vocabulary, until a task of another kind comes."""
        name = cls.kept_as(path, spaces_join)
        if name not in KEPT:
            KEPT[name] = cls(path, spaces_join)
        KEPT[name].remembered = REMEMBERED if remembered is None else remembered
        return KEPT[name]

    @staticmethod
    def kept_as(path: str, spaces_join: bool) -> str:
        return f"{path} {spaces_join}"

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str], before: str) -> list[bytes]:
        """Ids of each run of letters, with ``before`` in front: one call, cut at the borders."""
        if not runs:
            return []
        if not self.spaces_join:
            ids = self._ids(" ".join(runs))
            ends = np.flatnonzero(self.border[ids]) + 1
            starts = np.concatenate([[0], ends[:-1]])
        elif before:
            ids = self._ids(" " + " ".join(runs))
            starts = np.flatnonzero(self.border[ids])
            ends = np.append(starts[1:], len(ids))
        else:
            ids = self._ids("\n".join(runs) + "\n")
            ends = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
            starts = np.concatenate([[0], ends[:-1] + 1])
        if len(starts) != len(runs):
            return self._encode([before + r for r in runs])
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]

    def _plain(self, chunk: str) -> bool:
        return not self.spaces_join or (chunk != "" and _visible(chunk[0]) and _visible(chunk[-1]))

    def _known_runs(self, runs: set[str], before: str) -> dict[str, bytes]:
        known = self.known[before]
        new = list(runs - known.keys())
        known.update(zip(new, self._encode_runs(new, before), strict=True))
        return known

    def _known_marks(self, marks: set[str]) -> dict[str, bytes]:
        new = list(marks - self.marks.keys())
        self.marks.update(zip(new, self._encode(new), strict=True))
        return self.marks

    def _learn(self, chunks: set[str], before: str) -> list[str]:
        """Ids of each chunk that isn't known yet; None for those that can't stand alone.

        Returns the chunks of no usual form, which may be long: they are known until the end of a batch only.
        """
        known = self.known[before]
        words, usual, odd = set(), [], []
        for c in chunks - known.keys():
            if c.isalpha() and c.isascii():
                words.add(c)
            elif match := _USUAL.fullmatch(c):
                usual.append((c, *match.groups("")))
            else:
                odd.append(c)
        broken = self._known_runs({u[4] for u in usual if u[3]}, "")
        mark = self._known_marks({u[k] for u in usual for k in (2, 5)})
        self._known_runs(words.union(u[1] for u in usual), before)
        for c, a, b, line, d, e in usual:
            known[c] = known[a] + mark[b] + self.line + broken[d] + mark[e] if line else known[a] + mark[b]
        whole = [c for c in odd if self._plain(c)]
        known.update((c, None) for c in odd)
        known.update(zip(whole, self._encode([before + c for c in whole]), strict=True))
        return odd

    def _joined(self, parts: list[str]) -> list[str]:
        """Chunks again, joined wherever the border is no plain one."""
        runs = [[parts[0]]]
        for part in parts[1:]:
            last = runs[-1][-1]
            if part and last and _visible(last[-1]) and _visible(part[0]):
                runs.append([" " + part])
            else:
                runs[-1].append(" " + part)
        return ["".join(run) for run in runs]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # chunks make no cycles, and looking for some takes a tenth of the time
        try:
            return self._encode_many(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        # Only between batches, as what a batch looks up must stay until its end.
        for memory in (*self.known.values(), self.marks):
            if len(memory) > self.remembered:
                memory.clear()
        self.marks[""] = b""
        space = " " if self.spaces_join else ""
        split = [t.split(" ") for t in texts]
        odd = [("", self._learn({p[0] for p in split}, "")), (space, self._learn(set().union(*(p[1:] for p in split)), space))]
        first, later = self.known[""], self.known[space]
        out = []
        for parts in split:
            ids = [first[parts[0]], *map(later.__getitem__, parts[1:])]
            try:
                out.append(b"".join(ids))
            except TypeError:  # a chunk with an edge that isn't plain
                out.append(b"".join(self._encode(self._joined(parts))))
        for before, chunks in odd:
            for c in chunks:
                self.known[before].pop(c, None)
        return out
