r"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are brought to words (\w+, lower-cased) between single spaces,
with one more space at both ends. An item of n characters may differ from a
passage by k = floor(rate * n) edits. It is split into k + 1 pieces, of which
such a passage must hold at least one unchanged; an automaton over all pieces
finds these in one pass of the text, each hit tells where the item would lie, and
Myers' bit-parallel distance decides over that stretch. All stretches that hits
point to are verified; nothing is capped.

The items are sent to the tasks in blocks of about ``BLOCK_BYTES`` (by hash; one
longer item makes a larger block), each of which meets all texts.

Defined cases: a null text counts as empty and holds no item; an item without
words is found nowhere; an item too short for an edit is found as a phrase of
whole words; items that repeat a text are each reported; empty tables give empty
results; repeated rows each give their rows; other columns are ignored by
:func:`contaminations` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

RATE = 0.08
BLOCK_BYTES = 4 << 20
WORD = re.compile(r"\w+")


def plain(text: str | None) -> str:
    return f" {' '.join(WORD.findall((text or '').lower()))} "


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Start and end of budget + 1 pieces of about one length."""
    return [(n * i // (budget + 1), n * (i + 1) // (budget + 1)) for i in range(budget + 1)]


class Pattern:
    """An item as Myers' algorithm needs it: a bit for each character."""

    def __init__(self, text: str):
        self.size = len(text)
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the item to any part of ``text``, and the first end of such a part."""
        size, get = self.size, self.places.get
        mask, high = (1 << size) - 1, 1 << (size - 1)
        up, down, score = mask, 0, size
        least, end = size, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = down | ~(across | up) & mask
            minus = up & across
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < least:
                    least, end = score, j
            plus = plus << 1 & mask
            minus = minus << 1 & mask
            up = minus | ~(vertical | plus) & mask
            down = plus & vertical
        return least, end


class Hit(NamedTuple):
    item: int
    distance: int
    end: int


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[str], rate: float):
        self.items = [plain(t) for t in items]
        self.budgets = [int(rate * len(t)) for t in self.items]
        self.patterns: dict[int, Pattern] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (text, budget) in enumerate(zip(self.items, self.budgets)):
            if text.strip():
                for start, end in pieces(len(text), budget):
                    at.setdefault(text[start:end], []).append((n, end))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def hits(self, text: str) -> list[Hit]:
        if self.empty:
            return []
        body = plain(text)
        starts: dict[int, set[int]] = {}
        for last, places in self.automaton.iter(body):
            for n, end in places:
                starts.setdefault(n, set()).add(last + 1 - end)
        found = []
        for n, at in sorted(starts.items()):
            budget, pattern = self.budgets[n], self.patterns.get(n)
            if pattern is None:
                pattern = self.patterns[n] = Pattern(self.items[n])
            best: tuple[int, int] | None = None
            for low, high in _stretches(sorted(at), budget, len(self.items[n])):
                low = max(0, low)
                distance, end = pattern.best(body[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, low + end
            if best:
                found.append(Hit(n, *best))
        return found


def _stretches(starts: list[int], budget: int, size: int) -> Iterator[tuple[int, int]]:
    """What the item may cover from each start, overlapping stretches joined."""
    low, high = None, None
    for start in starts:
        if high is not None and start - budget <= high:
            high = start + size + budget
            continue
        if high is not None:
            yield low, high
        low, high = start - budget, start + size + budget
    if high is not None:
        yield low, high


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, about BLOCK_BYTES at a time."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["id"], r["text"]) for r in part.collect()]


def contaminations(df: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each text and item found in it: id_col, item_col, distance and the end of the nearest passage in the plain text."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = None
    for block in blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = Finder([t for _, t in block], rate)
            for b in batches:
                rows = [(i, block[h.item][0], h.distance, h.end) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in finder.hits(t)]
                columns = zip(*rows) if rows else [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "item", "distance", "end"])

        part = source.mapInArrow(run, "id long, item long, distance int, end int")
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "end")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no item."""
    at = df.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = Finder([t for _, t in block], rate)
            for b in batches:
                yield b.filter(pa.array([not finder.hits(t) for t in b.column(at).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
