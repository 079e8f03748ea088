"""Alignment of the tokens of two tokenizers by elementary intervals.

Both tokenizers cut the same bytes, so the union of both end arrays cuts them into
elementary intervals; a binary search in each array finds the two tokens that own an
interval, and each interval is one overlap. Where both tokens end there, a group
closes: the smallest stretch that both cut alike. :func:`expand` gives the pairs of a
group's product, ``LINKS`` names what a caller may count as a link.

A is a tokenizers file of byte-level BPE that reads a space and the text, B a
sentencepiece BPE model whose normaliser is the identity and which adds that space
itself. Neither lets a token run on across a space that follows a character other than
white space (B as none of its pieces holds a space behind another character, which is
looked up), so texts are cut at those spaces, each distinct chunk is aligned once and a
bounded table keeps what recent chunks gave. Special strings in a text are plain text.

An id pair's count is over the whole corpus: documents keep their distinct pairs
compressed, pairs are counted by a combined shuffle, and counts come back in two ways.
Pairs that make up one in ``HOT_PAIRS`` of all links, at most that many, are sent to
all tasks; the rest meet the documents that hold them in a join, where none of them
has more than that share of the rows.

Defined cases: a text that is null, empty, or whose tokens' bytes of A or of B don't
join to a space and the text (as one with U+2581 in it) has no tokens: zeros, no groups
and the empty string for their digest; texts are read whole; rows that repeat an id or
a text each give a row and each count; a null id is a row like any other; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import BYTE_OF
from .common import cut, per_text

#: Chunks whose alignment a worker keeps in each of two tables, and the longest one kept.
KEPT_CHUNKS, KEPT_CHARS = 250_000, 64
#: Pairs that are sent to all tasks have at least this share of all links.
HOT_PAIRS = 1 << 16
#: Pairs a task gathers before it counts them.
GATHERED = 1 << 21
#: A space at a text's end is no chunk: B, whose own space would be all of it, gives nothing for an empty text.
BREAK = re.compile(r"(?s)(?<=\S) (?=.)")
#: Where the cuts are not simply all spaces.
ODD = re.compile(r"\s | $")
#: What is a link: tokens that end together, tokens that overlap, all tokens of a group.
LINKS = ("ends", "overlaps", "products")


class Intervals(NamedTuple):
    """Elementary intervals: where each ends, the tokens that own it, whether it closes a group."""

    ends: np.ndarray
    own_a: np.ndarray
    own_b: np.ndarray
    closes: np.ndarray


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> Intervals:
    """Of two arrays of token ends that have their last end in common."""
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return Intervals(ends, own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends))


def group_sizes(cut_up: Intervals) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group."""
    return tuple(np.diff(own[cut_up.closes] + 1, prepend=0) for own in (cut_up.own_a, cut_up.own_b))


def expand(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all pairs of each group's product."""
    products = sizes_a * sizes_b
    group = np.repeat(np.arange(len(products)), products)
    nth = np.arange(len(group)) - (np.cumsum(products) - products)[group]
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    return first_a[group] + nth // sizes_b[group], first_b[group] + nth % sizes_b[group]


class Aligned(NamedTuple):
    """What a stretch of text comes to; links are pairs packed as A's id << 32 | B's id. Of a chunk, the groups end in a semicolon."""

    n_a: int
    n_b: int
    n_groups: int
    n_overlaps: int
    n_links: int
    groups: str
    links: bytes


class Aligner:
    """Aligns texts; one for each worker, pair of vocabularies and kind of link."""

    def __init__(self, path_a: str, path_b: str, links: str = "ends"):
        if links not in LINKS:
            raise ValueError(f"links are {', '.join(LINKS)}")
        self.links = links
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [bytes(BYTE_OF.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: What a token is called before another of its own (even) and before the other tokenizer's (odd).
        self.names = [f"{i}{end}" for size, ends in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for i in range(size) for end in ends]
        self.size_a, self.size_b = (np.array([len(b) for b in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.kept: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and of B for a text that begins with a space; none if they don't spell it."""
        if "▁" in text:
            return None
        a, b, raw = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]), text.encode()
        spelt = all(b"".join(map(known.__getitem__, i)) == raw for known, i in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if spelt else None

    def _aligned(self, chunks: list[str], ids: tuple[list[int], list[int]]) -> Iterator[Aligned]:
        """Of chunks whose joined tokens are given and end at each chunk's end."""
        a, b = (np.array(i, np.int64) for i in ids)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut_up = intervals(ends_a, ends_b)
        n_a, n_b = group_sizes(cut_up)
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        if self.links == "ends":
            at_a, at_b, per_group = last_a - 1, last_b - 1, np.ones(len(n_a), np.int64)
        elif self.links == "overlaps":
            at_a, at_b, per_group = cut_up.own_a, cut_up.own_b, np.diff(np.flatnonzero(cut_up.closes), prepend=-1)
        else:
            (at_a, at_b), per_group = expand(n_a, n_b), n_a * n_b
        pairs = (a[at_a] << 32 | b[at_b]).astype("<i8").tobytes()
        # Each token's name with what follows it, a group's tokens of A before those of B.
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + (last_b - n_b)[group_a]] = 2 * a + np.isin(np.arange(len(a)), last_a - 1)
        names[np.arange(len(b)) + last_a[group_b]] = 2 * (len(self.bytes_a) + b) + np.isin(np.arange(len(b)), last_b - 1)
        shown = list(map(self.names.__getitem__, names.tolist()))
        sizes = np.cumsum([len(c.encode()) + 1 for c in chunks])
        closed, met = np.searchsorted(cut_up.ends[cut_up.closes], sizes), np.searchsorted(cut_up.ends, sizes) + 1
        upto = [last_a[closed], last_b[closed], closed + 1, met, np.cumsum(per_group)[closed]]
        begin = link = 0
        for n, m, g, o, k in zip(*(np.diff(u, prepend=0).tolist() for u in upto)):
            yield Aligned(n, m, g, o, k, "".join(shown[begin : begin + n + m]), pairs[8 * link : 8 * (link + k)])
            begin, link = begin + n + m, link + k

    def _several(self, chunks: list[str]) -> Iterator[tuple[str, Aligned | None]]:
        if not chunks:
            return
        both = self.ids(" " + " ".join(chunks))
        if both:
            # The cuts were sound if both tokenizers have ends at them.
            sizes = np.cumsum([len(c.encode()) + 1 for c in chunks])
            if all(np.isin(sizes, np.cumsum(size[np.array(i, np.int64)])).all() for size, i in zip((self.size_a, self.size_b), both)):
                yield from zip(chunks, self._aligned(chunks, both))
                return
        if len(chunks) == 1:
            yield chunks[0], None
            return
        half = len(chunks) // 2
        yield from self._several(chunks[:half])
        yield from self._several(chunks[half:])

    def _learn(self, chunks: set[str]) -> dict[str, Aligned | None]:
        """Of each chunk, named without the space that it begins with."""
        known, new = {}, []
        kept, older = self.kept, self.older
        for c in chunks:
            if c in kept:
                known[c] = kept[c]
            elif c in older:
                known[c] = kept[c] = older[c]
            else:
                new.append(c)
        # Behind white space another chunk's space would not be a place to cut; what only one tokenizer spells is met alone.
        joined = [c for c in new if c and not c[-1].isspace() and "▁" not in c]
        found = dict(self._several(joined))
        for c in set(new).difference(joined):
            found.update(self._several([c]))
        known.update(found)
        kept.update((c, x) for c, x in found.items() if len(c) <= KEPT_CHARS)
        if len(kept) > KEPT_CHUNKS:
            self.older, self.kept = kept, {}
        return known

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """Of each text; none where it has no tokens."""
        cuts = []
        for t in texts:
            if not t:
                cuts.append([])
            elif not self.cuttable:
                cuts.append([t])
            else:
                # Chunks are named without their space; the first one's is not in the text.
                cuts.append(BREAK.split(t) if ODD.search(" " + t) else t.split(" "))
        known, out = self._learn({c for chunks in cuts for c in chunks}), []
        for chunks in cuts:
            met = [known[c] for c in chunks]
            if not met or None in met:
                out.append(None)
                continue
            n_a, n_b, n_groups, n_overlaps, n_links, groups, links = zip(*met)
            out.append(Aligned(sum(n_a), sum(n_b), sum(n_groups), sum(n_overlaps), sum(n_links), "".join(groups)[:-1], b"".join(links)))
        return out


@lru_cache(maxsize=3)
def aligner(path_a: str, path_b: str, links: str = "ends") -> Aligner:
    return Aligner(path_a, path_b, links)


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text), a_ids, b_ids, and the groups: end (in bytes of a space and the text), tokens of A and of B."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def run(texts: list[str]) -> dict[str, pa.Array]:
        own, a_ids, b_ids, groups = aligner(path_a, path_b), [], [], []
        for t in texts:
            a, b = (own.ids(" " + t) if t else None) or ([], [])
            ends = [np.cumsum(size[np.array(i, np.int64)]) for size, i in ((own.size_a, a), (own.size_b, b))]
            cut_up = intervals(*ends)
            a_ids.append(a)
            b_ids.append(b)
            groups.append([{"end": e, "n_a": x, "n_b": y} for e, x, y in zip(cut_up.ends[cut_up.closes].tolist(), *(n.tolist() for n in group_sizes(cut_up)))])
        shape = pa.list_(pa.struct([("end", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32())]))
        return {"a_ids": pa.array(a_ids, pa.list_(pa.int32())), "b_ids": pa.array(b_ids, pa.list_(pa.int32())), "groups": pa.array(groups, shape)}

    return per_text(df, run, "a_ids array<int>, b_ids array<int>, groups array<struct<end:bigint,n_a:int,n_b:int>>", text_col, keep)


NUMBERS = ["n_a", "n_b", "n_groups", "n_overlaps", "n_links"]


def _packed(links: bytes) -> bytes:
    """Distinct pairs in order and how often each is linked."""
    links = np.sort(np.frombuffer(links, "<i8"))
    first = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]])[: len(links)])
    pairs, times = links[first], np.diff(first, append=len(links))
    return zstandard.compress(pairs.tobytes() + times.astype("<i8").tobytes(), 1) if len(pairs) else b""


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed) if packed else b"", "<i8").reshape(2, -1)


def aligned(df: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), id, numbers, groups_sha256 and pairs (packed) of every row."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        found = aligner(path_a, path_b, links).align(texts)
        numbers = {n: pa.array([getattr(x, n) if x else 0 for x in found], pa.int64()) for n in NUMBERS}
        return numbers | {
            "groups_sha256": pa.array([hashlib.sha256(x.groups.encode()).hexdigest() if x else "" for x in found]),
            "pairs": pa.array([_packed(x.links) if x else b"" for x in found], pa.binary()),
        }

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = per_text(source, run, ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string, pairs binary", "text", ["id"])
    return cut(made.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, n (links that hold it) and best (no pair of its B has more) of the rows of :func:`aligned`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> np.ndarray:
            both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
            pairs, at = np.unique(both[0], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, both[1])
            return np.stack([pairs, sums])

        def sent(both: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["pair", "n"])

        parts, size = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                parts.append(_unpacked(packed))
                size += parts[-1].shape[1]
                if size >= GATHERED:
                    parts = [counted(parts)]
                    size = parts[0].shape[1]
                    if 2 * size >= GATHERED:
                        yield sent(parts[0])
                        parts, size = [], 0
        if size:
            yield sent(counted(parts))

    counts = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)})
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(df: DataFrame, path_a: str, path_b: str, links: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, numbers, n_best (links whose pair is the most frequent of its B), count_sum (of the links' pairs) and groups_sha256 of every row."""
    rows = aligned(df, path_a, path_b, links, id_col, text_col)
    counts = cut(pair_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= total / HOT_PAIRS
    hot = sorted((r["pair"], r["n"], r["best"]) for r in counts.filter(frequent).select("pair", "n", "best").collect())
    hot_pairs, hot_n, hot_best = np.array([h[0] for h in hot], np.int64), np.array([h[1] for h in hot], np.int64), np.array([h[2] for h in hot], bool)

    def looked_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(hot_pairs, pairs), max(0, len(hot_pairs) - 1))
        return at, hot_pairs[at] == pairs if len(hot_pairs) else np.zeros(len(pairs), bool)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sums = [], []
            for packed in batch.column(1).to_pylist():
                pairs, times = _unpacked(packed)
                at, met = looked_up(pairs)
                at, times = at[met], times[met]
                best.append(int(times[hot_best[at]].sum()))
                sums.append(int((times * hot_n[at]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(best, pa.int64()), pa.array(sums, pa.int64())], names=shown)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                both = [_unpacked(packed) for packed in part.column(1).to_pylist()]
                both = [x[:, ~looked_up(x[0])[1]] for x in both]
                row = np.repeat(part.column(0).to_numpy(), [x.shape[1] for x in both])
                pairs, times = np.concatenate(both, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pairs), pa.array(times)], names=["row", "pair", "times"])

    shown = ["row", "id", *NUMBERS, "groups_sha256", "hot_best", "hot_sum"]
    told = rows.select("row", "pairs", *shown[1:-2]).mapInArrow(known, f"row long, id long, {', '.join(f'{n} long' for n in NUMBERS)}, groups_sha256 string, hot_best long, hot_sum long")
    cold = rows.select("row", "pairs").mapInArrow(asked, "row long, pair long, times long").join(counts.filter(~frequent).select("pair", "n", "best"), "pair")
    cold = cold.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("cold_best"), F.sum(F.col("times") * F.col("n")).alias("cold_sum"))
    zero = F.lit(0).cast("long")
    return told.join(cold, "row", "left").select(
        F.col("id").alias(id_col),
        *NUMBERS,
        (F.col("hot_best") + F.coalesce("cold_best", zero)).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("cold_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
