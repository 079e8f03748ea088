"""Repeated byte strings by common-prefix intervals of enhanced suffix arrays.

A string of ``least`` bytes is repeated when it also starts anywhere else, in the same
text or another; every byte that a repeated string covers is removed.

Suffixes that may be alike meet in one suffix array as follows. Of all strings of
``GRAM`` bytes within a string of ``least`` bytes, the one with the smallest hash (the
leftmost of equals) is its anchor, so equal strings have equal anchors at equal places. A
run of neighbouring starts with one anchor is a context: the bytes that its strings
cover. Contexts with an anchor that stands nowhere else hold no repeated string; that
is found from hashes alone, before any text moves. Texts stay, compressed, in leaves of
bounded size; a leaf is told which of its anchors are repeated, resolves contexts that
it holds several times itself and sends each distinct one once, by anchor.

A task sorts the suffixes at the contexts' starts (ranks of 8 bytes, tripled), takes the
common prefixes of neighbours and scans them with a stack, which gives the tree of
common-prefix intervals. An interval's strings are a maximal repeat if the bytes before
them differ, or one is a context's first; all occurrences of each such repeat are
covered for its whole length. Any two equal strings are covered so: going left from
both while the bytes agree ends in an interval that is reported and is at least as
much longer. An anchor with more occurrences than fit an array (or a third of all
rows) is met differently: its contexts are dealt out by their digests, equal ones
resolved there, and the strings of those that stand alone meet by 128-bit digests.

Defined cases: a null text counts as empty; texts are judged whole, as UTF-8; rows that
repeat an id are different texts, so a repeated row of ``least`` bytes or more goes
whole on both sides; shorter texts lose nothing; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, text_or_empty

#: Bytes of an anchor.
GRAM = 32
#: Text in a block, which is compressed as one, and in a leaf, about; a longer text is a leaf of its own.
BLOCK_BYTES, LEAF_BYTES, LEVEL = 1 << 18, 1 << 23, 6
#: Bytes whose anchors are looked for at once; a place takes that many bits beside its hash.
PIECE_BITS = 20
#: Positions of a suffix array: three ranks fit into 63 bits. Gathered before one is built, about.
RANK_BITS, GATHERED = 21, 1 << 18
#: Odd constants that mix bits (fixed values of the splitmix64 generator and the golden ratio).
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Kinds of rows: spans that are known, contexts, contexts of frequent anchors, strings.
SPANS, CONTEXT, FREQUENT, STRING = range(4)
SENT = "kind int, k1 long, k2 long, leaf long, nth int, at long, bytes binary"


class Anchors(NamedTuple):
    """Runs of starts with one anchor: text, first and last start in it, and the anchor's hash."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray


def _pieces(texts: list[bytes], least: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of texts for :func:`anchors` to look at together, and whose they are, from where on, and where they end."""
    size, held, filled = 1 << PIECE_BITS, [], 0
    for n, text in enumerate(texts):
        at = 0
        while len(text) - at >= least:
            # A long text's stretches overlap by one byte less than a string, so each start is in one of them.
            part = text[at : at + size]
            if held and filled + len(part) > size:
                yield _piece(held)
                held, filled = [], 0
            held.append((n, at, part))
            filled += len(part)
            at += len(part) - least + 1
    if held:
        yield _piece(held)


def _piece(held: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    owner, at, parts = zip(*held)
    return b"".join(parts), np.array(owner), np.array(at), np.cumsum([len(p) for p in parts])


def anchors(texts: list[bytes], least: int) -> Anchors:
    """All anchored runs of starts of strings of ``least`` bytes."""
    width, found = least - GRAM + 1, []
    if width < 1:
        raise ValueError(f"least is {GRAM} or more")
    for raw, owner, origin, ends in _pieces(texts, least):
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        m = len(raw) - GRAM + 1
        h = words[:m] * MIX[0]
        for k in range(8, GRAM, 8):
            h ^= h >> np.uint64(31)
            h += words[k : k + m]
            h *= MIX[1]
        h ^= h >> np.uint64(32)
        h *= MIX[2]
        h ^= h >> np.uint64(29)
        low = np.uint64((1 << PIECE_BITS) - 1)
        smallest, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * span <= width:
            smallest = np.minimum(smallest[:-span], smallest[span:])
            span *= 2
        if width > span:
            smallest = np.minimum(smallest[: span - width], smallest[width - span :])
        place = (smallest & low).astype(np.int64)
        # Strings that would run into the next stretch are none.
        edge = np.zeros(len(place) + 1, np.int32)
        np.add.at(edge, np.minimum(np.maximum(ends - least + 1, 0), len(place)), 1)
        np.add.at(edge, np.minimum(ends, len(place)), -1)
        place[np.cumsum(edge[:-1]) > 0] = -1
        turn = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate([[0], turn]), np.concatenate([turn, [len(place)]]) - 1
        real = place[first] >= 0
        first, last = first[real], last[real]
        part = np.searchsorted(ends, first, "right")
        shift = origin[part] - np.concatenate([[0], ends[:-1]])[part]
        found.append((owner[part], first + shift, last + shift, h[place[first]].view(np.int64)))
    return Anchors(*map(np.concatenate, zip(*found))) if found else Anchors(*[np.zeros(0, np.int64)] * 4)


class Repeat(NamedTuple):
    """A maximal repeat: its length and all its starts (places in the array's bytes)."""

    length: int
    starts: np.ndarray


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.concatenate([np.zeros(1, np.int64), np.cumsum(ordered[1:] != ordered[:-1])]) if len(keys) else 0
    return out


class SuffixArray:
    """Suffixes of several strings at their first ``owned`` places each, in order, with the common prefixes of neighbours."""

    def __init__(self, strings: list[bytes], owned: list[int], least: int):
        self.least = least
        sizes, pad = np.array([len(s) for s in strings]), b"\0" * 8
        self.raw = np.frombuffer(b"".join([x for s in strings for x in (s, pad)]), np.uint8)
        self.begins = np.cumsum(sizes + 8) - sizes - 8
        n = len(self.raw) - 7
        if n >> RANK_BITS:
            raise ValueError("too many bytes for one array")
        # Behind a string's end everything is zero; so where ranks tie, the shorter string comes first.
        self.end = np.repeat(self.begins + sizes, sizes + 8)[:n]
        here = np.minimum(np.arange(n), self.end)
        words = np.ndarray((n,), ">u8", self.raw, strides=(1,)).astype(np.uint64)
        self.ranks, size = {8: _ranked(words[here])}, 8
        while 2 * size < sizes.max():
            r = self.ranks[size]
            self.ranks[3 * size] = _ranked(r << np.uint64(2 * RANK_BITS) | r[np.minimum(here + size, self.end)] << np.uint64(RANK_BITS) | r[np.minimum(here + 2 * size, self.end)])
            size *= 3
        starts = np.concatenate([np.arange(b, b + k) for b, k in zip(self.begins.tolist(), owned)])
        r, end = self.ranks[size], self.end[starts]
        order = np.argsort(r[starts] << np.uint64(2 * RANK_BITS) | r[np.minimum(starts + size, end)] << np.uint64(RANK_BITS) | (end - starts).astype(np.uint64))
        self.suffixes = starts[order]
        self.first = np.isin(self.suffixes, self.begins)
        self.prefixes = self._prefixes()

    def _prefixes(self) -> np.ndarray:
        """Common prefixes of neighbours, where they are ``least`` or more; else zero."""
        out = np.zeros(max(0, len(self.suffixes) - 1), np.int64)
        size = max([s for s in self.ranks if s <= self.least], default=0)
        at = np.arange(len(out)) if not size else np.flatnonzero(self.ranks[size][self.suffixes[:-1]] == self.ranks[size][self.suffixes[1:]])
        i, j = self.suffixes[at], self.suffixes[at + 1]
        most = np.minimum(self.end[i] - i, self.end[j] - j)
        common = np.zeros(len(at), np.int64)
        for size in sorted(self.ranks, reverse=True):
            r = self.ranks[size]
            for _ in range(2 if size > 8 or len(self.ranks) > 1 else int(most.max(initial=0)) // 8 + 1):
                common += np.where(r[np.minimum(i + common, self.end[i])] == r[np.minimum(j + common, self.end[j])], size, 0)
        for _ in range(7):
            common += self.raw[np.minimum(i + common, self.end[i])] == self.raw[np.minimum(j + common, self.end[j])]
        common = np.minimum(common, most)
        out[at] = np.where(common >= self.least, common, 0)
        return out

    def repeats(self) -> Iterator[Repeat]:
        """All maximal repeats, an interval's parents before it."""
        for low, high, length in sorted(self._intervals(), key=lambda x: x[2]):
            yield Repeat(length, self.suffixes[low : high + 1])

    def _intervals(self) -> Iterator[tuple[int, int, int]]:
        """First and last suffix and common prefix of the intervals whose strings differ in the byte before them."""
        long = np.flatnonzero(self.prefixes)
        if not len(long):
            return
        # A context's first start has no byte before it that counts: it differs from all.
        left = np.where(self.first, 256, self.raw[self.suffixes - 1].astype(np.int64))
        differs = np.cumsum(np.concatenate([[0], (left[1:] != left[:-1]) | self.first[1:] | self.first[:-1]]))
        breaks = np.flatnonzero(np.diff(long) > 1)
        outer = zip(long[np.concatenate([[0], breaks + 1])].tolist(), long[np.concatenate([breaks, [len(long) - 1]])].tolist())
        for low, high in outer:
            if differs[high + 1] == differs[low]:
                continue  # what lies within an interval of one byte before has that byte too
            open_at: list[tuple[int, int]] = []
            for at, common in enumerate([*self.prefixes[low : high + 1].tolist(), 0], low):
                begin = at
                while open_at and open_at[-1][1] > common:
                    begin, length = open_at.pop()
                    if differs[at] != differs[begin]:
                        yield begin, at, length
                if common and (not open_at or open_at[-1][1] < common):
                    open_at.append((begin, common))

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, first byte and byte behind the last of all stretches that repeats cover."""
        length, at = np.zeros(len(self.suffixes), np.int64), np.zeros(len(self.raw), np.int64)
        for low, high, common in sorted(self._intervals(), key=lambda x: x[2]):
            length[low : high + 1] = common
        at[self.suffixes] = length
        starts = np.flatnonzero(at)
        low, high = united(starts, starts + at[starts])
        string = np.searchsorted(self.begins, low, "right") - 1
        return string, low - self.begins[string], high - self.begins[string]


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches, those that touch as one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])]


def capacity(least: int) -> int:
    """Contexts that surely fit one suffix array, half of it left to what was gathered before."""
    return (1 << (RANK_BITS - 1)) // (2 * least - GRAM + 8)


def _stored(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """leaf, nth (place of the first text in the leaf), ids, sizes and blob of every block of texts."""
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, nth, filled, size = TaskContext.get().partitionId() << 32, 0, 0, 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def block() -> pa.RecordBatch:
            sizes, blob = list(map(len, texts)), zstandard.compress(b"".join(texts), LEVEL)
            made = [pa.array([leaf], pa.int64()), pa.array([nth - len(texts)], pa.int32()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(made, names=["leaf", "nth", "ids", "sizes", "blob"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block()
                    size = 0
                if filled and filled + len(text) > LEAF_BYTES:
                    if texts:
                        yield block()
                    leaf, nth, filled, size = leaf + 1, 0, 0, 0
                ids.append(i)
                texts.append(text)
                nth, filled, size = nth + 1, filled + len(text) + 64, size + len(text) + 64
        if texts:
            yield block()

    return cut(source.mapInArrow(run, "leaf long, nth int, ids array<bigint>, sizes array<bigint>, blob binary"))


def _texts(sizes: list[list[int]], blobs: list[bytes]) -> list[bytes]:
    """The texts of blocks, in order."""
    out = []
    for own, blob in zip(sizes, blobs):
        raw, at = zstandard.decompress(blob), 0
        for n in own:
            out.append(raw[at : at + n])
            at += n
    return out


def _places(firsts: list[int], sizes: list[list[int]]) -> list[int]:
    return [nth + k for nth, own in zip(firsts, sizes) for k in range(len(own))]


def _repeated_anchors(stored: DataFrame, least: int) -> DataFrame:
    """leaf, key and total of the anchors that stand more than once, for each leaf that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for leaf, held in groupby(rows, key=lambda r: r[0]):
            _, sizes, blobs = zip(*held)
            keys, times = np.unique(anchors(_texts(sizes, blobs), least).key, return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), leaf)), pa.array(keys), pa.array(times)], names=["leaf", "key", "n"])

    asked = stored.select("leaf", "sizes", "blob").mapInArrow(run, "leaf long, key long, n long")
    # A key has a row for each leaf at most.
    return asked.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).filter("total > 1").select("leaf", "key", "total")


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 7
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "k1", "k2", "leaf", "nth", "at", "bytes"])


def _spans(leaf: int, nth: int, starts: np.ndarray, ends: np.ndarray) -> tuple:
    return SPANS, leaf, nth, leaf, nth, 0, np.stack([starts, ends]).astype("<i8").tobytes()


def _signed(digest: int) -> tuple[int, int]:
    return tuple(x - (1 << 64) if x >> 63 else x for x in (digest >> 64, digest & (1 << 64) - 1))


def _contexts(stored: DataFrame, told: DataFrame, least: int, most: int) -> DataFrame:
    """Spans that a leaf resolves itself, and each distinct context with a repeated anchor once."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _rows([])
        leaf, order = texts.column("leaf")[0].as_py(), np.argsort(told.column("key").to_numpy())
        keys, totals = told.column("key").to_numpy()[order], told.column("total").to_numpy()[order]
        sizes = texts.column("sizes").to_pylist()
        places, whole = _places(texts.column("nth").to_pylist(), sizes), _texts(sizes, texts.column("blob").to_pylist())
        found = anchors(whole, least)
        at = np.minimum(np.searchsorted(keys, found.key), len(keys) - 1)
        met = np.flatnonzero(keys[at] == found.key)
        groups: dict[tuple[int, int], list[int]] = {}
        text, first, last, key = (c[met].tolist() for c in found)
        for n, (t, low, high, k) in enumerate(zip(text, first, last, key)):
            groups.setdefault((k, xxhash.xxh3_128_intdigest(whole[t][low : high + least])), []).append(n)
        frequent, known, rows = (totals[at[met]] > most).tolist(), [], []
        for (k, digest), own in groups.items():
            n = own[0]
            kind, k2 = (FREQUENT, _signed(digest)[1]) if frequent[n] else (CONTEXT, 0)
            bytes_ = whole[text[n]][first[n] : last[n] + least]
            if len(own) == 1:
                rows.append((kind, k, k2, leaf, places[text[n]], first[n], bytes_))
            else:
                known += own
                rows.append((kind, k, k2, None, None, None, bytes_))
        known = np.array(sorted(known), np.int64)
        owner = found.text[met][known]
        for t in np.unique(owner).tolist():
            own = met[known[owner == t]] if len(known) < 64 else met[known[np.searchsorted(owner, t) : np.searchsorted(owner, t, "right")]]
            rows.append(_spans(leaf, places[t], *united(found.first[own], found.last[own] + least)))
        return _rows(rows)

    return stored.select("leaf", "nth", "sizes", "blob").groupBy("leaf").cogroup(told.groupBy("leaf")).applyInArrow(run, SENT)


class _Group(NamedTuple):
    """A distinct context: who asks (none: resolved), how many have it."""

    asks: list[tuple[int, int, int]]
    times: int


def _distinct(rows: list[tuple]) -> dict[bytes, _Group]:
    out: dict[bytes, _Group] = {}
    for _, _, _, leaf, nth, at, data in rows:
        was = out.get(data, _Group([], 0))
        out[data] = _Group(was.asks, was.times + 2) if leaf is None else _Group([*was.asks, (leaf, nth, at)] if was.asks else [(leaf, nth, at)], was.times + 1)
    return out


def _whole(data: bytes, group: _Group) -> Iterator[tuple]:
    for leaf, nth, at in group.asks:
        yield _spans(leaf, nth, np.array([at]), np.array([at + len(data)]))


def _judge(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to spans, by suffix arrays; those of frequent anchors that stand alone to strings."""
    strings: list[bytes] = []
    askers: list[list[tuple[int, int, int]]] = []
    gathered = 0

    def sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from _rows(rows).to_batches()

    def arrays() -> Iterator[tuple]:
        nonlocal gathered
        if strings:
            array = SuffixArray(strings, [len(s) - least + 1 for s in strings], least)
            for s, low, high in zip(*(c.tolist() for c in array.covered())):
                for leaf, nth, at in askers[s]:
                    yield _spans(leaf, nth, np.array([at + low]), np.array([at + high]))
        strings.clear()
        askers.clear()
        gathered = 0

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    out: list[tuple] = []
    for (kind, _, _), held in groupby(rows, key=lambda r: r[:3]):
        if kind in (SPANS, STRING):
            out += held
        else:
            distinct = _distinct(list(held))
            alone = {d: g for d, g in distinct.items() if g.times == 1}
            for data, group in distinct.items():
                if group.times > 1:
                    out += _whole(data, group)
            if kind == FREQUENT:
                for data, group in distinct.items():
                    for n in range(len(data) - least + 1):
                        k1, k2 = _signed(xxhash.xxh3_128_intdigest(data[n : n + least]))
                        leaf, nth, at = group.asks[0] if data in alone else (None, None, 0)
                        out.append((STRING, k1, k2, leaf, nth, at + n, None))
            elif alone and len(distinct) > 1:
                for data, group in distinct.items():
                    strings.append(data)
                    askers.append(group.asks if data in alone else [])
                    gathered += len(data) + 8
                if gathered >= GATHERED:
                    out += arrays()
        if len(out) >= 4096:
            yield from sent(out)
            out = []
    yield from sent([*out, *arrays()])


def _meet(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings to spans, where the same one came twice or was known to be repeated."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    out: list[tuple] = []
    for (kind, _, _), held in groupby(rows, key=lambda r: r[:3]):
        if kind == SPANS:
            out += held
        else:
            times, waiting = 0, None
            for r in held:
                times += 1 if r[3] is not None else 2
                asked = [r] if r[3] is not None else []
                if times == 1:
                    waiting = r
                else:
                    for x in [waiting] * (waiting is not None) + asked:
                        out.append(_spans(x[3], x[4], np.array([x[5]]), np.array([x[5] + least])))
                    waiting = None
                if len(out) >= 4096:
                    yield from _rows(out).to_batches()
                    out = []
        if len(out) >= 4096:
            yield from _rows(out).to_batches()
            out = []
    yield from _rows(out).to_batches()


def _repeated(stored: DataFrame, least: int, most: int | None) -> DataFrame:
    """leaf, nth and bytes (starts and ends, packed) of stretches that are repeated; they may overlap."""
    most, n = capacity(least) if most is None else most, partitions(stored)
    dealt = lambda df: df.repartition(n, "kind", "k1", "k2").sortWithinPartitions("kind", "k1", "k2")
    rows = _contexts(stored, _repeated_anchors(stored, least), least, most)
    judged = dealt(rows).mapInArrow(lambda b: _judge(least, b), SENT)
    return dealt(judged).mapInArrow(lambda b: _meet(least, b), SENT).select("leaf", "nth", "bytes")


def drop_repeats(df: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, spans (start and end in bytes of each removed run) and kept (the remaining bytes) of every row.

    ``most`` is how many occurrences an anchor's suffix array takes (what surely
    fits); the contexts of more frequent anchors meet by digests.
    """
    stored = _stored(df, id_col, text_col)
    spans = _repeated(stored, least, most)

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        by_text: dict[int, list[bytes]] = {}
        for nth, packed in zip(spans.column("nth").to_pylist(), spans.column("bytes").to_pylist()):
            by_text.setdefault(nth, []).append(packed)
        removed, runs, kept = [], [], []
        sizes = texts.column("sizes").to_pylist()
        for nth, text in zip(_places(texts.column("nth").to_pylist(), sizes), _texts(sizes, texts.column("blob").to_pylist())):
            met = [np.frombuffer(p, "<i8").reshape(2, -1) for p in by_text.get(nth, [])]
            starts, ends = united(*np.concatenate(met, axis=1)) if met else (np.zeros(0, np.int64),) * 2
            edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append(int((ends - starts).sum()))
            runs.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_arrays(
            [pa.array([i for own in texts.column("ids").to_pylist() for i in own], pa.int64()), pa.array([n for own in sizes for n in own], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, shape), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )

    schema = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    done = stored.groupBy("leaf").cogroup(spans.groupBy("leaf")).applyInArrow(run, schema)
    return done.withColumnRenamed("id", id_col)
