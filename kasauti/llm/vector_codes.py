"""Product quantisation of integer vectors, entries pruned by annuli of their norms.

A component x counts as the integer floor(scale * x). A vector is cut into equal
consecutive parts, and each part's place has a codebook of its own, which starts as
that part of the vectors with the smallest ids. A round assigns every part to the
nearest entry (squared Euclidean distance, ties to the lower number) and moves each
entry to the floored mean of its parts. Rounds are passes over the table: tasks send
sums and counts of each entry, so what the driver holds is one codebook.

Nearest entries: a codebook is sorted by norm. An entry can be no nearer than its norm
and the part's norm differ, so a first distance, to entries of like norm, allows an
annulus of norms, whose ends a binary search finds. Parts are taken in order of
their norms, a block at a time; the entries of the block's annuli, ends included,
are evaluated exactly, all others never.

All arithmetic is of integers: in doubles where no value can pass 2^53, else in
Python's unbounded integers.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped, and so are rows whose length is not the most frequent one (of equally
frequent ones: the longest); lengths that the parts don't divide give the first parts
one component more; with fewer rows than entries the codebook is as short; rows
that repeat an id count each, in order of their vectors, null ids last; null labels are
one label; an error above 2^63 - 1 is given as 2^63 - 1; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Parts that share a look at the codebook, and entries of like norm that give the first distance.
BLOCK, NEAR = 256, 16
#: Sums go in limbs of so many bits, as a column of longs holds no wider ones.
LIMB = 40
LONG = 2**63 - 1
_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as integers in doubles or as Python integers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2**52 / scale:
        return np.floor(x * scale)
    # Doubles of 2^53 and up are whole numbers.
    exact = [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _root(squares: np.ndarray) -> np.ndarray:
    """Whole part of the root."""
    return _isqrt(squares) if squares.dtype == object else np.floor(np.sqrt(squares))


class Book(NamedTuple):
    """Entries of one part in order of their norms."""

    entries: np.ndarray
    squares: np.ndarray
    norms: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Book:
        squares = (entries * entries).sum(axis=1)
        norms = _root(squares)
        order = np.argsort(norms, kind="stable")
        return Book(entries[order], squares[order], norms[order], order.astype(entries.dtype))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest entry of each part."""
    m, most = len(entries), max(1, *(int(abs(a).max()) if a.size else 0 for a in (parts, entries)))
    kind = np.float64 if 4 * most * most * max(1, parts.shape[1]) * m < 2**53 else object
    parts, book = parts.astype(kind), Book.of(entries.astype(kind))
    if kind is object:
        parts = np.frompyfunc(int, 1, 1)(parts)
        book = Book.of(np.frompyfunc(int, 1, 1)(entries))
    squares = (parts * parts).sum(axis=1)
    norms = _root(squares)
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), kind)
    order = np.argsort(norms, kind="stable")
    for at in range(0, len(parts), BLOCK):
        rows = order[at : at + BLOCK]
        own, x = norms[rows], parts[rows]

        def distances(low: int, high: int) -> np.ndarray:
            return squares[rows, None] - 2 * (x @ book.entries[low:high].T) + book.squares[None, low:high]

        near = max(0, min(m - NEAR, int(np.searchsorted(book.norms, own[len(rows) // 2])) - NEAR // 2))
        # Whole parts of three roots: each is off by less than one.
        reach = _root(distances(near, min(m, near + NEAR)).min(axis=1)) + 2
        low, high = np.searchsorted(book.norms, own - reach, "left").min(), np.searchsorted(book.norms, own + reach, "right").max()
        best = (distances(low, high) * m + book.number[None, low:high]).min(axis=1)
        codes[rows], errors[rows] = (best % m).astype(np.int64), best // m
    return codes, errors


class Codebooks(NamedTuple):
    """Entries of every part, as integers: books[part] has a row for each entry."""

    books: list[np.ndarray]
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def _cuts(dim: int, parts: int) -> list[slice]:
    ends = np.cumsum([len(a) for a in np.array_split(np.empty(dim), parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """id, vector (doubles) and label of the rows that count."""
    infinite = F.lit(float("inf"))
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"), label.alias("label"))
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return floored(flat.reshape(len(column), -1), scale)


def _limbs(values: list[int]) -> list[list[int]]:
    """The values in limbs of LIMB bits, lowest first; the last ones carry the signs."""
    out = []
    while True:
        if all(-LONG <= v <= LONG >> 1 and abs(v) < 1 << LIMB for v in values):
            return [*out, values]
        out.append([v & ((1 << LIMB) - 1) for v in values])
        values = [v >> LIMB for v in values]


def _round(rows: DataFrame, books: Codebooks, cuts: list[slice]) -> Codebooks:
    """Every part assigned, every entry moved to the floored mean of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        sums = [np.zeros(b.shape, object) for b in books.books]
        for batch in batches:
            x = _matrix(batch.column(0), books.scale)
            for p, at in enumerate(cuts):
                own = x[:, at]
                codes, _ = nearest(own, books.books[p])
                counts[p] += np.bincount(codes, minlength=len(counts[p]))
                if x.dtype == object:
                    np.add.at(sums[p], codes, own)
                else:
                    # Far below 2^53: a batch holds some ten thousand rows, each component below 2^52 / scale.
                    made = np.stack([np.bincount(codes, own[:, j], len(counts[p])) for j in range(own.shape[1])], 1) if own.shape[1] else np.zeros(sums[p].shape)
                    sums[p] = sums[p] + np.frompyfunc(int, 1, 1)(made)
        for p, count in enumerate(counts):
            met = np.flatnonzero(count).tolist()
            if met:
                entry, limb, many, values = zip(*[(e, k, int(count[e]) if k == 0 else 0, v) for e in met for k, v in enumerate(_limbs(sums[p][e].tolist()))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(entry), pa.int32()), pa.array(entry, pa.int32()), pa.array(limb, pa.int32()), pa.array(many, pa.int64()), pa.array(values, pa.list_(pa.int64()))],
                    names=["part", "entry", "limb", "n", "sums"],
                )

    made = rows.select("vector").mapInArrow(run, "part int, entry int, limb int, n long, sums array<long>")
    counts = made.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    totals = made.select("part", "entry", "limb", F.posexplode("sums").alias("place", "value")).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    # As many rows as the codebooks have components, whatever the table.
    told = totals.join(counts, ["part", "entry"]).collect()
    sums: dict[tuple[int, int, int], int] = {}
    many = {(r["part"], r["entry"]): r["n"] for r in told}
    for r in told:
        key = (r["part"], r["entry"], r["place"])
        sums[key] = sums.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
    moved = [b.copy() for b in books.books]
    for (p, e, place), total in sums.items():
        moved[p][e, place] = total // many[p, e]
    return books._replace(books=moved)


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of the rows of :func:`usable`."""
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    dim = len(first[0]["vector"]) if first else 0
    start = floored(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dim), scale)
    whole = np.frompyfunc(int, 1, 1)(start) if start.size else start.astype(object)
    cuts = _cuts(dim, parts)
    books = Codebooks([whole[:, c] for c in cuts], scale)
    for _ in range(rounds if first and dim else 0):
        books = _round(rows, books, cuts)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, codes (an entry's number for each part) and error (squared distances summed) of the rows of :func:`usable`."""
    cuts = _cuts(sum(b.shape[1] for b in books.books), len(books.books))
    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), books.scale)
            found = [nearest(x[:, at], book) for at, book in zip(cuts, books.books)]
            codes = np.stack([c for c, _ in found], 1)
            errors = [min(LONG, sum(map(int, e))) for e in zip(*(e.tolist() for _, e in found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(errors, pa.int64())], names=["id", "label", "codes", "error"])

    return rows.select("id", "label", "vector").mapInArrow(run, f"id {kind[0]}, label {kind[1]}, codes array<int>, error long")


def vector_codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, code (two hex digits a part), error, label_error and codebooks_sha256 of every row that counts."""
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries")
    rows = usable(df, id_col, vector_col, label_col)
    books = train(rows, parts, entries, rounds, scale)
    coded = cut(encode(rows, books).withColumn("leaf", F.spark_partition_id()))
    wide = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy("label").agg(wide.alias("label_error"))
    # Each label is asked for once by each partition, so a label that a third of all rows share meets no single task.
    asked = coded.select("leaf", F.col("label").alias("of")).distinct()
    told = asked.join(totals, F.col("of").eqNullSafe(F.col("label"))).select(F.col("leaf").alias("at"), "of", "label_error")
    done = coded.join(told, (F.col("leaf") == F.col("at")) & F.col("label").eqNullSafe(F.col("of")))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return done.select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
