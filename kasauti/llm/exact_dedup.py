"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition ("leaf") turns its rows into one sorted run of digests.
The runs then meet in rounds along the digits of a leaf's number, as in a
binomial exchange: in round r a partition cuts its run at the digits of the
digest and hands each piece to the partition whose number differs from its own
in digit r alone. The receiver merges the pieces (a multiway merge over chunks
that arrive in order of their first entry, so only the overlapping chunks are
in memory) and keeps, for each verified digest, the smallest identifier and the
number of rows. After the last round each partition holds one range of digests.

A group of copies is one entry of each run from the first step on, so no task
ever sees it whole, and the way back (answers to runs by digest, runs to rows by
leaf and digest) meets a digest at most once for each leaf.

Defined cases: a null text counts as empty; a null identifier sorts last (a
group of nothing else has a null keep_id); of rows that repeat both text and
identifier exactly one stays, that of the lowest leaf and there the one whose raw
text hashes lowest (rows that agree in that too are alike but for further columns,
and any of them stays); an empty table gives an empty result; further columns are
ignored by :func:`exact_dedup` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from struct import Struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, text_or_empty

#: SHA-256, length and XXH64 of the text (the verified key), then identifier, leaf and count.
#: Big-endian, so the bytes of an entry sort as its fields do.
ENTRY = Struct(">32sQQQIQ")
KEY = 48
NO_ID = 2**64 - 1
#: Bits of a partition's number that one round exchanges: 8 runs meet in a merge.
DIGIT_BITS = 3
CHUNK_ENTRIES = 8192
KEYS = ["sha", "n_bytes", "xx"]
RUN_SCHEMA = "owner int, first binary, chunk binary"


def normalised(text: str | Column) -> Column:
    r"""Each run of [\x20\x09-\x0D] becomes one space."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def _combined(entries: Iterator[bytes]) -> Iterator[bytes]:
    """Sorted entries with one left for each key: the smallest, with all counts."""
    best, count = None, 0
    for entry in entries:
        if best is not None and entry[:KEY] == best[:KEY]:
            count += int.from_bytes(entry[-8:], "big")
            continue
        if best is not None:
            yield best[:-8] + count.to_bytes(8, "big")
        best, count = entry, int.from_bytes(entry[-8:], "big")
    if best is not None:
        yield best[:-8] + count.to_bytes(8, "big")


def _entry(sha: bytes, n: int, xx: int, i: int | None, leaf: int) -> bytes:
    return ENTRY.pack(sha, n, xx & NO_ID, NO_ID if i is None else i + 2**63, leaf, 1)


def _fields(entry: bytes) -> tuple:
    sha, n, xx, i, leaf, count = ENTRY.unpack(entry)
    return sha, n, xx - 2**64 if xx >> 63 else xx, None if i == NO_ID else i - 2**63, leaf, count


def _cut_up(chunk: bytes) -> Iterator[bytes]:
    return (chunk[i : i + ENTRY.size] for i in range(0, len(chunk), ENTRY.size))


def _merged(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Multiway merge of sorted chunks that come in order of their first entries."""
    heap: list[tuple[bytes, int, Iterator[bytes]]] = []
    for number, chunk in enumerate(chunks):
        start = chunk[: ENTRY.size]
        while heap and heap[0][0] < start:
            entry, k, rest = heap[0]
            yield entry
            after = next(rest, None)
            heapq.heappop(heap) if after is None else heapq.heapreplace(heap, (after, k, rest))
        rest = _cut_up(chunk)
        heapq.heappush(heap, (next(rest), number, rest))
    while heap:
        entry, k, rest = heap[0]
        yield entry
        after = next(rest, None)
        heapq.heappop(heap) if after is None else heapq.heapreplace(heap, (after, k, rest))


def _sent(entries: Iterator[bytes], owner: int, bits: int, shift: int, width: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Chunks for the partitions that share all but one digit of ``owner``'s number."""
    mask = ((1 << width) - 1) << shift
    waiting: dict[int, list[bytes]] = {}
    for entry in entries:
        home = int.from_bytes(entry[:8], "big") >> (64 - bits)
        to = (owner & ~mask) | (home & mask)
        chunk = waiting.setdefault(to, [])
        chunk.append(entry)
        if len(chunk) == CHUNK_ENTRIES:
            yield to, chunk[0], b"".join(waiting.pop(to))
    for to, chunk in waiting.items():
        yield to, chunk[0], b"".join(chunk)


def _as_batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


RUN_ARROW = pa.schema([("owner", pa.int32()), ("first", pa.binary()), ("chunk", pa.binary())])


def _leaf_runs(digests: DataFrame, bits: int, shift: int, width: int) -> DataFrame:
    ordered = digests.select("leaf", *KEYS, "id").sortWithinPartitions("leaf", *KEYS, F.col("id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for b in batches:
                for leaf, sha, n, xx, i in zip(*(c.to_pylist() for c in b.columns)):
                    yield leaf, _entry(sha, n, xx, i, leaf)

        def sent() -> Iterator[tuple[int, bytes, bytes]]:
            for leaf, entries in _by_owner(rows()):
                yield from _sent(_combined(entries), leaf % (1 << bits), bits, shift, width)

        yield from _as_batches(sent(), RUN_ARROW, 16)

    return ordered.mapInArrow(run, RUN_SCHEMA)


def _by_owner(rows: Iterator[tuple]) -> Iterator[tuple[int, Iterator]]:
    from itertools import groupby

    for owner, group in groupby(rows, key=lambda r: r[0]):
        yield owner, (r[1] for r in group)


def _round(runs: DataFrame, bits: int, shift: int, width: int) -> DataFrame:
    """One merge of the runs received, cut up and sent on along the next digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((o, c) for b in batches for o, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))

        def sent() -> Iterator[tuple[int, bytes, bytes]]:
            for owner, chunks in _by_owner(rows):
                yield from _sent(_combined(_merged(chunks)), owner, bits, shift, width)

        yield from _as_batches(sent(), RUN_ARROW, 16)

    return _received(runs, bits).mapInArrow(run, RUN_SCHEMA)


def _received(runs: DataFrame, bits: int) -> DataFrame:
    return runs.repartition(1 << bits, "owner").sortWithinPartitions("owner", "first")


def _answers(runs: DataFrame, bits: int) -> DataFrame:
    """The last merge: one row for each digest."""
    schema = pa.schema([("sha", pa.binary()), ("n_bytes", pa.int64()), ("xx", pa.int64()), ("keep_id", pa.int64()), ("keep_leaf", pa.int32()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((o, c) for b in batches for o, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))

        def unpacked() -> Iterator[tuple]:
            for _, chunks in _by_owner(rows):
                yield from map(_fields, _combined(_merged(chunks)))

        yield from _as_batches(unpacked(), schema, 4096)

    return _received(runs, bits).mapInArrow(run, "sha binary, n_bytes long, xx long, keep_id long, keep_leaf int, group_size long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id_col, keep_id, group_size, kept, text_sha256.

    ``id_col`` holds integers. Texts are equal when :func:`normalised` makes
    them identical; SHA-256, length and XXH64 must all agree.
    """
    return _judged(df, id_col, text_col).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def raw_hash(text: str | Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def _judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same with id for id_col, and raw, a hash of the text as it is."""
    text = normalised(f"`{text_col}`")
    digests = cut(
        df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), raw_hash(f"`{text_col}`").alias("raw"))
        .select("id", "raw", F.spark_partition_id().alias("leaf"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("xx"))
    )
    leaves = max(2, digests.rdd.getNumPartitions(), partitions(df))
    bits = min(16, math.ceil(math.log2(leaves)))
    digits = [(at, min(DIGIT_BITS, bits - at)) for at in range(0, bits, DIGIT_BITS)]
    runs = _leaf_runs(digests, bits, *digits[0])
    for digit in digits[1:]:
        runs = _round(runs, bits, *digit)
    answers = _answers(runs, bits)
    asked = digests.groupBy("leaf", *KEYS).agg(F.count(F.lit(1)).alias("n")).drop("n")
    told = asked.join(answers, KEYS)
    first = F.row_number().over(Window.partitionBy("leaf", *KEYS).orderBy(F.col("id").asc_nulls_last(), "raw"))
    return (
        digests.withColumn("nth", first)
        .join(told, ["leaf", *KEYS])
        .select(
            "id",
            "raw",
            "keep_id",
            "group_size",
            ((F.col("nth") == 1) & (F.col("leaf") == F.col("keep_leaf"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all their columns."""
    stay = _judged(df, id_col, text_col).filter("kept").select(F.col("id").alias("__id"), F.concat_ws(" ", F.hex("raw"), "text_sha256").alias("__sha"))
    return keep_rows(df, stay, id_col, F.concat_ws(" ", F.hex(raw_hash(f"`{text_col}`")), F.sha2(normalised(f"`{text_col}`"), 256)))


def keep_rows(df: DataFrame, stay: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """One row of ``df`` for each (__id, __sha) of ``stay``, which holds no pair twice.

    Both sides meet by the id as text, so the join and the removal of repeated
    rows share one shuffle and null ids need no other path.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    marked = df.withColumns({"__key": key(F.col(f"`{id_col}`")), "__mark": mark})
    chosen = stay.select(key(F.col("__id")).alias("__key"), F.col("__sha").alias("__mark"))
    some = marked.join(chosen.hint("shuffle_hash"), ["__key", "__mark"], "left_semi")
    return some.dropDuplicates(["__key", "__mark"]).select(*[F.col(f"`{c}`") for c in df.columns])


__all__ = ["drop_copies", "exact_dedup", "keep_rows", "normalised"]
