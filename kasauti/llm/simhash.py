"""SimHash near-duplicates by tiled exact comparison.

Each text's fingerprint is made in numpy from the XXH64 of its word shingles.
Distinct fingerprints are dealt into tiles by the population counts of their
``blocks`` equal parts (with one block: of the whole). Fingerprints within the
radius differ by no more than the radius in these counts taken together, so all
other tile pairs are skipped; the rest are compared in full by exclusive-or and
bit counts. Populous cells are split by hash into several tiles, and each pair of
tiles is a row of its own, so the work of a hot cell spreads over tasks. A tile
pair gives back a spanning forest of its links, nearest first, which joins what
all its links join. Components then follow by alternating large and small stars,
where a hub's rows are joined, never collected.

For :func:`near_duplicates` rows with one fingerprint are one node from the start,
for :func:`drop_near_copies` rows with one set of distinct shingles (told by a
64-bit digest of the set). Answers come back by node and input partition, so a
node that a third of all rows share meets no single task.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero and is linked like any other; with fewer words than a shingle the whole
sequence is the one shingle; rows that repeat an id or a text each give a row of
:func:`near_duplicates`, while of a group's rows that share its smallest id exactly
one stays; null ids count for a group's links but never name it, and one row stays
of a group that has no other; empty tables give empty results; further columns are
ignored by :func:`near_duplicates` and kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, per_text, text_or_empty
from .exact_dedup import keep_rows

#: Fingerprints in a tile, about; a pair of tiles is some 16 million comparisons.
TILE = 4096
#: And shapes in one; a tile of 200 kB then costs a task some 70 million comparisons each time it is sent.
SHAPE_TILE = 8192
#: Comparisons held in memory at once.
SLAB = 1 << 20
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16
SEED = 42
#: Odd factors, one for each of the 64 permutations of MinHash: powers of an odd constant.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, 65)], np.uint64)
#: Differing MinHash bits up to which a candidate is kept: similarity 0.8 gives 6.4 on average with a deviation of 2.4,
#: texts that share nothing give 32 with a deviation of 4.
SIG_RADIUS = 16
#: Texts in a block whose candidates are all verified, and bytes of their shingles, about.
BLOCK, BLOCK_BYTES = 512, 1 << 22


def words_of(text: str) -> list[bytes]:
    r"""Matches of [^\x20\x09-\x0D]+ in the UTF-8 of the text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> Iterator[int]:
    if not words:
        return iter(())
    if len(words) < width:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    return (xxhash.xxh64_intdigest(s, SEED) for s in shingles)


def _bits(on: np.ndarray) -> int:
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, width: int) -> int:
    """Of all shingles, repeats included."""
    words = words_of(text)
    n = max(1, len(words) - width + 1) if words else 0
    ones, hashes = np.zeros(64, np.int64), shingle_hashes(words, width)
    for at in range(0, n, SHINGLES):
        ones += _ones(np.fromiter(hashes, "<u8", min(SHINGLES, n - at)))
    return _bits(2 * ones > n)


class Shape(NamedTuple):
    """What near copies are looked for by: all of the set of a text's distinct shingles."""

    #: Digest of the set.
    node: int
    fp: int
    #: A bit of each of 64 permutations' least shingle hash (MinHash).
    sig: int
    size: int


def shape(text: str, width: int) -> Shape:
    h = np.unique(np.fromiter(shingle_hashes(words_of(text), width), "<u8"))
    ones, least = np.zeros(64, np.int64), np.full(64, 2**64 - 1, np.uint64)
    for at in range(0, len(h), SHINGLES):
        ones += _ones(h[at : at + SHINGLES])
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * FACTORS[None, :]).min(axis=0), out=least)
    return Shape(xxhash.xxh64_intdigest(h.tobytes()), _bits(2 * ones > len(h)), _bits((least >> np.uint64(32) & np.uint64(1)).astype(bool)), len(h))


def fingerprints(df: DataFrame, width: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))}

    return per_text(df, run, "fp long", text_col, keep)


def shapes(df: DataFrame, width: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the :class:`Shape` of every row, as longs."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        made = np.array([shape(t, width) for t in texts], np.uint64).reshape(-1, len(Shape._fields)).view(np.int64)
        return {name: pa.array(made[:, k]) for k, name in enumerate(Shape._fields)}

    return per_text(df, run, "node long, fp long, sig long, size long", text_col, keep)


def _counts(fp: Column, blocks: int) -> list[Column]:
    size = 64 // blocks
    mask = F.lit(-1 if blocks == 1 else (1 << size) - 1)
    return [F.bit_count(F.shiftrightunsigned(fp, size * i).bitwiseAND(mask)) for i in range(blocks)]


def _steps(blocks: int, radius: int) -> list[int]:
    """Differences of cell numbers between cells that can hold a link, each pair of cells once."""
    near = (d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius)
    return sorted({n for d in near if (n := sum(x << (8 * i) for i, x in enumerate(d))) >= 0})


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, sig_a: np.ndarray | None = None, sig_b: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """A spanning forest, nearest links first, of the links between ``a`` and ``b`` (None: within ``a``), arrays of signed longs.

    A link is (place in a, place in b, distance). With signatures, links whose
    MinHash bits differ in more than SIG_RADIUS don't count.
    """
    a, b = a.view(np.uint64), None if b is None else b.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    other = a if b is None else b
    rows, shift = max(1, SLAB // max(1, len(other))), 0 if b is None else len(a)
    forest: list[tuple[int, int, int]] = []
    for at in range(0, len(a), rows):
        # Within one tile, what lies before the slab has been compared with it.
        low = at if b is None else 0
        distance = np.bitwise_count(a[at : at + rows, None] ^ other[None, low:])
        i, j = np.divmod(np.flatnonzero(distance <= radius), len(other) - low)
        if b is None:
            i, j = i[i < j], j[i < j]
        if sig_a is not None and len(i):
            sig = sig_a if sig_b is None else sig_b
            near = np.bitwise_count(sig_a[i + at].view(np.uint64) ^ sig[j + low].view(np.uint64)) <= SIG_RADIUS
            i, j = i[near], j[near]
        if len(i):
            # A forest of all slabs' forests joins what all links join.
            forest = _nearest(forest, i + at, j + low + shift, distance[i, j], shift + len(other))
    return [(u, v - shift, d) for u, v, d in forest]


def _nearest(had: list[tuple[int, int, int]], u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    if had:
        old = np.array(had)
        u, v, d = np.concatenate([old[:, 0], u]), np.concatenate([old[:, 1], v]), np.concatenate([old[:, 2], d])
    order = np.argsort(d, kind="stable")
    u, v, d = u[order], v[order], d[order]
    parent, forest = list(range(n)), []
    while len(u):
        # Few at a time in plain Python; the links that these make superfluous go in numpy.
        for x, y, z in zip(u[:4096].tolist(), v[:4096].tolist(), d[:4096].tolist()):
            p, q = _root(parent, x), _root(parent, y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                forest.append((x, y, z))
        u, v, d = u[4096:], v[4096:], d[4096:]
        if len(u):
            roots = np.array(parent)
            while (roots[roots] != roots).any():
                roots = roots[roots]
            apart = roots[u] != roots[v]
            u, v, d = u[apart], v[apart], d[apart]
    return forest


def _pieces_linked(work: DataFrame, radius: int) -> DataFrame:
    """u, v and distance from pairs of tiles: ids, fps, sigs (null: don't count) of both sides, and whether they are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k in range(batch.num_rows):
                ids, fps, sigs, ids_b, fps_b, sigs_b = (x.values.to_numpy(zero_copy_only=False) if (x := batch.column(c)[k]).is_valid else None for c in range(6))
                same = batch.column(6)[k].as_py()
                found = tile_links(fps, None, radius, sigs) if same else tile_links(fps, fps_b, radius, sigs, sigs_b)
                if found:
                    u, v, d = np.array(found).T
                    parts.append((ids[u], (ids if same else ids_b)[v], d.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["u", "v", "distance"])

    return work.select("ids", "fps", "sigs", "ids_b", "fps_b", "sigs_b", "same").mapInArrow(run, "u long, v long, distance int")


def links(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """u, v and distance: links of fingerprints (column fp, none twice) that join all that lie within the radius."""
    own = sum((c.cast("long") * (1 << (8 * i)) for i, c in enumerate(_counts(F.col("fp"), blocks))), F.lit(0))
    placed = distinct.select("fp", own.alias("cell"))
    # At most (64 / blocks + 1) ** blocks rows, whatever the input: 83,521 for four blocks.
    cells = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n")))
    dealt = placed.join(F.broadcast(cells), "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    tiles = cut(dealt.groupBy("cell", "sub").agg(F.sort_array(F.collect_list("fp")).alias("fps")))

    near = cells.select("cell", "n", F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(blocks, radius)])).alias("step"))
    others = cells.select((F.col("cell")).alias("cell_b"), F.col("n").alias("n_b"))
    pairs = (
        near.select("cell", "n", (F.col("cell") + F.col("step")).alias("cell_b"))
        .join(F.broadcast(others), "cell_b")
        .select("cell", "cell_b", "n_b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sub"))
        .select("cell", "cell_b", "sub", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("sub_b"))
        .filter((F.col("cell") < F.col("cell_b")) | (F.col("sub") <= F.col("sub_b")))
    )
    second = tiles.select(F.col("cell").alias("cell_b"), F.col("sub").alias("sub_b"), F.col("fps").alias("fps_b"))
    work = pairs.join(tiles, ["cell", "sub"]).join(second, ["cell_b", "sub_b"])
    none, same = F.lit(None).cast("array<long>"), (F.col("cell") == F.col("cell_b")) & (F.col("sub") == F.col("sub_b"))
    return _pieces_linked(work.select(F.col("fps").alias("ids"), "fps", none.alias("sigs"), F.col("fps_b").alias("ids_b"), "fps_b", none.alias("sigs_b"), same.alias("same")), radius)


def shape_links(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """u, v and distance: links of shapes (none twice) that join all whose fingerprints lie within the radius and whose MinHash bits agree.

    Sets of a similarity differ in size by no more than that factor, so a tile holds
    one class of sizes (a factor 1 / similarity wide) and meets its own class and the
    next one. Within a class tiles follow the fingerprints' population counts, and
    tile pairs whose counts differ beyond the radius are skipped.
    """
    # A little wider than the factor, so that rounding never puts two classes between a pair.
    step = -math.log(similarity) * (1 + 1e-9) if similarity > 0 else math.inf
    size_class = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.lit(step)).cast("int")
    placed = nodes.select("node", "fp", "sig", size_class.alias("class"), F.bit_count("fp").alias("pop"))
    # At most 65 rows for each class of sizes, so each window and the broadcast below are small.
    counts = placed.groupBy("class", "pop").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("pop")) - F.col("n")
    cells = cut(counts.select("class", "pop", F.floor(before / SHAPE_TILE).alias("first"), F.ceil(F.col("n") / SHAPE_TILE).alias("n")))
    dealt = placed.join(F.broadcast(cells), ["class", "pop"]).withColumn("sub", F.col("first") + F.pmod(F.xxhash64("node"), F.col("n")))
    tiles = dealt.groupBy("class", "sub").agg(F.min("pop").alias("low"), F.max("pop").alias("high"), F.collect_list(F.struct("node", "fp", "sig")).alias("x"))
    tiles = cut(tiles.select("class", "sub", "low", "high", F.col("x.node").alias("ids"), F.col("x.fp").alias("fps"), F.col("x.sig").alias("sigs")))

    one = tiles.select("class", "sub", "low", "high", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class_b"))
    two = tiles.select(F.col("class").alias("class_b"), F.col("sub").alias("sub_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    apart = F.greatest(F.col("low") - F.col("high_b"), F.col("low_b") - F.col("high"))
    pairs = one.join(two, "class_b").filter(((F.col("class") < F.col("class_b")) | (F.col("sub") <= F.col("sub_b"))) & (apart <= radius))
    pairs = pairs.select("class", "sub", "class_b", "sub_b", ((F.col("class") == F.col("class_b")) & (F.col("sub") == F.col("sub_b"))).alias("same"))
    side = lambda end: tiles.select(*[F.col(c).alias(c + end) for c in ("class", "sub", "ids", "fps", "sigs")])
    return _pieces_linked(pairs.join(side(""), ["class", "sub"]).join(side("_b"), ["class_b", "sub_b"]), radius)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node hangs its larger neighbours on its smallest; small star: its smaller ones and itself."""
    if large:
        sides = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = sides.join(lowest, "u")
    if large:
        out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # Of each node's rows one at least holds its smallest neighbour: there the node hangs itself.
        out = hung.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node that ``edges`` (u, v) touch."""
    edges, last = cut(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct()), None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last, edges = now, cut(_star(_star(edges, True), False))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(marked: DataFrame, groups: DataFrame) -> DataFrame:
    """``marked`` (id, node, leaf) with root, component_id and the leaf that holds its first row."""
    by_node = marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "leaf")).alias("first"))
    rooted = by_node.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    told = rooted.join(best, "root").select("node", "root", F.col("best.id").alias("component_id"), F.col("best.leaf").alias("keep_leaf"))
    # Each node is asked for once by each leaf, so the last join is even.
    asked = marked.groupBy("leaf", "node").agg(F.count(F.lit(1)).alias("n")).drop("n").join(told, "node")
    return marked.join(asked, ["leaf", "node"])


def near_duplicates(df: DataFrame, width: int = 3, radius: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (hex) and component_id (smallest id reachable over links) of every row."""
    marked = cut(fingerprints(df, width, [id_col], text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("fp").alias("node"), F.spark_partition_id().alias("leaf")))
    groups = components(links(marked.select(F.col("node").alias("fp")).distinct(), radius, blocks))
    done = _grouped(marked, groups)
    return done.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _judged(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The links, and whether their texts share at least ``least`` of their distinct shingles (Jaccard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, good = b.slice(at, 64), []
                for s, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = set(shingle_hashes(words_of(s), width)), set(shingle_hashes(words_of(t), width))
                    good.append(len(x & y) >= least * len(x | y))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(good, pa.bool_())], names=["u", "v", "good"])

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long, good boolean")


def standing(fp: np.ndarray, sig: np.ndarray, part: np.ndarray, shingles: list[bytes], split: int, radius: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of parts, of the candidates that stand between rows before ``split`` and the others (0: between all rows).

    Rows of one part count as joined already; every candidate that joins two others is verified.
    """
    u, s = fp.view(np.uint64), sig.view(np.uint64)
    rows, others = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    distance = np.bitwise_count(u[rows, None] ^ u[None, others])
    near = (distance <= radius) & (np.bitwise_count(s[rows, None] ^ s[None, others]) <= SIG_RADIUS) & (part[rows, None] != part[None, others])
    i, j = np.nonzero(near)
    if not split:
        i, j = i[i < j], j[i < j]
    order = np.argsort(distance[i, j], kind="stable")
    at = np.unique(part, return_inverse=True)[1].tolist()
    parent, sets, out = list(range(len(at))), {}, []
    for x, y in zip(i[order].tolist(), (j[order] + split).tolist()):
        p, q = _root(parent, at[x]), _root(parent, at[y])
        if p == q:
            continue
        for k in (x, y):
            if k not in sets:
                sets[k] = set(np.frombuffer(shingles[k], "<u8").tolist())
        same = len(sets[x] & sets[y])
        if same >= least * (len(sets[x]) + len(sets[y]) - same):
            parent[max(p, q)] = min(p, q)
            out.append((int(part[x]), int(part[y])))
    return out


def _further(judged: DataFrame, parts: DataFrame, texts: DataFrame, width: int, radius: int, least: float) -> DataFrame:
    """u and v, roots of parts: links that stand between the ``parts`` (node, root) into which failed links of the forest leave a group of candidates.

    All candidates of such a group that join two parts are verified, block by block.
    """
    part = parts.select("node", F.col("root").alias("part"))
    failed = judged.filter("NOT good").select("u", "v")
    failed = failed.join(part.toDF("u", "part_u"), "u", "left").join(part.toDF("v", "part_v"), "v", "left")
    groups = components(failed.select(F.coalesce("part_u", "u").alias("u"), F.coalesce("part_v", "v").alias("v")))
    own = texts.select("node", F.octet_length("text").cast("long").alias("size")).join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    own = cut(own.join(groups.select(F.col("node").alias("part"), F.col("root").alias("group")), "part"))

    # A part of a block's size or more has blocks of its own, which need no test among themselves.
    whole = own.groupBy("group", "part").agg((F.count(F.lit(1)) >= BLOCK).alias("own"))
    placed = own.join(whole, ["group", "part"]).withColumn("cell", F.when(F.col("own"), F.col("part")).otherwise(F.lit(0)))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int")
    cells = cut(placed.groupBy("group", "own", "cell").agg(F.greatest(blocks, F.lit(1)).alias("n")))
    dealt = placed.join(cells, ["group", "own", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(np.fromiter(shingle_hashes(words_of(t.as_py()), width), "<u8")).tobytes() for t in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(6), b.column(7), pa.array(made, pa.binary())], names=names)

    names = ["group", "own", "cell", "sub", "fp", "sig", "part", "shingles"]
    shown = dealt.select("group", "own", "cell", "sub", "node", "part").join(texts, "node").select("group", "own", "cell", "sub", "fp", "text", "sig", "part")
    shown = shown.mapInArrow(run, "group long, own boolean, cell long, sub int, fp long, sig long, part long, shingles binary")
    key = ["group", "own", "cell", "sub"]
    tiles = cut(shown.groupBy(*key).agg(F.collect_list(F.struct("fp", "sig", "part", "shingles")).alias("x")))

    one = cells.select("group", "own", "cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sub"))
    two = one.toDF("group", "own_b", "cell_b", "sub_b")
    first, second = F.struct("own", "cell", "sub"), F.struct("own_b", "cell_b", "sub_b")
    apart = ~(F.col("own") & F.col("own_b") & (F.col("cell") == F.col("cell_b")))
    pairs = one.join(two, "group").filter(apart & (first <= second)).withColumn("same", first == second)
    work = pairs.join(tiles, key).join(tiles.toDF("group", "own_b", "cell_b", "sub_b", "x_b"), ["group", "own_b", "cell_b", "sub_b"]).select("x", "x_b", "same")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, same = b.column(0)[k].values, b.column(2)[k].as_py()
                sides = [side.flatten() for side in ([x] if same else [x, b.column(1)[k].values])]
                fp, sig, part = (np.concatenate([c[n].to_numpy() for c in sides]) for n in range(3))
                found = standing(fp, sig, part, [s for c in sides for s in c[3].to_pylist()], 0 if same else len(x), radius, least)
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return work.mapInArrow(verify, "u long, v long")


def drop_near_copies(df: DataFrame, width: int = 5, radius: int = 20, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without all but the first of each group of near copies.

    Texts with one set of distinct shingles are one node; nothing else joins texts
    unverified, equal fingerprints neither. Fingerprints of those sets within
    ``radius`` whose MinHash bits agree are candidates; the second test keeps chance
    neighbours, of which a wide radius meets many, out. A link stands when the exact
    Jaccard similarity of the two sets is ``similarity`` or more. A spanning forest
    of the candidates, nearest links first, is verified; in groups where one of its
    links fails, so is every other candidate between texts that are not joined yet.
    """
    text = F.col(f"`{text_col}`")
    spread = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_or_empty(text)).alias("mark"), text_or_empty(text).alias("text"))
    marked = cut(shapes(spread, width, ["id", "mark"]).withColumn("leaf", F.spark_partition_id()))
    # All rows of a node agree in these.
    nodes = marked.groupBy("node").agg(*[F.min(c).alias(c) for c in ("fp", "sig", "size")])
    found = cut(shape_links(nodes, radius, similarity))
    ends = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).distinct()
    shown = marked.join(ends, "node").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("at"), F.min("fp").alias("fp"), F.min("sig").alias("sig"))
    shown = shown.select("node", "fp", "sig", F.col("at.id").alias("at_id"), F.col("at.mark").alias("at_mark"))
    met = spread.join(shown.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("at_id")) & (F.col("mark") == F.col("at_mark")))
    texts = cut(met.groupBy("node").agg(*[F.min(c).alias(c) for c in ("text", "fp", "sig")]))
    pairs = found.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    judged = cut(_judged(pairs, width, similarity))
    groups = components(judged.filter("good"))
    if not judged.filter("NOT good").isEmpty():
        joined = components(_further(judged, groups, texts, width, radius, similarity)).toDF("part", "joined")
        own = texts.select("node").join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("part"))
        groups = own.join(joined, "part", "left").select("node", F.coalesce("joined", "part").alias("root"))
    done = _grouped(marked, groups)
    # What is left of a group repeats its smallest id within one leaf.
    smallest = done.filter((F.col("leaf") == F.col("keep_leaf")) & F.col("id").eqNullSafe(F.col("component_id")))
    kept = smallest.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("node", "mark"))).filter("nth = 1")
    return keep_rows(df, kept.select(F.col("id").alias("__id"), F.col("mark").alias("__sha")).distinct(), id_col, F.xxhash64(text_or_empty(text)))


__all__ = ["components", "drop_near_copies", "fingerprint", "links", "near_duplicates", "shape", "shape_links"]
