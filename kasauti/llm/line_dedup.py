r"""Line deduplication with DataFrame operations alone.

A line's key is the line without [\x20\x09-\x0D] at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that ``min_docs`` documents hold lose
all their lines except in the largest document holding them.

The keys' 128-bit hashes are range-partitioned and sorted by document and
position, so each key's lines pass in order and its first document in that order
(the largest id) is the one that stays. The ``HOT_KEYS`` most frequent keys are
found beforehand by a map-side combined count and judged where their lines are
read, against a broadcast table of at most that many rows; any other key has
fewer than one in ``HOT_KEYS`` of all lines, so no range partition holds a large
group. Both ways are exact. Each document's result is a run-length encoded keep
bitmap: the (start, length) of every stretch of lines that stays.

Defined cases: a null or empty text is one empty line; a null id is one document
of its own, smaller than all others; rows that repeat an id count as one document
and each gets its own bitmap; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the keys with at least ``HOT_ROWS`` lines, the most frequent ``HOT_KEYS`` are judged apart.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def lines_of(text: str | Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def mark_of(text: str | Column) -> Column:
    """Tells rows that repeat an id apart."""
    return F.xxhash64(text_or_empty(text))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """id, mark, n_dropped and keep (array of start and length) of each text that loses lines."""
    split = lines_of(f"`{text_col}`")
    source = df.select(F.col(f"`{id_col}`").alias("id"), mark_of(f"`{text_col}`").alias("mark"), split.alias("lines"), F.size(split).alias("n_lines"))
    lines = cut(
        source.select("id", "mark", "n_lines", F.posexplode("lines").alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .withColumn("line", key_of(F.col("line")))
        .filter(F.char_length("line") >= min_chars)
        .select("id", "mark", "n_lines", "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))
    )
    key = ["h1", "h2"]

    hot = cut(lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), *key).limit(HOT_KEYS).select(*key))
    hot_lines = lines.join(F.broadcast(hot), key)
    told = hot_lines.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_id"))
    hot_drops = lines.join(F.broadcast(told.filter(F.col("n_docs") >= min_docs)), key).filter(~F.col("id").eqNullSafe(F.col("last_id")))

    # In order of hash, document and position; what is kept of a key's lines before the current one is its first document.
    ordered = Window.partitionBy(*key).orderBy(F.col("id").desc_nulls_last(), "pos")
    seen = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = lines.join(F.broadcast(hot), key, "left_anti").repartitionByRange(partitions(df), *key)
    cold = cold.withColumns({"first_id": F.first("id").over(seen), "next_doc": (F.row_number().over(ordered) > 1) & ~F.col("id").eqNullSafe(F.lag("id").over(ordered))})
    cold_drops = (
        cold.withColumn("n_docs", 1 + F.sum(F.col("next_doc").cast("int")).over(Window.partitionBy(*key)))
        .filter((F.col("n_docs") >= min_docs) & ~F.col("id").eqNullSafe(F.col("first_id")))
    )

    place = ["id", "mark", "n_lines", "pos"]
    dropped = hot_drops.select(*place).unionByName(cold_drops.select(*place))
    by_text = dropped.groupBy("id", "mark", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda at: at + 1))
    ends = F.concat("gone", F.array("n_lines"))
    stretches = F.zip_with(starts, ends, lambda start, end: F.struct(start.alias("start"), (end - start).alias("length")))
    return by_text.select("id", "mark", F.size("gone").cast("long").alias("n_dropped"), F.filter(stretches, lambda s: s["length"] > 0).alias("keep"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with n_lines, n_dropped and kept_text."""
    marked = df.withColumn("__mark", mark_of(f"`{text_col}`"))
    told = bitmaps.select(F.col("id").alias("__id"), F.col("mark").alias("__told"), F.col("n_dropped").alias("__n"), F.col("keep").alias("__keep"))
    lines = lines_of(f"`{text_col}`")
    kept = F.flatten(F.transform("__keep", lambda s: F.slice(lines, s["start"] + 1, s["length"])))
    text = F.when(F.col("__keep").isNull(), text_or_empty(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    joined = marked.join(told.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__told")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.size(lines).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).alias("n_dropped"), text.alias("kept_text"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """id_col, n_lines, n_dropped and kept_text of every row."""
    source = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    done = apply_bitmaps(source, keep_bitmaps(source, id_col, text_col, min_chars, min_docs), id_col, text_col)
    return done.select(F.col(f"`{id_col}`"), "n_lines", "n_dropped", "kept_text")
