"""URL rules by a sort-merge range join over reversed hosts.

A host becomes the key of its labels in reverse order, each with a dot behind it
(``a.example.com`` -> ``com.example.a.``), so a rule's host and all its
subdomains are one interval of keys. The urls of a partition are sorted by key
and swept against the sorted rules; the sweep keeps a stack of the rules whose
intervals hold the current key, outermost first. Of the rules on the stack whose
path starts the url's path, the longest wins (host and path together; of equally
long ones the first in alphabetical order, and of rules of one host and path that
contradict each other the one that blocks). Nothing is shuffled, so a hot host
costs no more than its rows.

Rules are a parameter of the call. They travel to the tasks in blocks of at most
``BLOCK_RULES``; with more rules the sweep runs once for each block and keeps the
longest rule.

Defined cases: a null url, or one without ``://``, has empty host and path and
meets no rule; an empty table gives an empty result; repeated rows and repeated
ids each give a row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of what one task holds of the rules: at 200 bytes a rule about 20 MB.
BLOCK_RULES = 100_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, pattern: str) -> Rule:
    """``com/en/`` -> host ``com``, path ``/en/``."""
    host, slash, path = pattern.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_key(host: str) -> bytes:
    return "".join(f"{label}." for label in reversed(host.split("."))).encode()


def host_of(url: str | Column) -> Column:
    r"""After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_url(url), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_url(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _url(url: str | Column) -> Column:
    return F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))


class Sweep:
    """Feeds on keys in ascending order; remembers the nested rules around the last one."""

    def __init__(self, rules: Iterable[Rule]):
        by_host: dict[bytes, list[Rule]] = {}
        for r in rules:
            by_host.setdefault(host_key(r.host), []).append(r)
        #: In order of keys; the rules of one host longest path first, then by path.
        self.starts = [(k, sorted(v, key=lambda r: (-len(r.path), r.path))) for k, v in sorted(by_host.items())]
        self.at = 0
        self.stack: list[tuple[bytes, list[Rule]]] = []

    def best(self, key: bytes, path: str) -> Rule | None:
        while self.at < len(self.starts) and self.starts[self.at][0] <= key:
            start = self.starts[self.at]
            while self.stack and not start[0].startswith(self.stack[-1][0]):
                self.stack.pop()
            self.stack.append(start)
            self.at += 1
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        found = None
        for _, rules in self.stack:
            hit = next((r for r in rules if path.startswith(r.path)), None)
            if hit and (found is None or (-len(hit.name), hit.name) < (-len(found.name), found.name)):
                found = hit
        return found


def filter_urls(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (null if none fits) and verdict of every row."""
    out = df.select(F.col(f"`{id_col}`").alias("__id"), host_of(f"`{url_col}`").alias("host"), path_of(f"`{url_col}`").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    out = out.withColumn("__key", F.concat(F.array_join(labels, "."), F.lit(".")))
    # One rule for each host and path: "block" comes behind "allow".
    single = {(r.host, r.path): r for r in sorted(rules)}
    ordered = sorted(single.values(), key=lambda r: (host_key(r.host), r.path))
    blocks = [ordered[i : i + BLOCK_RULES] for i in range(0, len(ordered), BLOCK_RULES)]
    schema = out.schema
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            sweep = Sweep(block)
            for b in batches:
                cols = {n: b.column(n).to_pylist() for n in ("path", "rule", "verdict", "__key")}
                for i, (path, had, key) in enumerate(zip(cols["path"], cols["rule"], cols["__key"])):
                    best = sweep.best(key.encode(), path)
                    if best and (had is None or (-len(best.name), best.name) < (-len(had), had)):
                        cols["rule"][i], cols["verdict"][i] = best.name, best.verdict
                arrays = [pa.array(cols[n], pa.string()) if n in ("rule", "verdict") else b.column(n) for n in b.schema.names]
                yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

        out = out.sortWithinPartitions("__key").mapInArrow(run, schema)
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict")
