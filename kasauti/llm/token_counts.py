"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs that
have a merge, by rank and then by place. The lowest-ranked pair is popped again
and again, joined if it still stands, and its new neighbours are pushed. A word
has as many tokens as symbols at first less the merges done; no identifier is
looked up or emitted.

The vocabulary is a tokenizers file of a BPE model with word ends. Its own rules
hold: special strings in a text count one each and part the text; the rest is
normalised and split into words by the library that reads the file, as its tables
of characters are its own. Only what is plain ASCII is lower-cased and matched with
the file's pattern here, where no table can differ. All of these act within what
stands between two spaces, so a worker counts each distinct chunk once and keeps a
bounded table of counts.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); texts are counted
whole; empty tables give empty results; repeated rows each give a row; columns
not named in ``keep`` are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from string import punctuation

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .byte_bpe import ALPHABET
from .common import per_text

#: Chunks and words whose counts a worker keeps; longer ones than KEPT_CHARS are counted anew.
KEPT, KEPT_CHARS = 400_000, 64
#: What only the library may normalise and split.
ODD = re.compile(r"[^\t\n\r -~]")


def merge_count(symbols: list[int], pairs: dict[int, int]) -> int:
    """How many merges byte-pair encoding makes of ``symbols``.

    ``pairs`` maps left << 20 | right to rank << 20 | joined symbol.
    """
    n = len(symbols)
    symbols = [*symbols, 0]
    left, right = list(range(-1, n)), list(range(1, n + 2))
    heap = []
    for i in range(n - 1):
        found = pairs.get(symbols[i] << 20 | symbols[i + 1])
        if found is not None:
            heap.append((found, i))
    heapify(heap)
    merges = 0
    while heap:
        found, i = heappop(heap)
        j = right[i]
        if symbols[i] < 0 or j >= n or pairs.get(symbols[i] << 20 | symbols[j]) != found:
            continue  # one of the two was joined to another meanwhile
        symbols[i] = joined = found & 0xFFFFF
        symbols[j] = -1
        k = right[i] = right[j]
        merges += 1
        if k < n:
            left[k] = i
            if (new := pairs.get(joined << 20 | symbols[k])) is not None:
                heappush(heap, (new, i))
        h = left[i]
        if h >= 0 and (new := pairs.get(symbols[h] << 20 | joined)) is not None:
            heappush(heap, (new, h))
    return merges


class Counter:
    """Counts the tokens of texts; one for each worker and vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.pairs = {vocabulary[a] << 20 | vocabulary[b]: rank << 20 | vocabulary[a + b] for rank, (a, b) in enumerate(merges)}
        end = spec["model"]["end_of_word_suffix"] or ""
        #: Symbol of each character of the byte alphabet within a word and at its end; -1 for what the model, having no unknown token, drops.
        self.inner = {c: vocabulary.get(c, -1) for c in ALPHABET}
        self.last = {c: vocabulary.get(c + end, -1) for c in ALPHABET}
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.chunks: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of a word spelt in the byte alphabet."""
        n = self.known.get(word)
        if n is None:
            symbols = [self.inner[c] for c in word[:-1]]
            symbols.append(self.last[word[-1]])
            if -1 in symbols:
                symbols = [s for s in symbols if s >= 0]
            n = len(symbols) - merge_count(symbols, self.pairs)
            if len(word) <= KEPT_CHARS:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = n
        return n

    def _words(self, text: str) -> list[str]:
        if ODD.search(text):
            return [word for word, _ in self.split(self.normalise(text))]
        text = text.lower()
        bare = text.rstrip(punctuation)
        if bare.isalpha():  # as most chunks are; the pattern would give the same
            return [bare] if len(bare) == len(text) else [bare, text[len(bare) :]]
        return self.words.findall(text)

    def chunk(self, chunk: str) -> int:
        parts = self.special.split(chunk) if self.special and self.special.search(chunk) else [chunk]
        n = len(parts) - 1
        for part in parts:
            n += sum(map(self.word, self._words(part)))
        if len(chunk) <= KEPT_CHARS:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            self.chunks[chunk] = n
        return n

    def count(self, text: str) -> int:
        get, n = self.chunks.get, 0
        for chunk in text.split(" "):
            known = get(chunk)
            n += self.chunk(chunk) if known is None else known
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = 2048, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text), n_bytes, n_tokens and over_limit."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def run(texts: list[str]) -> dict[str, pa.Array]:
        counts = [counter(path).count(t) for t in texts]
        return {
            "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
        }

    return per_text(df, run, "n_bytes long, n_tokens long, over_limit boolean", text_col, keep)
