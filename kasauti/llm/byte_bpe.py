"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library encodes: the vocabulary is a file of ranks whose tokens
are byte strings, spelt in the library's byte alphabet (one character for each
byte). A rank file names no merges, so every split of a token into two tokens of
lower rank becomes a merge of that token's rank, which makes the library choose
as a reader of ranks would; whole words that are tokens are taken as they are.

The pattern never lets a match run on across a space that follows a character
other than white space, so texts are cut at those spaces, each distinct chunk is
encoded once by the library, and a bounded table keeps what recent chunks gave.
Texts with two spaces in a row go to the library whole. Texts are encoded whole.

Decoding turns each token's characters back into bytes and joins them before
anything is read as UTF-8, so characters that are split between tokens come out
whole; bytes that are no valid UTF-8 become U+FFFD in :func:`decode`'s text.

Defined cases: a null text counts as empty and has no ids; null ids decode to the
empty text; an unknown id is an error; empty tables give empty results; repeated
rows each give a row; further columns pass :func:`encode` and :func:`decode` by
name and are ignored elsewhere.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import per_text

#: Chunks in each of a worker's two tables of ids, and the longest chunk kept: some 150 MB at most.
KEPT_CHUNKS, KEPT_CHARS = 350_000, 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


ALPHABET = byte_alphabet()
BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}


def spelt(token: bytes) -> str:
    return "".join(ALPHABET[b] for b in token)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def library_tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    merges = [
        (spelt(token[:i]), spelt(token[i:]))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(token))
        if ranks.get(token[:i], rank) < rank and ranks.get(token[i:], rank) < rank
    ]
    tokenizer = Tokenizer(models.BPE(vocab={spelt(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class Codec:
    """Encodes texts and decodes ids; one for each worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = library_tokenizer(read_ranks(path), pattern)
        size = self.tokenizer.get_vocab_size()
        #: The byte table reversed: token -> bytes.
        self.bytes_of = [bytes(BYTE_OF[c] for c in self.tokenizer.id_to_token(i)) for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        #: Chunks met lately and before that; the younger table takes the older one's place when it is full.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of all chunks, as little-endian bytes."""
        unmet = chunks - self.kept.keys()
        found = {c: self.older[c] for c in unmet & self.older.keys()}
        inner, outer = [], []
        for c in unmet - found.keys():
            (inner if c[:1] == " " else outer).append(c)
        found |= {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(outer, self.tokenizer.encode_batch_fast(outer, add_special_tokens=False))}
        if inner:
            # No match crosses from one chunk into the next, so all are encoded as one text and the ids cut by bytes.
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(inner)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) for c in inner])) + 1
            raw, at = ids.tobytes(), 0
            for c, end in zip(inner, (ends * 4).tolist()):
                found[c] = raw[at:end]
                at = end
        long = {c: i for c, i in found.items() if len(c) > KEPT_CHARS}
        for c in long:
            del found[c]
        if len(self.kept) + len(found) > KEPT_CHUNKS:
            found |= {c: self.kept[c] for c in chunks & self.kept.keys()}
            self.older, self.kept = self.kept, {}
        self.kept.update(found)
        return self.kept | long if long else self.kept

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[t] if "  " in t or "\x00" in t else (t[:1] + t[1:].replace(" ", "\x00 ")).split("\x00") for t in texts]
        ids = self._learn({c for chunks in cut for c in chunks if len(chunks) > 1 or c[:1] != " "})
        return [b"".join([ids[c] for c in chunks]) if len(chunks) > 1 or chunks[0][:1] != " " else self._alone(chunks[0]) for chunks in cut]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last character of each token; one that holds part of a character covers it."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = ends - self.lengths[np.frombuffer(ids, "<u4")]
        return char_of[starts].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, offsets: bool = True) -> DataFrame:
    """``keep`` (all columns but the text), ids and, unless told otherwise, each token's start and end in characters."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def run(texts: list[str]) -> dict[str, pa.Array]:
        own = codec(path, pattern)
        ids = own.encode(texts)
        out = {"ids": _lists([np.frombuffer(i, "<u4") for i in ids], pa.int32())}
        if offsets:
            places = [own.offsets(t, i) for t, i in zip(texts, ids)]
            out |= {"starts": _lists([p[0] for p in places], pa.int32()), "ends": _lists([p[1] for p in places], pa.int32())}
        return out

    return per_text(df, run, "ids array<int>" + ", starts array<int>, ends array<int>" * offsets, text_col, keep)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the ids) and the decoded text."""
    keep = [c for c in df.columns if c != ids_col] if keep is None else keep
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            texts = [own.decode(np.array(i, "<u4").tobytes()).decode("utf-8", "replace") for i in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, "text string"]))


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 and n_split: :func:`encode` and :func:`decode` in one pass, of which digests stay.

    n_split is how many tokens begin within a character, by their offsets.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def run(texts: list[str]) -> dict[str, pa.Array]:
        own = codec(path, pattern)
        ids = own.encode(texts)
        return {
            "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids]),
            "n_split": pa.array([int((starts[1:] < ends[:-1]).sum()) for starts, ends in map(own.offsets, texts, ids)], pa.int64()),
        }

    return per_text(df, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long", text_col, keep)
