"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is compressed with each; the difference of the two
sizes over their sum, and their mean over the text's length, are calibrated to a
probability by a logistic regression. Dictionaries learn from one half of the
training sample and the calibration from the other, as a dictionary flatters the
texts it was built from.

The sample is bounded: at most ``per_class`` rows of each label and ``max_bytes``
a text. Every text is scored whole.

Defined cases: a null text counts as empty and is scored as such; without two
rows of each label every text gets the share of good labels, (good + 1) / (all +
2); empty tables give empty results; repeated rows each give a row; columns
other than id, text and label are never read.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import per_text
from .learning import platt, sigmoid, training_rows

DICTIONARY_BYTES = 64 << 10
LEVEL = 3
PER_CLASS = 1500
MAX_BYTES = 32 << 10
#: Added to a text's length, so that frame overhead does not swamp short texts.
OVERHEAD = 20


class Model(NamedTuple):
    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    #: Score of every text where there was too little to learn from, else None.
    constant: float | None = None


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or with too few texts for that, their last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str, good: bytes, bad: bytes) -> tuple[float, float]:
    """Normalised difference of the compressed sizes (higher: nearer to good), and their mean over the length."""
    raw = text.encode("utf-8", "surrogatepass")
    by_good, by_bad = len(_compressor(good).compress(raw)), len(_compressor(bad).compress(raw))
    return (by_bad - by_good) / (by_bad + by_good), (by_bad + by_good) / 2 / (len(raw) + OVERHEAD)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    bad, good, counts = training_rows(docs, labels, label_col, per_class, max_bytes, id_col, text_col)
    if min(len(bad), len(good)) < 2:
        return Model(b"", b"", (), (), (), (counts[1] + 1) / (sum(counts) + 2))
    first = [[t.encode("utf-8", "surrogatepass") for t in texts[: len(texts) // 2]] for texts in (bad, good)]
    of_bad, of_good = map(dictionary, first)
    rest = [(t, label) for label, texts in enumerate((bad, good)) for t in texts[len(texts) // 2 :]]
    x, y = np.array([features(t, of_good, of_bad) for t, _ in rest]), np.array([label for _, label in rest])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    # Sampled by label; the weights give each label its share of the labelled rows again.
    weight = np.where(y == 1, counts[1] / sum(counts) / (y == 1).mean(), counts[0] / sum(counts) / (y == 0).mean())
    return Model(of_good, of_bad, tuple(centre.tolist()), tuple(scale.tolist()), tuple(platt((x - centre) / scale, y, weight).tolist()))


def scores(texts: list[str], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = np.array([features(t, model.good, model.bad) for t in texts]).reshape(-1, len(model.centre))
    z = (x - np.array(model.centre)) / np.array(model.scale)
    return sigmoid(z @ np.array(model.weights[:-1]) + model.weights[-1])


def score(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text), score and predicted (1 from the threshold on)."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def run(texts: list[str]) -> dict[str, pa.Array]:
        s = scores(texts, model)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return per_text(df, run, "score double, predicted int", text_col, keep)
