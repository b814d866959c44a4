"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of 2 KB, all of which are compressed with the good and with the bad dictionary.  The normalised
difference of two sizes, (a - b) / (a + b), says by how much the one is smaller: bad against good for the whole text and
for its worst block, and the text itself against good, as far as this is beyond ``ORDINARY``, which only repeated text
reaches.  These differences become one calibrated score.  Dictionaries and calibration come from a bounded sample of labelled rows outside the held-out fold (at most
``PER_CLASS`` documents and ``labelled.SAMPLE_BYTES`` of text of either label), the one half for the dictionaries, the
other for the calibration.  A dictionary is trained on all blocks of its half, or on a random ``TRAINING_BYTES`` of them;
where they are too few for the trainer, their text is the dictionary.

Plan: one pass over the documents, no shuffle; the dictionaries (64 KB each) travel to the tasks.

Cases: null or empty text: differences of 0, so the calibration's score for no evidence.  With fewer than four texts of
either label: the share of good labels (1 without labels).  Documents labelled both ways teach nothing, of repeated ids
the least text does.  Null doc_id and repeated rows: kept.  Empty table: no rows.  Very long texts: all blocks.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import fold, id_and_text, read_table, rows_to_batch, small_batches
from .labelled import labelled_sample, linear, logistic, sigmoid

PER_CLASS = 1500
DICTIONARY = 64 << 10
TRAINING_BYTES = 40 * DICTIONARY
LEAST_TEXTS = 4
BLOCK = 2048
LEVEL = 3
ORDINARY = 0.5  # the difference where a text shrinks to a third
THRESHOLD = 0.3


def blocks_of(text: str | None) -> list[bytes]:
    """Blocks of about equal size, none longer than BLOCK."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = -(-len(data) // BLOCK)
    return [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]


def _difference(a: float, b: float) -> float:
    return (a - b) / (a + b) if a + b else 0.0


def _difference(a: float, b: float) -> float:
    return (a - b) / (a + b) if a + b else 0.0


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Normalised size differences: bad against good of the text and of its worst block; text against good, beyond
        ``ORDINARY``."""
        worst, size, total_good, total_bad = 1.0, 0, 0, 0
        good, bad = self.pair
        for b in blocks_of(text):
            g, d = len(good.compress(b)), len(bad.compress(b))
            size, total_good, total_bad = size + len(b), total_good + g, total_bad + d
            worst = min(worst, _difference(d, g))
        if not size:
            return 0.0, 0.0, 0.0
        return _difference(total_bad, total_good), worst, max(0.0, _difference(size, total_good) - ORDINARY)


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights


def _dictionary(texts: list[str]) -> bytes:
    parts = [b for t in texts for b in blocks_of(t)]
    size = sum(map(len, parts))
    if size > TRAINING_BYTES:
        keep = np.random.default_rng(3).permutation(len(parts))
        parts = [parts[i] for i in keep[: max(8, int(len(parts) * TRAINING_BYTES / size))]]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-DICTIONARY:]


def train(sample: list[tuple[str, int]], share: float | None = None) -> Model | None:
    by = [[t for t, y in sample if y == k and t] for k in (0, 1)]
    if min(map(len, by)) < LEAST_TEXTS:
        return None
    bad, good = (_dictionary(ts[0::2]) for ts in by)
    c = Compressors(good, bad)
    rest = [(t, k) for k in (0, 1) for t in by[k][1::2]]
    x, y = np.array([c.features(t) for t, _ in rest]), np.array([k for _, k in rest])
    return Model(good, bad, logistic(x, y, 1e-4, share))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5) -> DataFrame:
    sample, share = labelled_sample(docs, labels, "quality", per_class, modulus)
    prior = share if sample else 1.0
    shared = docs.sparkSession.sparkContext.broadcast(train(sample, share))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        model = shared.value
        c = Compressors(model.good, model.bad) if model else None
        for rows in small_batches(batches):
            if c:
                x = np.array([c.features(t) for *_, t in rows])
                scores = sigmoid(linear(x, model.weights)).tolist()
            else:
                scores = [prior] * len(rows)
            yield rows_to_batch([(d, h, s, int(s >= THRESHOLD)) for (d, h, _), s in zip(rows, scores)], schema)

    rows = id_and_text(docs).select("doc_id", (fold("doc_id", modulus) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
