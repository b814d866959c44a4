"""BPE encoding and decoding of document tables with the streaming transducer and the decoding machine of ``bpe.py``.

The operator returns ids and what the machine makes of them; the query derives its digests from these columns.  Texts
go through in slices cut at white space.  What the transducer gives out for a chunk between white space is remembered,
as pieces never cross it; the decoding machine reads the ids of the whole document, slice after slice.

Cases: null or empty text: no ids, empty text.  Null doc_id and repeated rows: kept.  Empty table: no rows.  Very long
pre-tokens: constant memory by the transducer.  Special strings in a text become their ids, as the library does.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Decoder, Transducer
from .common import id_and_text, read_table, rows_to_batch, small_batches
from .pieces import Memo, chunks, slices, tokenizer_path


class Codec:
    """Transducer and decoding machine, with memos of pieces and of white-space separated chunks."""

    def __init__(self, path: str):
        self.bpe = Transducer(path)
        self.decoder = Decoder(self.bpe.names)
        self.pieces = Memo(lambda piece: np.array(self.bpe.encode_piece(piece), np.int32).tobytes(), 200_000)
        self.chunks = Memo(lambda chunk: b"".join(map(self.pieces.__getitem__, self.bpe.splitter.pieces(chunk))))

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, slice by slice."""
        for part in slices(text):
            yield np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks(part))), np.int32)

    def decode(self, slices_of_ids) -> str:
        self.decoder.reset()
        out = [self.decoder.feed(ids.tolist()) for ids in slices_of_ids]
        return "".join([*out, self.decoder.finish()])

    def trim(self) -> None:
        self.pieces.trim()
        self.chunks.trim()


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    return _codecs.get(path) or _codecs.setdefault(path, Codec(path))


def _lists(lists: list[list[np.ndarray]]) -> pa.Array:
    """One list of ids per row, from its slices."""
    ends = np.cumsum([0, *(sum(map(len, row)) for row in lists)])
    flat = [ids for row in lists for ids in row]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    path = path or tokenizer_path()

    def run(batches):
        codec = _codec(path)
        for rows in small_batches(batches):
            ids = [list(codec.encode(t or "")) for _, t in rows]
            codec.trim()
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), _lists(ids)], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of a table with doc_id and ids; null ids: empty text."""
    path = path or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = _codec(path)
        for rows in small_batches(batches):
            yield rows_to_batch([(d, codec.decode([np.array(i or [], np.int32)])) for d, i in rows], schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text they decode to, in one pass: a slice is decoded as soon as it is encoded."""
    path = path or tokenizer_path()

    def run(batches):
        codec = _codec(path)
        for rows in small_batches(batches):
            ids, texts = [], []
            for _, t in rows:
                ids.append([])

                def kept(row=ids[-1], text=t or ""):
                    for some in codec.encode(text):
                        row.append(some)
                        yield some

                texts.append(codec.decode(kept()))
            codec.trim()
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), _lists(ids), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(coded: DataFrame, *kept: str) -> DataFrame:
    """Counts and digests of the ids and texts of ``round_trip``, beside the columns to keep."""
    return coded.select(
        "doc_id",
        *kept,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(read_table(spark, sf_dir, "documents")))
