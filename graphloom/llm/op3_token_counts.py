"""Token counts with a whole-token shortcut.

Offline, the merge list is run once on every vocabulary string that ends a word: where it comes out as that one
token, the string is proven, and a pre-token equal to it counts 1 without merging.  Only other pre-tokens are merged.

Cases: null or empty text: 0 tokens.  Null doc_id and repeated rows: kept.  Empty table: no rows.  Very long texts and
pre-tokens: whole, the latter by the streaming merge.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Transducer
from .common import id_and_text, read_table, rows_to_batch, small_batches
from .pieces import Memo, chunks, tokenizer_path

LIMIT = 2048


class TokenCounter:
    def __init__(self, path: str):
        self.bpe = Transducer(path)
        self.proven = self._prove()
        self.merged = Memo(lambda piece: sum(1 for _ in self.bpe.stream_piece(piece)))
        self.memo = Memo(self.count_chunk)

    def _prove(self) -> set[str]:
        """Words whose own encoding is one token."""
        end, table, back = self.bpe.table.end, self.bpe.table, self.bpe._back
        out = set()
        for token in table.vocab:
            if token.endswith(end) and len(token) > len(end) and all(c in back for c in token[: -len(end)]):
                raw = bytes(back[c] for c in token[: -len(end)])
                try:
                    word = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if len(self.bpe.encode_piece(word)) == 1:
                    out.add(word)
        return out

    def count_chunk(self, chunk: str) -> int:
        proven, merged = self.proven, self.merged
        return sum(1 if p in proven else merged[p] for p in self.bpe.splitter.pieces(chunk))

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, chunks(text)))

    def trim(self) -> None:
        self.memo.trim()
        self.merged.trim()


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    path = path or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, TokenCounter(path))
        for rows in small_batches(batches):
            out = [(d, len((t or "").encode()), n := counter.count(t or ""), n > limit) for d, t in rows]
            counter.trim()
            yield rows_to_batch(out, schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
