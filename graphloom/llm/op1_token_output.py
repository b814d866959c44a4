"""Token-id output: length-limited canonical Huffman codes from global counts, in blocks with bit-offset checkpoints.

Plan: encode every text once and keep (doc_id, ids) in the shared folder; sum the id counts of all documents (at
most one number per vocabulary entry reaches the driver); deal the documents out by ranges of doc_id; each range
becomes one file of segments; read the segments back and decode all blocks of a segment in lockstep.

Segment: ``b"HFS1"``, header lengths, code lengths of the vocabulary (one byte each, zlib), doc ids, tokens per
document, the bit length of every block of 512 tokens (their running sums are the checkpoints), then the bit stream.

Cases: null or empty text: only the end id.  Null doc_id: kept, sorts first.  Repeated rows and doc_ids: every row
is written and returned.  Empty table: no rows.  Very long text: one segment of its own.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, id_and_text, materialize, new_dir, partitions_for, read_table, rows_to_batch, small_batches
from .pieces import Memo, PieceSplitter, byte_alphabet, chunks, tokenizer_path

BLOCK = 512
PACKED = 64 * BLOCK  # tokens packed at a time, so that the arrays stay in a core's cache
SEGMENT_TOKENS = 1_000_000
FILE_TOKENS = 4_000_000
MAX_FILES = 20_000


# ---------------------------------------------------------------- canonical code


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for counts of 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("the limit leaves too few codes")
    used = used[np.argsort(counts[used], kind="stable")]
    freq = counts[used].astype(np.float64)
    row, single = freq, [np.ones(len(freq), bool)]
    for _ in range(limit - 1):
        half = len(row) // 2 * 2
        both = np.concatenate([freq, row[0:half:2] + row[1:half:2]])
        order = np.argsort(both, kind="stable")
        row = both[order]
        single.append(order < len(freq))
    take, lengths = 2 * len(freq) - 2, np.zeros(len(freq), np.uint8)
    for flags in reversed(single):
        n = int(np.count_nonzero(flags[:take]))
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[i]):
            code <<= n - before if before else 0
            codes[i], before = code, n
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream (big-endian words) and the bit length of every block."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    sizes = lengths.astype(np.int64)
    out = np.zeros((len(ids) * int(sizes.max()) >> 5) + 2, np.uint64)
    blocks, bits = [], 0
    for a in range(0, len(ids), PACKED):
        part = ids[a : a + PACKED]
        n = sizes[part]
        end = np.cumsum(n) + bits
        at = end - n
        value = codes[part] << (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        where = word[first]
        out[where] += np.add.reduceat(value >> np.uint64(32), first)
        out[where + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        blocks.append(np.add.reduceat(n, np.arange(0, len(part), BLOCK)))
        bits = int(end[-1])
    return out[: (bits >> 5) + 2].astype(">u4").tobytes(), np.concatenate(blocks).astype(np.uint32)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every ``width``-bit prefix the id it begins with and that id's length."""
    width = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (width - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    total = int(span.sum())
    symbols[:total], sizes[:total] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbols, sizes, width


def unpack(stream: bytes, blocks: np.ndarray, n_tokens: int, table) -> np.ndarray:
    """All blocks side by side, one symbol of each per step, each from its own checkpoint."""
    symbols, sizes, width = table
    if not n_tokens:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(stream, ">u4").astype(np.uint64)
    words = np.concatenate([words, np.zeros(BLOCK * width // 32 + 3, np.uint64)])
    pair = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.concatenate([[0], np.cumsum(blocks.astype(np.int64))[:-1]])
    out, mask = np.empty((BLOCK, len(blocks)), np.uint32), np.uint64((1 << width) - 1)
    for k in range(min(BLOCK, n_tokens)):
        peek = ((pair[at >> 5] >> (64 - width - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[k] = symbols[peek]
        at += sizes[peek]
    return out.T.reshape(-1)[:n_tokens].copy() if n_tokens >= BLOCK else out[:n_tokens, 0].copy()


# ---------------------------------------------------------------- segments


def write_segment(doc_ids: list, ids: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    table = zlib.compress(lengths.tobytes(), 6)
    stream, blocks = pack(np.concatenate(ids), codes, lengths)
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    sizes = np.array([len(i) for i in ids], "<u4").tobytes()
    head = struct.pack("<4sIIIQ", b"HFS1", len(doc_ids), len(table), len(blocks), sum(map(len, ids)))
    return head + table + nulls + docs + sizes + blocks.astype("<u4").tobytes() + stream


def read_segment(data: bytes, tables: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, tokens per document, all ids."""
    magic, n_docs, n_table, n_blocks, n_tokens = struct.unpack_from("<4sIIIQ", data)
    if magic != b"HFS1":
        raise ValueError("not a segment")
    at = struct.calcsize("<4sIIIQ")
    packed = data[at : at + n_table]
    if packed not in tables:
        tables.clear()
        tables[packed] = decode_table(np.frombuffer(zlib.decompress(packed), np.uint8))
    at += n_table
    nulls = np.frombuffer(data, np.uint8, n_docs, at)
    docs = np.frombuffer(data, "<i8", n_docs, at + n_docs)
    at += 9 * n_docs
    sizes = np.frombuffer(data, "<u4", n_docs, at)
    blocks = np.frombuffer(data, "<u4", n_blocks, at + 4 * n_docs)
    at += 4 * n_docs + 4 * n_blocks
    ids = unpack(data[at:], blocks, n_tokens, tables[packed])
    return [None if z else int(d) for d, z in zip(docs, nulls)], sizes.astype(np.int64), ids


# ---------------------------------------------------------------- encoding


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library's model, with memos of pieces and of white-space separated chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.splitter = PieceSplitter(path)
        tok = Tokenizer.from_file(path)
        self.tokenize, self.alphabet = tok.model.tokenize, "".join(byte_alphabet())
        self.dtype = np.dtype("<u2") if tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.numbers = [i.to_bytes(self.dtype.itemsize, "little") for i in range(tok.get_vocab_size())]
        self.pieces = Memo(self._piece, 1_000_000)
        self.chunks = Memo(self._chunk, 1_000_000)

    def _piece(self, piece: str) -> bytes:
        if piece in self.splitter.special:
            return self.numbers[self.splitter.special[piece]]
        if not (piece.isascii() and piece.isalnum()):  # these bytes stand for themselves
            piece = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return b"".join([self.numbers[t.id] for t in self.tokenize(piece)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # a word and what ends it, as the splitter has them, without its calls
            core = chunk.rstrip(",.")
            if core.isalpha():
                word = core.lower()
                if word == chunk:
                    return self._piece(word)
                return self.chunks[word] + self.pieces[chunk[len(core) :]] if len(core) < len(chunk) else self.chunks[word]
        return b"".join(map(self.pieces.__getitem__, self.splitter.pieces(chunk)))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        out = [b"".join(map(self.chunks.__getitem__, chunks(t))) + end for t in texts]
        self.pieces.trim()
        self.chunks.trim()
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and the ids of the whole text with the end id, as little-endian unsigned numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _encoders.get(path) or _encoders.setdefault(path, LibraryEncoder(path))
        end = np.array([end_id], enc.dtype).tobytes()
        for rows in small_batches(batches):
            ids = enc.encode([t or "" for _, t in rows], end)
            yield rows_to_batch([(r[0], i) for r, i in zip(rows, ids)], schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def global_counts(encoded: DataFrame, width: int, size: int) -> np.ndarray:
    """Occurrences of every id over all documents."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = pa.compute.binary_join(pa.ListArray.from_arrays([0, batch.num_rows], batch.column(0)), pa.scalar(b"", batch.column(0).type))
                total += np.bincount(np.frombuffer(ids[0].as_buffer(), f"<u{width}"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=schema)

    out = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, limit: int = 20) -> DataFrame:
    """Writes the files; returns one row per segment: file, offset, size, start (tokens before it), n_tokens."""
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or tokenizer_path()
    size = Tokenizer.from_file(path).get_vocab_size()
    width = 2 if size <= 65536 else 4
    encoded = materialize(encode_documents(docs, path, end_id), "token-ids")
    counts = global_counts(encoded, width, size)
    lengths = limited_lengths(counts, limit)
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    out_dir = new_dir(spark, "token-files")
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64())])
    files = min(MAX_FILES, partitions_for(counts.sum(), FILE_TOKENS, spark.sparkContext.defaultParallelism))

    def write(batches):
        lengths, codes = shared.value
        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        name, part = f"{root}/{uuid.uuid4().hex}.hfs", TaskContext.get().partitionId()  # a lost attempt's file is never named again
        found, held_ids, held, n, before, at = [], [], [], 0, 0, 0
        with fs.open_output_stream(name) as f:

            def flush():
                nonlocal held_ids, held, n, before, at
                data = write_segment(held_ids, held, codes, lengths)
                f.write(data)
                found.append((part, f"{out_dir}/{name.rpartition('/')[2]}", at, len(data), before, n))
                at, before, held_ids, held, n = at + len(data), before + n, [], [], 0

            for batch in batches:
                for d, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(v.as_py(), f"<u{width}")
                    held_ids.append(d)
                    held.append(ids)
                    n += len(ids)
                    if n >= SEGMENT_TOKENS:
                        flush()
            if held:
                flush()
        yield rows_to_batch(found, schema)

    ranged = encoded.repartitionByRange(files, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    segments = materialize(ranged.mapInArrow(write, "part int, file string, at long, size long, before long, n_tokens long"), "token-segments")
    start, starts = 0, []
    for r in sorted(segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        starts.append((r["part"], start))
        start += r["n"]
    offsets = spark.createDataFrame(starts, "part int, first long")  # at most MAX_FILES rows
    return segments.join(F.broadcast(offsets), "part").select("file", "at", "size", (F.col("first") + F.col("before")).alias("start"), "n_tokens")


def read_token_files(segments: DataFrame) -> DataFrame:
    """Reads segments back: doc_id, start, n_tokens, ids_crc32 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        tables: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = filesystem(row["file"])
                with fs.open_input_file(name) as f:
                    docs, sizes, ids = read_segment(f.read_at(row["size"], row["at"]), tables)
                ends, ids = np.cumsum(sizes), ids.astype("<u4")
                begins = ends - sizes
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, row["start"] + begins, sizes, crcs)], schema=schema)

    spread = segments.repartition(max(segments.sparkSession.sparkContext.defaultParallelism * 4, 12), "file", "at")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(read_table(spark, sf_dir, "documents"), end_id=2))
