"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of 13 consecutive words of the items; an item with fewer words is one pattern.  Patterns of
one length share a searcher: a shift table over blocks of two words says how far the search may jump, a block that
may end a pattern leads by the hash of its last words to the few patterns that end so, and these are compared word
by word.  All tables are sorted arrays, a few dozen bytes a word of the items.

Plan: the items are written to the shared folder in packs of bounded text, which tasks read as they need them; the driver
sees only their names.  Documents stream by once and are never shuffled.  A worker keeps the searchers of up to ``KEPT``
packs; with more, documents gather to blocks of ``BLOCK_BYTES``, and every pack is built once for each block.

Cases: null or wordless text: no words, nothing hit, not contaminated.  Items without words: no pattern.  Equal
items: all their ids are found.  Null doc_id and repeated rows: kept.  Empty tables: no rows, or nothing hit.  Null
item_id: ignored.  Very long texts: whole.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, filesystem, id_and_text, materialize, read_table, rows_to_batch, small_batches
from .op6_minhash import _mix, word_hashes

WINDOW = 13
TAIL = 4  # words at a pattern's end that choose its bucket
PACK_BYTES = 8 << 20
BLOCK_BYTES = 64 << 20
KEPT = 4


def normalized(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS)


def words_of(text: str | None) -> list[bytes]:
    return normalized(text).split()


def run_keys(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words, from the words' hashes."""
    m = max(0, len(h) - n + 1)
    key = np.full(m, n, np.uint64)
    for j, power in enumerate(np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))):
        key += h[j : j + m] * power
    return _mix(key)


class WuManber:
    """Patterns of one length ``m``: runs of ``words`` (with hashes ``h``) that begin at ``starts``, each of an item (by number)."""

    def __init__(self, words: list[bytes], h: np.ndarray, spans: list[tuple[int, int, int]], m: int):
        self.words, self.m, self.block = words, m, min(2, m)
        self.tail, self.jump = min(TAIL, m), m - self.block + 1
        blocks, tails, whole = (run_keys(h, n) for n in (self.block, self.tail, m))
        first = np.concatenate([np.arange(b, e - self.block + 1) for b, e, _ in spans])  # of every block
        ahead = np.concatenate([np.maximum(0, m - self.block - np.arange(e - b - self.block + 1)) for b, e, _ in spans])
        order = np.lexsort((ahead, blocks[first]))
        keys = blocks[first][order]
        least = np.r_[True, keys[1:] != keys[:-1]]
        self.block_keys, self.shifts = keys[least], ahead[order][least].astype(np.int64)
        starts = np.concatenate([np.arange(b, e - m + 1) for b, e, _ in spans])
        items = np.concatenate([np.full(e - b - m + 1, i) for b, e, i in spans])
        order = np.lexsort((starts, whole[starts], tails[starts + m - self.tail]))
        starts, items = starts[order], items[order]
        same = whole[starts]
        new = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])  # equal patterns, taken apart below if hashes lie
        self.tail_keys, self.starts = tails[starts[new] + m - self.tail], starts[new]
        self.ends, self.all_starts, self.items = np.r_[new[1:], len(starts)], starts, items
        self.begins = new

    def find(self, words: list[bytes], h: np.ndarray) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        m, block, n = self.m, self.block, len(h)
        if n < m:
            return
        keys = run_keys(h, block)
        at = np.minimum(np.searchsorted(self.block_keys, keys), len(self.block_keys) - 1)
        shift = np.where(self.block_keys[at] == keys, self.shifts[at], self.jump).tolist()
        end, ends = m, []
        while end <= n:
            if s := shift[end - block]:
                end += s
            else:
                ends.append(end)
                end += 1
        if not ends:
            return
        tails = run_keys(h, self.tail)[np.array(ends) - self.tail]
        low, high = np.searchsorted(self.tail_keys, tails, "left"), np.searchsorted(self.tail_keys, tails, "right")
        for end, a, b in zip(ends, low.tolist(), high.tolist()):
            if a == b:
                continue
            mine, found = words[end - m : end], set()
            for k in range(a, b):
                start = self.starts[k]
                if self.words[start : start + m] == mine:
                    found.update(i for s, i in zip(self.all_starts[self.begins[k] : self.ends[k]].tolist(), self.items[self.begins[k] : self.ends[k]].tolist()) if s == start or self.words[s : s + m] == mine)
            if found:
                yield end - m, found


class Searcher:
    """One Wu-Manber search for every pattern length among some items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        texts = [normalized(t) for _, t in items]
        hashes = word_hashes(texts) if texts else []
        words = [w for t in texts for w in t.split()]
        spans: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        for k, h in enumerate(hashes):
            if len(h):
                spans.setdefault(min(window, len(h)), []).append((at, at + len(h), k))
                at += len(h)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.searches = [WuManber(words, flat, s, m) for m, s in sorted(spans.items())]

    def spans(self, words: list[bytes], h: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        for s in self.searches:
            for start, items in s.find(words, h):
                yield start, start + s.m, {self.ids[i] for i in items}


def write_packs(benchmark: DataFrame, size: int = PACK_BYTES) -> list[tuple[str, ...]]:
    """Writes the items (i, t) to files of about ``size`` bytes of text; the files of every pack of at most about that."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).filter("i is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    written = materialize(items.repartition(max(1, math.ceil(total / size)), F.xxhash64("i", "t")), "items")
    packs: list[list[str]] = []
    left = 0
    for r in written.groupBy(F.input_file_name().alias("f")).agg(F.sum(F.octet_length("t")).alias("n")).orderBy("f").collect():  # a row per file
        if not packs or r["n"] > left:
            packs.append([])
            left = size
        packs[-1].append(r["f"])
        left -= r["n"]
    return [tuple(p) for p in packs]


_searchers: dict[tuple[tuple[str, ...], int], Searcher] = {}


def searcher(pack: tuple[str, ...], window: int) -> Searcher:
    """The searcher of a pack, among the last ``KEPT`` that this process has used."""
    found = _searchers.pop((pack, window), None)
    if found is None:
        items: list[tuple[str, str]] = []
        for name in pack:
            fs, path = filesystem(name)
            with fs.open_input_file(path) as f:
                t = pq.read_table(f)
            items += zip(t["i"].to_pylist(), t["t"].to_pylist())
        found = Searcher(items, window)
    _searchers[pack, window] = found
    while len(_searchers) > KEPT:
        del _searchers[next(iter(_searchers))]
    return found


def _gathered(batches, size: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    n = 0
    for rows in small_batches(batches, rows=512):
        held += rows
        n += sum(len(t) for _, t in rows)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (array of start, end in words), item_ids (sorted)."""
    packs = write_packs(benchmark, pack_bytes)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])

    def run(batches):
        for rows in _gathered(batches, BLOCK_BYTES if len(packs) > KEPT else 0):
            texts = [normalized(t) for _, t in rows]
            hashes = word_hashes(texts)
            found: list = [(set(), set()) for _ in rows]
            for pack in packs:
                search = searcher(pack, window)
                for (spans, items), t, h in zip(found, texts, hashes):
                    for a, b, ids in search.spans(Words(t), h):
                        spans.add((a, b))
                        items |= ids
            out = [(d, len(h), [{"start": a, "end": b} for a, b in sorted(s)], sorted(i)) for (d, _), h, (s, i) in zip(rows, hashes, found)]
            yield rows_to_batch(out, schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, item_ids array<string>")


class Words:
    """The words of a text, parted when the first is asked for: most texts come near no pattern."""

    def __init__(self, text: bytes):
        self.text, self.words = text, None

    def __getitem__(self, where: slice) -> list[bytes]:
        if self.words is None:
            self.words = self.text.split()
        return self.words[where]


def _hits():
    """Words covered by the sorted spans."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate("spans", zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_occurrences(docs, benchmark).withColumn("n_hit", _hits())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
