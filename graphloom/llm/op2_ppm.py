"""Language-model scores by prediction by partial matching over bytes, pretrained on the training documents.

A text is written as a space, its lower-cased words with a space behind each, and the end.  Every byte behind the first
is predicted from up to ``ORDER`` bytes before it, across word borders.  The trie of contexts holds how often each byte
followed each context in the training documents.  The longest context seen speaks first: a byte that followed it c of n
times has (2c-1)/2n; else its escape d/2n (d distinct bytes) is paid and the next shorter context is asked, without the
bytes that the longer ones have.  Below the empty context the bytes left are equally likely.  So the probabilities of all
bytes in a context sum to one.

Plan: a place is a context with the byte that follows it, packed into one number.  Places and words (as 63-bit hashes)
of all documents are counted in one pass with pre-aggregation and one shuffle.  Contexts of up to one byte have 65,536
places at most and go to every task; all longer contexts of a place end in the same two bytes, so places are grouped by
these and each distinct one is scored once.  The most frequent words and places, ``HOT_WORDS`` and ``HOT_PLACES`` at most,
are looked up while the documents stream by; the others meet their table in a join, in which no key is hot.  Neither the
order nor any score depends on these bounds or on the size of the tables.

Cases: null or empty text: one token, the end.  Null doc_id: kept.  Repeated rows and doc_ids: one result each.
Empty table: no rows.  Without training documents every byte is equally likely.  Very long texts: whole.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, fold, id_and_text, materialize, read_table, small_batches
from .op6_minhash import word_hashes

ORDER = 5
HOT_WORDS = 1 << 20
HOT_PLACES = 1 << 21
END = b"\n"
WORD, PLACE = 0, 1
_DEPTH = 48  # bits of a context of ORDER bytes and the byte behind it
_EDGE = (1 << _DEPTH) - 1


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space; the end is added by the callers."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def spelled(text: str | None) -> bytes:
    """The bytes of a text as the model reads them; the first is given."""
    return b" ".join([b"", *tokens_of(text), END])


def word_keys(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words and the end of spelled texts, not negative."""
    return [(h >> np.uint64(1)).view(np.int64) for h in word_hashes(texts)]


def places_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all predicted bytes of spelled texts, one text after the other, and how many each text has."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    edge = data | np.int64(ORDER << _DEPTH)
    for j in range(1, ORDER + 1):
        edge[j:] |= data[:-j] << np.int64(8 * j)
    for j in range(1, ORDER):
        at = (start + j)[size > j]
        edge[at] = (edge[at] & np.int64((1 << 8 * (j + 1)) - 1)) | np.int64(j << _DEPTH)
    real = np.ones(len(data), bool)
    real[start] = False
    return edge[real], size - 1


# ---------------------------------------------------------------- the trie


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Level:
    """The contexts of one length: sorted edges (context and byte) with counts; n, d and the first edge of each context."""

    def __init__(self, edges: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.edges, back = np.unique(edges, return_inverse=True)
        self.c = np.bincount(back, counts, len(self.edges))
        self.contexts, first = np.unique(self.edges >> 8, return_index=True)
        self.d = np.diff(np.r_[first, len(self.edges)]).astype(float)
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        self.n = total(self.c)
        #: how often the next shorter context was followed by the bytes seen here
        self.above = np.zeros(len(self.contexts))
        if shorter is not None and len(first):
            bits = 8 * int(shorter.length + 1)
            self.above = total(shorter.c[np.searchsorted(shorter.edges, self.edges & np.int64((1 << bits) - 1))])
        self.length = 0 if shorter is None else shorter.length + 1


def levels_of(places: np.ndarray, counts: np.ndarray, low: list[Level] = ()) -> list[Level]:
    """All levels of a trie; ``low`` are those of the shortest contexts where they are known already."""
    out, depth, edge = list(low), places >> _DEPTH, places & _EDGE
    for j in range(len(out), ORDER + 1):
        deep = depth >= j
        out.append(Level(edge[deep] & np.int64((1 << 8 * (j + 1)) - 1), counts[deep], out[-1] if out else None))
    return out


def score_places(levels: list[Level], places: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of every place: from the longest context down, escapes and exclusion included."""
    depth, edge = places >> _DEPTH, places & _EDGE
    out, left = np.zeros(len(places)), np.ones(len(places), bool)
    gone_n, gone_d = np.zeros(len(places)), np.zeros(len(places))  # excluded: their count in this context, how many
    for j in range(ORDER, -1, -1):
        level, asked = levels[j], np.flatnonzero(left & (depth >= j))
        own = edge[asked] & np.int64((1 << 8 * (j + 1)) - 1)
        at, seen = _find(level.contexts, own >> 8)
        asked, own, at = asked[seen], own[seen], at[seen]
        n, d = level.n[at] - gone_n[asked], level.d[at] - gone_d[asked]
        where, hit = _find(level.edges, own)
        out[asked[hit]] += np.log10((2 * level.c[where[hit]] - 1) / (2 * n[hit]))
        left[asked[hit]] = False
        escape = ~hit & (d > 0)
        out[asked[escape]] += np.log10(d[escape] / (2 * n[escape]))
        gone_n[asked], gone_d[asked] = level.above[at], level.d[at]
    rest = np.flatnonzero(left)
    out[rest] -= np.log10(256 - gone_d[rest])
    return out


# ---------------------------------------------------------------- look-up of numbers


class Table:
    """Keys that aren't negative, with a value each, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]
            won = free & (self.keys[at] == keys[rest])
            self.values[at[won]] = values[rest[won]]
            rest, at = rest[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and which keys are there."""
        at = self._slot(keys)
        here = self.keys[at]
        found = here == keys
        out = np.where(found, self.values[at], 0.0)
        rest = np.flatnonzero(~found & (here >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.keys) - 1)
            here = self.keys[at]
            hit = here == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            found[rest[hit]] = True
            on = ~hit & (here >= 0)
            rest, at = rest[on], at[on]
        return out, found


# ---------------------------------------------------------------- the documents


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """kind, key, c (in training documents), n (in all) of every word and place."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches):
        raw: dict = {(kind, held): [] for kind in (WORD, PLACE) for held in (False, True)}
        kept: dict = {k: [] for k in raw}
        held_rows = 0

        def pack():
            for k, arrays in raw.items():
                if arrays:
                    kept[k].append(_summed([(a, np.ones(len(a), np.int64)) for a in [np.concatenate(arrays)]]))
                    kept[k] = [_summed(kept[k])]
                    arrays.clear()

        def rows():
            for (kind, held), parts in kept.items():
                for keys, n in parts:
                    for at in range(0, len(keys), 65_536):
                        k, m = keys[at : at + 65_536], n[at : at + 65_536]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(m * (not held)), pa.array(m)], schema=schema)
                parts.clear()

        for part in small_batches(batches, rows=512, chars=1_000_000):
            for held in (False, True):
                texts = [spelled(t) for h, t in part if bool(h) == held]
                if texts:
                    places, _ = places_of(texts)
                    raw[PLACE, held].append(places)
                    raw[WORD, held].append(np.concatenate(word_keys(texts)))
                    held_rows += len(places)
            if held_rows > 2_000_000:
                pack()
                held_rows = 0
                if sum(len(k) for parts in kept.values() for k, _ in parts) > 3_000_000:
                    yield from rows()
        pack()
        yield from rows()

    counted = docs.select("held_out", "text").mapInArrow(run, "kind int, key long, c long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def spell(places: DataFrame) -> DataFrame:
    """key, n, lp: the log10 probability of every place; places: key, c, n."""
    edge = F.col("key").bitwiseAND(F.lit((1 << 16) - 1))
    short = places.filter("c > 0").groupBy(edge.alias("key")).agg(F.sum("c").alias("c")).toArrow()  # at most 65,536 rows
    seen = short["key"].to_numpy()
    low = levels_of(seen | np.int64(1 << _DEPTH), short["c"].to_numpy().astype(float))[:2]
    shared = places.sparkSession.sparkContext.broadcast(low)

    def run(group: pa.Table) -> pa.Table:
        keys, c = group["key"].to_numpy(), group["c"].to_numpy().astype(float)
        levels = levels_of(keys[c > 0], c[c > 0], shared.value)
        return pa.table({"key": group["key"], "n": group["n"], "lp": pa.array(score_places(levels, keys))})

    last_two = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 16) - 1)).alias("last_two")
    return places.select("key", "c", "n", last_two).groupBy("last_two").applyInArrow(run, "key long, n long, lp double")


def hottest(rows: DataFrame, limit: int, *columns: str) -> pa.Table:
    """The rows with the greatest n, at most ``limit``, as whole classes of about equal n."""
    size = F.floor(F.log2("n") * 4).cast("int").alias("size")
    least, total = 1 << 30, 0
    for r in sorted(rows.groupBy(size).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["size"]):  # a few hundred
        total += r["m"]
        if total > limit:
            break
        least = r["size"]
    return rows.filter(size >= least).select(*columns).toArrow()


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, hot_words: int = HOT_WORDS, hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = id_and_text(docs).withColumn("held_out", fold("doc_id", modulus) == remainder)
    counts = materialize(count(docs), "counts")
    words = counts.filter(F.col("kind") == WORD)
    n_train, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    words = words.select("key", "n", F.log10((F.col("c") + 1) / F.lit(float(n_train + v + 1))).alias("lp"))
    places = materialize(spell(counts.filter(F.col("kind") == PLACE)), "places")
    tables = []
    for rows, limit in ((words, hot_words), (places, hot_places)):
        top = hottest(rows, limit, "key", "lp")
        tables.append(Table(top["key"].to_numpy(), top["lp"].to_numpy()))
    shared = spark.sparkContext.broadcast(tables)
    unknown = float(np.log10(1.5 / (n_train + v + 1)))  # between the shares of words seen once and never
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare_words", pa.list_(pa.int64())), ("rare_places", pa.list_(pa.int64()))])

    def look_up(batches):
        by_word, by_place = shared.value
        rid = TaskContext.get().partitionId() << 33
        for part in small_batches(batches, rows=512, chars=1_000_000):
            texts = [spelled(t) for *_, t in part]
            word = word_keys(texts)
            n_words = np.array([len(w) for w in word])
            word = np.concatenate(word)
            place, n_places = places_of(texts)
            columns = [pa.array(range(rid, rid + len(part)), pa.int64()), pa.array([d for d, *_ in part], pa.int64()), pa.array([h for _, h, _ in part], pa.bool_()), pa.array(n_words)]
            rare = []
            for keys, sizes, table in ((word, n_words, by_word), (place, n_places, by_place)):
                lp, found = table.get(keys)
                begin = np.cumsum(sizes) - sizes
                if table is by_word:
                    columns.append(pa.array(np.add.reduceat((found & (lp > unknown)).astype(np.int64), begin)))
                columns.append(pa.array(np.add.reduceat(lp, begin)))
                ends = np.r_[0, np.cumsum(np.add.reduceat((~found).astype(np.int64), begin))]
                rare.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[~found])))
            rid += len(part)
            yield pa.RecordBatch.from_arrays([*columns, *rare], schema=schema)

    ddl = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare_words array<long>, rare_places array<long>"
    looked_up = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(look_up, ddl), "hot-scores")
    rare = [looked_up.select("rid", F.lit(kind).alias("kind"), F.explode(c).alias("key")) for kind, c in ((WORD, "rare_words"), (PLACE, "rare_places"))]
    values = [rows.select(F.lit(kind).alias("kind"), "key", "lp") for kind, rows in ((WORD, words), (PLACE, places))]
    met = rare[0].unionAll(rare[1]).join(values[0].unionAll(values[1]).hint("shuffle_hash"), ["kind", "key"])
    is_word, none = F.col("kind") == WORD, F.lit(0.0)
    rest = met.groupBy("rid").agg(
        F.count_if(is_word & (F.col("lp") > unknown)).alias("k"),
        F.sum(F.when(is_word, F.col("lp")).otherwise(none)).alias("b"),
        F.sum(F.when(is_word, none).otherwise(F.col("lp"))).alias("s"),
    )
    return looked_up.drop("rare_words", "rare_places").join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", none)).alias("base_score"),
        (F.col("score") + F.coalesce("s", none)).alias("score"),
    )


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
