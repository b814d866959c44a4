"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII bytes; a shingle is five of them.  Its weight is
(1 + ln tf) times the mean idf of its words.  idf comes from the document frequencies of 2**20 word hashes over all
documents and lies between 1 and 2: shingle frequencies themselves would give the shared text of a large group of
copies next to no weight, and so hide the group.  Of so many hashes one gathers the other words of about
(distinct words in a document) / 2**20 of the documents, at any number of documents; a word in fewer than one of 1,000
documents weighs most, so hashes don't fill up.  Each of 80 samples picks one (shingle, level) of a document such
that two documents agree with the probability of their weighted Jaccard similarity; 16 bands of five make buckets, so
a pair of similarity 0.8 shares one with probability 0.998.

Documents of equal words are one class from the start.  In every bucket all classes are compared with a leader; those
alike it are linked through it.  Every other pair of the bucket is compared as well, in cells of two blocks of rows,
unless it is linked already or can't be alike: one minus weighted Jaccard is a metric, so two classes differ by at
least the difference of their distances to the leader.  So a bucket of one group costs as many comparisons as members,
whatever its size, one of unlike texts all its pairs, and no bucket is capped.  Links (weighted Jaccard of at least 0.8,
from the whole texts) go through connected components.

Cases: null, empty and wordless texts: each its own group.  Fewer than five words: the words are one shingle.  Null
doc_id: kept; its group bears the least other id, or null.  Repeated rows: all returned, in one group.  Empty table:
no rows.  Very long texts: whole.  Ties between samples go to the smaller shingle hash.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components

from .common import WORDS, id_and_text, materialize, read_table, rows_to_batch, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 5
BLOCK = 128  # rows of a bucket on one side of a cell
SLACK = 1e-3  # of bounds, for rounding
IDF_BUCKETS = 1 << 20
RARE = 1000  # words in fewer than one document of so many weigh alike

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SEED = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal steps, by bisection of 1 - (1+x)e^-x."""
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return ((low + high) / 2).astype(np.float32)


_GAMMA = _gamma_quantiles()
_LOG_GAMMA = np.log(_GAMMA)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash of every word of every normalised text (words parted by spaces)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = data != 32
    if not word.any():
        return [np.zeros(0, np.uint64) for _ in texts]
    edge = np.diff(np.r_[0, word.astype(np.int8), 0])
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(word)
    size = stop - start
    begin = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(begin, size)
    power = np.cumprod(np.full(int(size.max()) + 1, 0x100000001B3, np.uint64))
    hashes = _mix(np.add.reduceat(_BYTE[data[at]] * power[place], begin) + size.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(start, ends[:-1]))


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their weights."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    k = min(SHINGLE, n)
    m, rare = n - k + 1, idf[(words & np.uint64(len(idf) - 1)).astype(np.int64)]
    h, weight = np.full(m, k, np.uint64), np.zeros(m, np.float32)
    for j in range(k):
        h += words[j : j + m] * _STEP[j]
        weight += rare[j : j + m]
    h, first, tf = np.unique(_mix(h), return_index=True, return_counts=True)
    return h, weight[first] / k * (1 + np.log(tf.astype(np.float32)))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Band keys (documents x BANDS) of non-empty weighted sets.

    Shingle hashes are mixed already, so the three random numbers of a sample are 16-bit lanes of one product with an odd
    number of that sample.
    """
    size = np.array([len(h) for h, _ in sets])
    begin = np.cumsum(size) - size
    h = np.concatenate([h for h, _ in sets])
    logw = np.log(np.concatenate([w for _, w in sets])).astype(np.float32)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    doc = np.repeat(np.arange(len(sets)), size)
    x, lanes = np.empty_like(h), np.empty((4, len(h)), np.uint16)
    r, a, t, beta = (np.empty(len(h), np.float32) for _ in range(4))
    for d, seed in enumerate(_SEED):
        np.multiply(h, seed | np.uint64(1), out=x)
        lanes[1:] = x.view(np.uint16).reshape(-1, 4).T[1:]  # the lowest lane is the least mixed
        np.take(_GAMMA, lanes[3], out=r, mode="clip")
        np.take(_LOG_GAMMA, lanes[2], out=a, mode="clip")
        np.multiply(lanes[1], np.float32(1 / 65536), out=beta)
        np.divide(logw, r, out=t)
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= 1
        beta *= r
        a += beta  # ln c - r (t - beta) - r
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, begin), size))
        owner = doc[least]
        pick = least[np.r_[True, owner[1:] != owner[:-1]]]  # the smaller shingle hash of a tie, as they are sorted
        band = d // ROWS
        keys[:, band] = _mix(keys[:, band] + h[pick] + t[pick].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def normalized(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS)


def class_key(norm: bytes) -> bytes | None:
    """128 bits of the words; None without words."""
    words = norm.split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


# ---------------------------------------------------------------- plan


def idf_table(docs: DataFrame) -> np.ndarray:
    schema = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])

    def run(batches):
        total, n = np.zeros(IDF_BUCKETS, np.int64), 0
        for rows in small_batches(batches):
            for words in word_hashes([normalized(t) for (t,) in rows]):
                n += 1
                total[np.unique((words & np.uint64(IDF_BUCKETS - 1)).astype(np.int64))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, total[at]], pa.int64())], schema=schema)

    df, n = np.zeros(IDF_BUCKETS), 0
    got = docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    for b, v in zip(got["bucket"].to_numpy(), got["df"].to_numpy()):  # at most IDF_BUCKETS + 1 rows
        if b < 0:
            n = v
        else:
            df[b] = v
    rarity = np.log((n + 1) / (np.maximum(df, n / RARE) + 1)) / math.log(RARE)
    return (1 + np.clip(rarity, 0, 1)).astype(np.float32)


def text_digest():
    return F.xxhash64("text").alias("digest")


def sign(docs: DataFrame, idf) -> DataFrame:
    """doc_id, digest of the text, ckey, keys (one per band); without words ckey and keys are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("ckey", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for rows in small_batches(batches):
            norm = [normalized(t) for *_, t in rows]
            keys = [class_key(x) for x in norm]
            some = [i for i, k in enumerate(keys) if k]
            bands: list = [None] * len(rows)
            if some:
                sets = [shingles(w, idf.value) for w in word_hashes([norm[i] for i in some])]
                for i, b in zip(some, signatures(sets)):
                    bands[i] = b.tolist()
            yield rows_to_batch([(d, g, k, b) for (d, g, _), k, b in zip(rows, keys, bands)], schema)

    return docs.select("doc_id", text_digest(), "text").mapInArrow(run, "doc_id long, digest long, ckey binary, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """a, b, alike (weighted Jaccard) for pairs of classes; a's shingles are kept while pairs of the same a follow."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("alike", pa.float64())])

    def run(batches):
        last, left = None, None
        for rows in small_batches(batches):
            some = word_hashes([normalized(t) for r in rows for t in r[2:]])
            out = []
            for i, (a, b, *_) in enumerate(rows):
                if a != last:
                    last, left = a, shingles(some[2 * i], idf.value)
                out.append((a, b, similarity(left, shingles(some[2 * i + 1], idf.value))))
            yield rows_to_batch(out, schema)

    t = texts.select(F.col("ckey").alias("b"), F.col("text").alias("text_b"))
    with_b = pairs.join(t, "b")
    both = with_b.join(texts.select(F.col("ckey").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, alike double")


def cell_links(sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, group: np.ndarray, alike: np.ndarray, keys: np.ndarray, band: int, threshold: float) -> list[tuple[int, int]]:
    """Links between rows of a cell that are of different groups, and of different sides if there are two.

    A pair that shares an earlier band is left to that band's bucket.
    """
    _, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    size = np.array([len(h) for h, _ in sets])
    at = np.split(at, np.cumsum(size)[:-1])
    weight = np.array([float(w.sum(dtype=np.float64)) for _, w in sets])
    one_side, group, out = bool((side == side[0]).all()), group.copy(), []
    dense = np.zeros(max(int(x.max()) for x in at) + 1)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        least, most = np.minimum(weight[i], weight[j]), np.maximum(weight[i], weight[j])
        may = (group[j] != group[i]) & (abs(alike[j] - alike[i]) <= 1 - threshold + SLACK) & (least >= (threshold - SLACK) * most)
        if not one_side:
            may &= side[j] != side[i]
        j = j[may]
        j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
        if not len(j):
            continue
        dense[at[i]] = sets[i][1]
        common = np.minimum(dense[np.concatenate([at[k] for k in j])], np.concatenate([sets[k][1] for k in j]))
        dense[at[i]] = 0
        both = np.add.reduceat(common, np.cumsum(size[j]) - size[j])
        for k in j[both >= threshold * (weight[i] + weight[j] - both)]:
            out.append((i, int(k)))
            group[group == group[k]] = group[i]
    return out


def compare_cells(met: DataFrame, classes: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) of the pairs that the leaders of buckets left open; met: band, key, ckey, alike (to the leader)."""
    near = 2 * threshold - 1 - SLACK  # only these can be alike to a class that is alike to the leader
    met = met.withColumn("closed", F.col("alike") >= threshold).withColumn("near", (F.col("alike") >= near) & ~F.col("closed"))
    n = met.groupBy("band", "key").agg(*[F.sum(F.expr(e).cast("long")).alias(c) for c, e in (("n_open", "not closed"), ("n_near", "near"), ("n_closed", "closed"))])
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int").alias(b) for c, b in (("n_open", "opens"), ("n_near", "nears"), ("n_closed", "closeds"))]
    rows = met.join(n.filter("n_open > 1 or (n_near > 0 and n_closed > 0)").select("band", "key", *blocks), ["band", "key"])
    # all open rows with each other (kind 0), and the near ones with the closed ones (kind 1)
    mine = "pmod(xxhash64(ckey), {})"
    others = "transform(sequence(0, {} - 1), j -> struct({} as kind, cast({} as int) as lo, cast({} as int) as hi, cast({} as int) as side))"
    pick = lambda k: mine.format(k)
    opens = others.format("opens", 0, f"least({pick('opens')}, j)", f"greatest({pick('opens')}, j)", pick("opens"))
    nears = others.format("closeds", 1, pick("nears"), "j", 0)
    closed = others.format("nears", 1, "j", pick("closeds"), 1)
    cells = F.expr(f"case when closed then if(nears > 0, {closed}, array()) when near and closeds > 0 then concat({opens}, {nears}) else {opens} end")
    dealt = rows.select("band", "key", "ckey", "alike", F.explode(cells).alias("c")).select("band", "key", "ckey", "alike", "c.*")
    whole = dealt.join(classes.select("ckey", "keys"), "ckey").join(texts, "ckey")

    def run(cell: pa.Table) -> pa.Table:
        kind, side = cell.column("kind")[0].as_py(), cell.column("side").to_numpy()
        two_sided = kind == 1 or cell.column("lo")[0] != cell.column("hi")[0]
        out: list = []
        if len(side) > 1 and (not two_sided or side.min() < side.max()):
            sets = [shingles(w, idf.value) for w in word_hashes([normalized(t) for t in cell.column("text").to_pylist()])]
            keys = np.array(cell.column("keys").to_pylist(), np.int64)
            group = np.where(side == 1, -1, np.arange(len(side))) if kind else np.arange(len(side))
            ckey = cell.column("ckey").to_pylist()
            out = [(ckey[i], ckey[j]) for i, j in cell_links(sets, side, group, cell.column("alike").to_numpy(), keys, cell.column("band")[0].as_py(), threshold)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return whole.groupBy("band", "key", "kind", "lo", "hi").applyInArrow(run, "a binary, b binary")


def distinct_classes(signed: DataFrame) -> DataFrame:
    """ckey, least (doc_id), doc and digest (of a row that has the text; the least number for a null doc_id), keys of
    every class with words."""
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "digest")).alias("row")
    found = signed.filter("ckey is not null").groupBy("ckey").agg(F.min("doc_id").alias("least"), row, F.first("keys").alias("keys"))
    return found.select("ckey", "least", "row.doc", "row.digest", "keys")


def links(docs: DataFrame, classes: DataFrame, idf, threshold: float = SIMILARITY) -> DataFrame:
    """Links between classes: a, b."""
    rows = classes.select("ckey", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("ckey").alias("a")).filter("n > 1").drop("n")
    led = materialize(rows.join(shared, ["band", "key"]).filter("ckey <> a"), "led")
    some = led.select("ckey").union(led.select("a")).distinct()
    needed = some.join(classes.select("ckey", "doc", "digest"), "ckey")
    # the digest keeps rows without an id, and texts that share one, apart
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), text_digest(), "text").join(needed, ["doc", "digest"])
    texts = materialize(_one_text(keyed), "texts")
    judged = materialize(verify(led.select("a", F.col("ckey").alias("b")).distinct(), texts, idf), "judged")
    met = materialize(led.join(judged.withColumnRenamed("b", "ckey"), ["a", "ckey"]).select("band", "key", "ckey", "alike"), "met")
    others = materialize(compare_cells(met, classes, texts, idf, threshold), "cell-links")
    return judged.filter(F.col("alike") >= threshold).select("a", "b").union(others).distinct()


def _one_text(keyed: DataFrame) -> DataFrame:
    """ckey, text: repeated rows bring a text again; its key tells it from another of the same digest."""
    schema = pa.schema([("ckey", pa.binary()), ("text", pa.string())])

    def run(batches):
        for rows in small_batches(batches):
            yield rows_to_batch([(k, t) for t, k in rows if class_key(normalized(t)) == k], schema)

    return keyed.select("text", "ckey").mapInArrow(run, "ckey binary, text string").dropDuplicates(["ckey"])


def near_duplicate_groups(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id: the least doc_id of the document's group."""
    docs = id_and_text(docs)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(docs))
    signed = materialize(sign(docs, idf), "signed")
    classes = materialize(distinct_classes(signed), "classes")
    parts = connected_components(links(docs, classes, idf, threshold), "a", "b")
    grouped = materialize(classes.select("ckey", "least").join(parts.withColumnRenamed("node", "ckey"), "ckey", "left").select("ckey", "least", F.coalesce("component", "ckey").alias("component")), "grouped")
    heads = grouped.groupBy("component").agg(F.min("least").alias("class_id"))
    ids = grouped.join(heads, "component").select("ckey", "class_id")
    named = signed.filter("ckey is not null").select("doc_id", "ckey").join(ids, "ckey").select("doc_id", "class_id")
    alone = signed.filter("ckey is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return named.unionByName(alone)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"))
