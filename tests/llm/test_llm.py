"""The training-data operators against brute force, on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import op1_token_output as o1
from graphloom.llm import op2_ppm as o2
from graphloom.llm import op3_token_counts as o3
from graphloom.llm import op4_bpe as o4
from graphloom.llm import op5_media as o5
from graphloom.llm import op6_minhash as o6
from graphloom.llm import op7_decontamination as o7
from graphloom.llm import op8_html as o8
from graphloom.llm import op9_toxicity as o9
from graphloom.llm import op10_quality as o10
from graphloom.llm.bpe import Transducer
from graphloom.llm.labelled import linear
from graphloom.llm.pieces import slices, tokenizer_path

SCHEMA = "doc_id long, text string, score double, n_tokens long, ckey string, host string"
rng = random.Random(7)
WORDS = ["".join(rng.choice(["an", "the", "ti", "on", "er", "é", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(200, 1)
TEXTS = [
    None,
    "",
    "  \n\t ",
    "!!! ???",
    "Hello, it's 42 <|endoftext|> World\x1cx Ünï ΣΑΣ",
    "a",
    BASE,
    BASE,
    BASE.upper(),
    BASE.replace(BASE.split()[100], "zebra", 1),
    prose(300, 2),
    prose(30000, 3),
    "x" * 5000,
    "one two three",
    "one two three",
    "日本語 text ‰ \x00 nul",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, 1, "k", "h") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], (None, "null id", None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def all_rows():
    return [*enumerate(TEXTS), (6, TEXTS[6]), (None, "null id")]


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def key(d):
    return -1 if d is None else d


def test_op1_round_trip(spark, docs, tok):
    got = sorted((r["start"], key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in o1.read_token_files(o1.write_token_files(docs)).collect())
    start, want = 0, []
    for d, t in sorted(all_rows(), key=lambda r: key(r[0])):
        ids = [*ids_of(tok, t), 2]
        want.append((start, key(d), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert o1.read_token_files(o1.write_token_files(docs.limit(0))).count() == 0


def test_op1_words_and_packing_are_cheap(tok):
    """A word is encoded and kept once, however it is ended; packing works in parts, with the same stream over their borders."""
    import tracemalloc

    enc = o1.LibraryEncoder(o1.tokenizer_path())
    texts = ["plain words, plain words.", "Plain WORDS,., plain", "word's a.b 12,3 x1 don't <|endoftext|>, Élan élan, \x00 \x7f, ,. .", "straße, ΑΣ Ⅷ, a\u0301b"]
    assert enc.encode(texts[:1], b"") == [np.array(tok.encode(texts[0], add_special_tokens=False).ids, enc.dtype).tobytes()]
    assert set(enc.chunks) == {"plain", "words", "words,", "words."} and set(enc.pieces) == {",", "."}
    for t in texts:
        assert enc.encode([t], b"") == [np.array(tok.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()]
    ids = np.minimum(np.random.default_rng(1).zipf(1.2, 1_000_003) - 1, 49_000).astype("<u2")
    lengths = o1.limited_lengths(np.bincount(ids, minlength=49_152), 20)
    codes, table = o1.canonical_codes(lengths), o1.decode_table(lengths)
    tracemalloc.start()
    stream, blocks = o1.pack(ids, codes, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and (o1.unpack(stream, blocks, len(ids), table) == ids).all()


def test_op1_code_is_optimal_and_limited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert o1.limited_lengths(counts, 20).tolist() == [0, 9, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    short = o1.limited_lengths(counts, 5)
    assert short.max() == 5
    assert abs(sum(2.0 ** -int(n) for n in short if n) - 1) < 1e-9
    ids = np.random.default_rng(1).choice(np.arange(1, 11), 3000).astype(np.uint32)
    stream, blocks = o1.pack(ids, o1.canonical_codes(short), short.astype(np.int64))
    assert (o1.unpack(stream, blocks, len(ids), o1.decode_table(short)) == ids).all()


def ppm_score(counts, text):
    """Byte by byte with dicts: the longest context seen, then escapes with exclusion."""
    out = 0.0
    for i in range(1, len(text)):
        gone = set()
        for j in range(min(i, o2.ORDER), -1, -1):
            follow = counts.get(text[i - j : i])
            if not follow:
                continue
            left = {b: c for b, c in follow.items() if b not in gone}
            n = sum(left.values())
            if text[i] in left:
                out += math.log10((2 * left[text[i]] - 1) / (2 * n))
                break
            if left:
                out += math.log10(len(left) / (2 * n))
            gone |= follow.keys()
        else:
            out -= math.log10(256 - len(gone))
    return out


def test_op2_brute_force(spark, docs):
    new = [(400 + i, prose(6, 400 + i) + f" Anther{i}SO tionx{i} \x01{i}\xa0é") for i in range(20)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(new, "doc_id long, text string"))
    split = [(d, [*o2.tokens_of(t), o2.END]) for d, t in [*all_rows(), *new]]
    held = {d: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2 for d, _ in split}
    c = collections.Counter(w for d, ws in split if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    counts = collections.defaultdict(collections.Counter)
    for d, ws in split:
        text = b" " + b" ".join(ws)
        for i in range(1, len(text) if not held[d] else 0):
            for j in range(min(i, o2.ORDER) + 1):
                counts[text[i - j : i]][text[i]] += 1
    for hot_words, hot_places in ((3, 200), (10**6, 10**6), (0, 0)):
        got = {key(r["doc_id"]): r for r in o2.score_documents(both, hot_words=hot_words, hot_places=hot_places).collect()}
        assert len(got) == len({d for d, _ in split})
        for d, ws in split:
            r = got[key(d)]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            assert r["score"] == pytest.approx(ppm_score(counts, b" " + b" ".join(ws)))
    assert o2.score_documents(docs.limit(0)).count() == 0
    untrained = o2.score_documents(spark.createDataFrame([(2, "ab c")], "doc_id long, text string"), remainder=zlib.crc32(b"2") % 7).first()
    assert untrained["score"] == pytest.approx(-6 * math.log10(256)) and untrained["train_tokens"] == 0


def test_op2_contexts_are_distributions():
    texts = [o2.spelled(" ".join(WORDS[i : i + 9])) for i in range(0, 200, 9)]
    places, _ = o2.places_of(texts)
    levels = o2.levels_of(places, np.ones(len(places)))
    for context in (b" ", b"tion ", b"zzzzz", b"e the", b"n an "):
        depth = min(len(context), o2.ORDER)
        packed = int.from_bytes(context, "big") << 8 | depth << 48
        assert (10 ** o2.score_places(levels, packed + np.arange(256))).sum() == pytest.approx(1)


def test_op2_table():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 62, 5000))
    table = o2.Table(keys[::2], np.arange(len(keys[::2]), dtype=float))
    values, found = table.get(keys)
    assert found.tolist() == [i % 2 == 0 for i in range(len(keys))] and (values[::2] == np.arange(len(keys[::2]))).all()
    assert not o2.Table(keys[:0], np.zeros(0)).get(keys)[1].any()


def test_op3_and_op4(docs, tok):
    want = {key(d): (t or "", ids_of(tok, t)) for d, t in all_rows()}
    for r in o3.token_counts(docs).collect():
        t, ids = want[key(r["doc_id"])]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(ids), len(ids) > 2048)
    for r in o4.digests(o4.round_trip(docs)).collect():
        _, ids = want[key(r["doc_id"])]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {key(r["doc_id"]): r["text"] for r in o4.decode(o4.encode(docs)).collect()} == {k: tok.decode(i, skip_special_tokens=False) for k, (_, i) in want.items()}
    assert o3.token_counts(docs.limit(0)).count() == 0
    assert o4.digests(o4.round_trip(docs.limit(0))).count() == o4.encode(docs.limit(0)).count() == o4.decode(o4.encode(docs.limit(0))).count() == 0


def test_op4_streams_long_pieces(tok):
    t, r = Transducer(tokenizer_path(), block=16), random.Random(3)
    for alphabet in ("ab", "thea", "aeinrst", "é", "!.-", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(r.choice(alphabet) for _ in range(500))
        assert t.encode(text) == ids_of(tok, text)


def test_op5_payloads(docs):
    got = o5.media_columns(docs).collect()
    assert len(got) == len(TEXTS) + 2
    want = {key(d): o5.payload_of(t) for d, t in all_rows()}
    for r in got:
        p = want[key(r["doc_id"])]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["width"] * r["height"] == len(p)
        assert r["feature"] == o5.feature_of(64, len(p) // 64, p) and r["media_bytes"] > 0
    assert o5.from_png(o5.to_png(b"\1" * 128)) == b"\1" * 128
    assert o5.media_columns(docs.limit(0)).count() == 0


def test_op5_metadata_reads_headers_only(docs):
    """Members whose bytes behind the header are lost still give their metadata, and fail when they are read whole."""
    located = o5.places(o5.write_shards(docs))
    want = sorted((r["digest"], r["width"], r["height"]) for r in o5.read_metadata(located).collect())
    for shard in {r["shard"] for r in located.collect()}:
        fs, path = o5.filesystem(shard)
        data = bytearray(fs.open_input_file(path).read())
        for r in located.filter(F.col("shard") == shard).collect():
            data[r["at"] + 29 : r["at"] + r["size"]] = b"\0" * (r["size"] - 29)
        with fs.open_output_stream(path) as f:
            f.write(bytes(data))
    assert sorted((r["digest"], r["width"], r["height"]) for r in o5.read_metadata(located).collect()) == want and len(want) == len({o5.payload_of(t) for t in TEXTS}) + 1
    with pytest.raises(Exception):
        o5.read_media(o5.read_metadata(located)).collect()


def test_op6_brute_force(spark, docs):
    extra = [(100 + i, re.sub(r"\S+$", f"tail{i}", BASE)) for i in range(40)] + [(200 + i, prose(60, 50) + " " + prose(90, 60 + i)) for i in range(30)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {key(r["doc_id"]): r["class_id"] for r in o6.near_duplicate_groups(both).collect()}

    def grams(t):
        w = o7.words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(key(d), grams(t)) for d, t in [*all_rows(), *extra]]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            j = len(x & y) / len(x | y) if x and y else 0
            if j > 0.82 and -1 not in (a, b):
                assert got[a] == got[b]
            if j < 0.5 and a != b and -1 not in (a, b):
                assert got[a] != got[b]
    assert (got[0], got[3], got[-1]) == (0, 3, None)
    assert o6.near_duplicate_groups(docs.limit(0)).count() == 0


def test_op6_star_group(spark):
    """Copies like the original, unlike each other: all are one group; the bridge of two stars joins them."""
    words = [f"w{i}" for i in range(1000)]
    docs, r = [(0, " ".join(words))], random.Random(5)
    for i in range(1, 301):
        copy = list(words)
        for at in r.sample(range(1000), 18):
            copy[at] = f"x{i}y{at}"
        docs.append((i, " ".join(copy)))
    idf = np.ones(o6.IDF_BUCKETS, np.float32)
    sets = [o6.shingles(w, idf) for w in o6.word_hashes([o6.normalized(t) for _, t in docs])]
    assert min(o6.similarity(sets[0], s) for s in sets[1:]) > 0.82
    assert np.mean([o6.similarity(sets[i], sets[i + 1]) < 0.8 for i in range(1, 300)]) > 0.99
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["class_id"] for r in o6.near_duplicate_groups(table).collect()} == {0}


def test_op6_drifting_chains_equal_brute_force(spark):
    """Chains of texts, each like the next: the groups are the components of all pairs, by the operator's own weights."""
    r, rows = random.Random(11), []
    for c in range(40):
        words = [r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(120)]
        for _ in range(12):
            rows.append((len(rows) if len(rows) % 7 else None, " ".join(words)))
            for at in r.sample(range(120), 2):
                words[at] = f"d{r.randint(0, 10**9)}"
    table = spark.createDataFrame([*rows, *rows[:30]], "doc_id long, text string").repartition(4)
    idf = o6.idf_table(table)
    sets = [o6.shingles(w, idf) for w in o6.word_hashes([o6.normalized(t) for _, t in rows])]
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if o6.similarity(sets[a], sets[b]) >= 0.8]
    for a, b in pairs:
        part[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    got = {r["doc_id"]: r["class_id"] for r in o6.near_duplicate_groups(table).collect() if r["doc_id"] is not None}
    assert len(pairs) > 400 and len({top(i) for i in part}) < len(rows)
    assert got == {d: least[top(i)] for i, (d, _) in enumerate(rows) if d is not None}


def test_op6_cells_equal_all_pairs():
    r, n = np.random.default_rng(4), 60
    base = r.integers(1, 1 << 60, (4, 50)).astype(np.uint64)
    sets = []
    for i in range(n):
        h = np.unique(np.r_[r.permutation(base[i % 4])[: r.integers(46, 51)], r.integers(1, 1 << 60, 1).astype(np.uint64)])
        sets.append((h, r.uniform(0.9, 1.1, len(h)).astype(np.float32)))
    alike = np.array([o6.similarity(sets[0], s) for s in sets])
    side = r.integers(0, 2, n)

    def parts(pairs):
        g = list(range(n))
        for a, b in pairs:
            g = [g[a] if x == g[b] else x for x in g]
        return {tuple(i for i in range(n) if g[i] == x) for x in g}

    for sides in (side, np.zeros(n, int)):
        got = o6.cell_links(sets, sides, np.arange(n), alike, np.zeros((n, o6.BANDS), np.int64), 0, 0.8)
        want = [(i, j) for i in range(n) for j in range(i) if o6.similarity(sets[i], sets[j]) >= 0.8 and (sides is not side or side[i] != side[j])]
        assert parts(got) == parts(want) and len(want) > 50


def test_op7_brute_force(spark, docs):
    w = TEXTS[10].split()
    items = [(1, " ".join(w[20:50])), (2, " ".join(w[60:73])), (3, "One, two!"), (4, None), (5, "..."), (6, " ".join(w[20:50])), (None, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {key(r["doc_id"]): r for r in o7.contamination(docs, bench).collect()}
    patterns = collections.defaultdict(set)
    for i, t in items:
        ws = o7.words_of(t)
        for s in range(len(ws) - min(13, len(ws)) + 1 if ws and i is not None else 0):
            patterns[tuple(ws[s : s + 13])].add(str(i))
    for d, t in all_rows():
        ws, hit, ids = o7.words_of(t), set(), set()
        for p, who in patterns.items():
            for s in range(len(ws) - len(p) + 1):
                if tuple(ws[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    ids |= who
        r = got[key(d)]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(ws), len(hit), len(ids), bool(hit) and 20 * len(hit) >= len(ws))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert o7.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert o7.contamination(docs.limit(0), bench).count() == 0
    many = {key(r["doc_id"]): r.asDict() for r in o7.find_occurrences(docs, bench, pack_bytes=30).collect()}
    one = {key(r["doc_id"]): r.asDict() for r in o7.find_occurrences(docs, bench).collect()}
    assert many == one and len(o7.write_packs(bench, 30)) > o7.KEPT


def test_op7_tables_against_naive_search():
    """Few words, so that blocks, tails and patterns repeat a lot."""
    r = random.Random(8)
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.choice((3, 13, 14, 30))))) for i in range(60)]
    items += [("x", "a " * 20), ("y", "a " * 13), ("z", "")]
    search = o7.Searcher(items, 6)
    for _ in range(30):
        text = " ".join(r.choice("abc") for _ in range(r.randint(0, 120))) + " a" * r.randint(0, 9)
        words = text.encode().split()
        got = {(a, b): ids for a, b, ids in search.spans(words, o7.word_hashes([text.encode()])[0])}
        want = collections.defaultdict(set)
        for i, t in items:
            p = t.encode().split()
            m = min(6, len(p))
            for s in range(len(p) - m + 1 if m else 0):
                for at in range(len(words) - m + 1):
                    if words[at : at + m] == p[s : s + m]:
                        want[at, at + m].add(i)
        assert got == want


PAGE = (
    '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div>'
    "<article><h1>Tom &amp; &eacute;</h1><p><b>One<br><p>two \n three</p><aside>side</aside><form>f</form><div id='comments'>c</div></article><footer>x</footer>"
)


def test_op8_pages(spark):
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "http://a.b/3", ""), (None, "x", PAGE), (1, "http://a.b/1", PAGE)]
    got = sorted((key(r["page_id"]), r["text"]) for r in o8.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    text = "Tom & é\nOne\ntwo three"
    assert got == [(-1, text), (1, text), (1, text), (2, ""), (3, "")]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="page has-sidebar"><article>a</article></div>', "a"),
        ('<div class="platform-form"><article>a</article></div>', "a"),
        ('<div class="comments"><article>reader</article></div>', "reader"),
        ('<article>a</article><div class="comments"><article>reader</article></div>', "a"),
        ('<article>a</article><article class="comment">reader</article>', "a"),
        ('<main><p>a</p><div id="post-comments"><article>reader</article></div></main>', "a"),
        ('<article><div class="entry-header"><h1>t</h1></div><p>a</p></article>', "t\na"),
        ('<div class="entry-header"><h1>t</h1></div><div>a</div>', "t\na"),
        ('<article><p class="comment-free">a</p><section class="related-work">b</section><label>c</label></article>', "a\nb\nc"),
        ('<article><p>a</p><div class="related-posts">x</div><div class="ad-slot">y</div><ul id="commentList"><li>z</ul></article>', "a"),
        ('<div class="siteHeader">x</div><div class="cookie-notice-wrapper">y</div><p>a</p>', "a"),
        ('<div role="banner">x</div><article role="main">a</article>', "a"),
        ('<aside><article>x</article></aside><p>a</p>', "a"),
    ],
)
def test_op8_roles(page, text):
    assert o8.extract_group([page]) == [text]


def test_op8_array_decides():
    """Blocks that structure leaves open: all repeated ones go, none of the pages' own is lost."""
    r, host = random.Random(6), []
    shared = [" ".join(f"s{k}w{i}" for i in range(r.randint(16, 60))) for k in range(12)]
    for i in range(80):
        own = [" ".join(f"p{i}b{k}w{j}" for j in range(r.randint(1, 90))) for k in range(4)]
        blocks = [(t, False) for t in own] + [(t, True) for t in r.sample(shared, 4)]
        r.shuffle(blocks)
        host.append(blocks)
    pages = ["".join(f"<div>{t}</div>" for t, _ in blocks) for blocks in host]
    assert o8.extract_group(pages) == ["\n".join(t for t, again in blocks if not again) for blocks in host]
    assert o8.extract_group(pages[:1]) == ["\n".join(t for t, _ in host[0])]  # one page: structure alone keeps all


def test_op8_suffix_array():
    r = np.random.default_rng(2)
    streams = [r.integers(0, 4, n) for n in (120, 90, 0, 200)]
    shared = r.integers(0, 50, 40)
    streams[0][30:70], streams[3][100:140] = shared, shared
    marks = o8.repeated(streams)
    runs = [{tuple(s[i : i + 16]) for i in range(len(s) - 15)} for s in streams]
    for k, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 15):
            if any(tuple(s[i : i + 16]) in runs[j] for j in range(len(streams)) if j != k):
                want[i : i + 16] = True
        assert (marks[k] == want).all()
    boiler = " ".join(f"b{i}" for i in range(20))
    pages = [f"<div>{boiler}</div><div>page {i} says w{i} x{i}</div>" for i in range(3)]
    assert o8.extract_group(pages) == [f"page {i} says w{i} x{i}" for i in range(3)]


def test_op8_awkward_tables(spark):
    """Clashing columns, a very long page, broken markup, repeated rows, an empty table."""
    long = "<article>" + "".join(f"<p>word{i} &amp; {'x' * (i % 50)}</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "http://h/1", long, "t", "h", [1], 7), (2, "http://h/2", "<div><p>a<b>b</i></p><article", "t", "h", None, None), (3, "//h", "a < b <!-- x", None, None, None, None), (3, "//h", "a < b <!-- x", None, None, None, None), (None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, runs array<long>, rid long")
    got = sorted(((key(r["page_id"]), r["text"]) for r in o8.extract(table).collect()), key=lambda r: r[0])
    assert got[1][1].split("\n") == [f"word{i} & {'x' * (i % 50)}".strip() for i in range(60_000)]
    assert [t for _, t in got[3:]] == ["a < b"] * 2 and got[0] == (-1, "") and got[2][1].startswith("ab")
    assert o8.extract(table.limit(0)).columns == ["page_id", "url", "text"] and o8.extract(table.limit(0)).count() == 0


def test_op8_text_outside_articles():
    notice = " ".join(f"n{i}" for i in range(20))
    teaser = "<div>{}</div><div><p>main text {}</p></div><aside><article>teaser</article></aside>"
    pages = [teaser.format(notice, i) for i in range(2)] + [f"<div>{notice}</div><p>unique lead</p><article>story</article>"]
    assert o8.extract_group(pages) == ["main text 0", "main text 1", "unique lead\nstory"]


def test_op8_large_host_equals_memory(spark):
    """Pages of one host of over 8 MB: runs are found over all of them, as by the suffix array of the whole host."""
    r, filler = random.Random(9), "<!--" + "x" * 150_000 + "-->"
    notices = [" ".join(f"n{k}w{i}" for i in range(25)) for k in range(30)]
    pages = []
    for i in range(60):  # every notice stands on two pages
        blocks = [f"<div>{notices[i % 30]}</div>", f"<div>own {i} text {r.random()}</div>", "<nav>menu</nav>"]
        r.shuffle(blocks)
        pages.append(f"{filler}{''.join(blocks)}" + ("<article>story é</article>" if i % 4 == 0 else ""))
    pages[7] += f"<p>{prose(40, 8)}</p>"
    pages += [pages[7], None]
    table = spark.createDataFrame([(i, f"http://big.host/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    other = spark.createDataFrame([(900, "http://other.host/", pages[1])], table.schema)
    got = {r["page_id"]: r["text"] for r in o8.extract(table.union(other)).collect()}
    assert [got[i] for i in range(len(pages))] == o8.extract_group(pages)
    assert not any("n7w3" in got[i] for i in range(60)) and "n1w3" in got[900]


def test_scores_depend_on_the_text_alone():
    """Every text has the same score to the last bit by itself, among others, and after other texts."""
    texts = [prose(40, 3000 + i) + " vilifier sludgy " * (i % 3 == 0) + prose(30 + 40 * (i % 5), i) for i in range(90)] + ["once", "", prose(3000, 5)]
    sample = [(t, int(i % 3 == 0)) for i, t in enumerate(texts[:90])]
    net = o9.train(sample, 0.3, steps=40)
    together = o9.Scorer(net).score(texts)
    assert len(set(together)) > 60
    for size in (1, 2, 3, 7, 40):
        for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
            scorer, got = o9.Scorer(net), {}
            for k in range(0, len(texts), size):
                part = list(order)[k : k + size]
                got.update(zip(part, scorer.score([texts[i] for i in part])))
            assert [got[i] for i in range(len(texts))] == together
    x, w = np.random.default_rng(1).standard_normal((500, 3)), np.array([0.3, -1.7, 2.9, 0.1])
    assert all((linear(x[a : a + n], w) == linear(x, w)[a : a + n]).all() for a, n in ((0, 1), (3, 2), (17, 5), (499, 1)))


def test_op9_and_op10_learn_and_hold_out(spark):
    rows, labels = [], []
    for i in range(600):
        toxic, bad = i % 4 == 0, i % 3 == 0
        w = prose(60, 1000 + i).split()
        if toxic:
            w[10:10] = ["vilifier", "sludgy"]
        rows.append((i, ("%%% ".join(w) + "%%%") if bad else " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (9000, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for f, col in ((o9.toxicity, 2), (o10.quality, 1)):
        got = f(docs, labelled).collect()
        assert len(got) == 602
        held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
        assert np.mean([r["predicted"] == labels[r["doc_id"]][col] for r in held]) > 0.9
        assert f(docs.limit(0), labelled).count() == 0
        assert f(docs, labelled.limit(0)).count() == 602


def test_op9_and_op10_awkward_rows(spark):
    """Clashing columns, repeated rows and ids, long texts, labels that repeat or contradict each other."""
    from graphloom.llm.labelled import labelled_sample

    rows = []
    for i in range(150):
        w = prose(40, 2000 + i).split()
        rows.append((i, " ".join(w[:20] + ["vilifier", "sludgy"] * (i % 3 == 0) + w[20:]) if i % 2 else "%%% ".join(w), 1.0, "s", 0, True))
    long = (7777, prose(60_000, 9), None, None, None, None)
    schema = "doc_id long, text string, score double, y string, predicted int, held_out boolean"
    docs = spark.createDataFrame([*rows, rows[3], (3, "another text of that id", None, None, None, None), long, (None, None, None, None, None, None)], schema).repartition(3)
    labels = [(i, i % 2, int(i % 3 == 0 and i % 2), "x") for i in range(150)] + [(4, 0, 0, "x"), (4, 1, 1, "x"), (None, 1, 1, "x"), (8, None, None, "x"), (99_999, 1, 1, "x")]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").repartition(3)
    for f, args in ((o9.toxicity, ["doc_id", "held_out", "score", "predicted"]), (o10.quality, ["doc_id", "held_out", "score", "predicted"])):
        got = f(docs, labelled)
        assert got.columns == args
        got = got.collect()
        assert len(got) == 154 and all(0 <= r["score"] <= 1 for r in got)
        assert sorted((key(r["doc_id"]), r["score"]) for r in got) == sorted((key(r["doc_id"]), r["score"]) for r in f(docs.repartition(5), labelled).collect())
    sample, share = labelled_sample(docs, labelled, "quality", 1000)
    texts = dict((i, t) for i, t, *_ in rows)
    texts[3] = min(texts[3], "another text of that id")
    taught = [i for i in range(150) if i != 4 and zlib.crc32(str(i).encode()) % 5]
    assert sorted(sample) == sorted((texts[i], i % 2) for i in taught) and share == pytest.approx(np.mean([i % 2 for i in taught]))
    assert len(labelled_sample(docs, labelled, "quality", 7)[0]) == 14
    assert sum(len(t.encode()) for t, y in labelled_sample(docs, labelled, "quality", 1000, sample_bytes=3000)[0] if y) <= 3000


def test_op9_sees_passages_anywhere():
    """Every passage of up to 49 words lies whole in a window, wherever it stands, and all words are read."""
    for n in (1, 63, 64, 65, 100, 500, 777):
        starts = o9.windows_of(n)
        assert starts[0] == 0 and starts[-1] + o9.WINDOW >= n
        for at in range(max(1, n - 49 + 1)):
            assert any(s <= at and min(n, at + 49) <= s + o9.WINDOW for s in starts)


def test_op9_does_not_depend_on_the_hash_seed():
    import os
    import subprocess
    import sys

    code = "import sys; sys.path.insert(0, '.')\nfrom graphloom.llm import op9_toxicity as o\nt = [(f'w{i} w{i % 7} ' * 9 + ('bad' if i % 3 else 'fine'), i % 2) for i in range(60)]\nprint(o.Scorer(o.train(t, steps=4)).score(['w1 bad w3 w5']))"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed}, cwd=root, capture_output=True, text=True, check=True).stdout for seed in "123"}
    assert len(said) == 1


def test_op9_gradients():
    net = o9.Network({b"a": 1})
    r = np.random.default_rng(1)
    x, at = r.standard_normal((6, 2 * o9.DIM)).astype(np.float32), r.integers(0, 6, (3, 5))
    real, y = np.ones((3, 5), bool), np.array([1, 0, 1], np.float32)

    def loss():
        z = net.logits(net.gates(x), at, real).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, _ = net.gradients(x, at, real, y)
    for name in ("Wf", "Ub", "A", "a", "v", "bf"):
        p = net.p[name].reshape(-1)
        p[0] += 1e-2
        up = loss()
        p[0] -= 2e-2
        assert (up - loss()) / 2e-2 == pytest.approx(float(g[name].reshape(-1)[0]), rel=0.05, abs=2e-4)
        p[0] += 1e-2


def test_pipeline_against_operators(spark, tok):
    """Every stage keeps what its operator doesn't reject of what the stage before it kept, and the last encodes that."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rejects = {
        "toxicity": lambda d: o9.toxicity(d, labels).filter("predicted = 1"),
        "quality": lambda d: o10.quality(d, labels).filter("predicted = 0"),
        "near_duplicates": lambda d: o6.near_duplicate_groups(d).filter("doc_id <> class_id"),
        "decontamination": lambda d: o7.contamination(d, bench).filter("contaminated"),
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*rejects, "encoding"]
    now, lost = docs, 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        bad = {r["doc_id"] for r in rejects[name](now).collect()}
        kept = stage(spark, now, sf)
        assert kept.columns == docs.columns
        want = [tuple(r) for r in now.collect() if r["doc_id"] not in bad]
        assert sorted(map(tuple, kept.collect())) == sorted(want)
        lost += len(bad)
        now = spark.createDataFrame(want, docs.schema)
    assert lost
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(got) == now.count()
    for r in now.collect():
        ids = ids_of(tok, r["text"])
        assert got[r["doc_id"]]["ids"] == ids and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tokenizer_equality_on_odd_strings(tok):
    """Letters that change in lower case or by composition, marks, white space of all kinds, other scripts."""
    r = random.Random(12)
    span = lambda a, b: "".join(map(chr, range(a, b)))
    alphabets = ["İIıŞş i\u0307", "eo\u0308a\u030aé", "ΣσςΑ ", "".join(chr(c) for c in (0x1C4, 0x1C5, 0x1E9E, 0x212A, 0x212B, 0x17F)), span(32, 0x250), span(0x250, 0x600), span(0x1E00, 0x2100), "\t\n\x1c\x85\xa0\u2002\u3000 ab1²Ⅷ", span(0x3040, 0x30FF), "<|endoftext|> <|ENDOFTEXT|>'s'LL"]
    texts = ["İstanbul", *("".join(r.choice(a) if r.random() < 0.8 else r.choice("abc .,") for _ in range(r.randint(1, 20))) for a in alphabets for _ in range(300))]
    lib, codec, counter = o1.LibraryEncoder(tokenizer_path()), o4.Codec(tokenizer_path()), o3.TokenCounter(tokenizer_path())
    for text, found in zip(texts, lib.encode(texts, b"")):
        want = ids_of(tok, text)
        assert np.frombuffer(found, "<u2").tolist() == want
        assert [i for part in codec.encode(text) for i in part.tolist()] == want
        assert counter.count(text) == len(want)


def test_slices_and_streams(tok):
    """Texts cut into slices, ids fed to the decoding machine in any slices, ids given out before the text ends."""
    text = prose(3000, 77) + " " + "thea" * 400
    t, codec = Transducer(tokenizer_path()), o4.Codec(tokenizer_path())
    assert [i for part in slices(text, 50) for i in t.encode(part)] == ids_of(tok, text)
    ids = np.array(ids_of(tok, text), np.int32)
    assert codec.decode(np.split(ids, [1, 2, 500, 501])) == tok.decode(ids.tolist(), skip_special_tokens=False)
    taken = []

    def symbols():
        for i in range(1000):
            taken.append(i)
            yield t.table.first[97 + i % 5]

    next(t.table.stream(symbols(), t.widths))
    assert len(taken) <= 64 + t.table.lookahead
