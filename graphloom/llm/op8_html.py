"""Main text of HTML pages: structure first, and a host's repeated runs for what structure leaves open.

A page is parted into blocks.  Blocks of menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are named by their elements and roles, and by classes and ids that name the element's own role; blocks inside an
article (or main) element are its text, and are never dropped for being repeated.  Everything that is not inside an article joins the token stream of its host: runs
of 16 tokens that distinct pages of the host share are marked, and the blocks that such runs cover go, the unique ones
stay, whether the page has an article or not.  ``extract_group`` does so for pages in memory, by the suffix array of
their stream (by doubling, up to the length looked for).

Plan: over tables a run is a 64-bit hash of its host and tokens.  Of every run the least and the greatest hash of a page
that has it are aggregated (map-side first), which differ where distinct pages share it; the runs of blocks that
structure leaves open meet these.  So a host may hold any share of the pages and its pages get the same texts at any
size.

Cases: null or empty html: empty text.  Null url: the empty host.  Null page_id and repeated rows: kept; equal pages
count as one when repeats are sought.  Empty table: no rows.  Very long pages: whole.  Unclosed elements end with
their parents.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, rows_to_batch, small_batches
from .op6_minhash import _mix, word_hashes

RUN = 16

#: Element and attribute names by their role in a page (fixed values of the markup language and of common usage).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav footer aside form head title button select option optgroup menu dialog iframe object canvas audio video input datalist".split())
RAW = "script|style|template|noscript|textarea|svg|xmp"
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "discussion footer form header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination popup promo "
    "promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "taboola toolbar topbar widget".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Names that may as well stand for a part of the article when they are inside it, or behind a word for it.
HEADS = frozenset("banner disclaimer discussion form header masthead".split())
OF_ARTICLE = frozenset("article chapter content entry page post section story title".split())
#: Words behind a name that only say that the element holds it, and words before one that speak of the page's state.
HOLDERS = frozenset(
    "area articles bar block body box button buttons container content group holder icons inner item items link links list media outer panel posts "
    "row section slot stories thread unit wrap wrapper".split()
)
STATES = frozenset("can enable has hide is js no not show with without".split())

_PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")

#: How a block was found to be boilerplate: not at all, by a class or id, by an element or role, or in an article below a
#: class or id that says so.
TEXT, NAMED, CERTAIN, BELOW_NAMED = range(4)


def _says_boiler(name: str, in_article: bool) -> bool:
    """Whether a class or id names boilerplate as the element's own role: ``site-footer`` does, ``has-footer`` doesn't."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    if not parts or parts[-1] not in BOILER_NAMES or parts[0] in STATES:
        return False
    return not (parts[-1] in HEADS and (in_article or OF_ARTICLE.intersection(parts[:-1])))


def _boiler(tag: str, attributes: str, in_article: bool) -> int:
    if tag in DROPPED or (tag == "header" and not in_article):
        return CERTAIN
    if "=" not in attributes or tag in ("body", "html", "main"):
        return TEXT
    found = TEXT
    for key, a, b, c in _NAMES.findall(attributes):
        names = (a or b or c).split()
        if key.lower() == "role":
            if BOILER_ROLES.intersection(n.lower() for n in names) and tag != "article":
                return CERTAIN
        elif any(_says_boiler(n, in_article) for n in names):
            found = NAMED
    return found


def blocks_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, boilerplate by structure) of every block in page order.

    A class or id never takes an article away that stands below it, unless the page has an article elsewhere.
    """
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, inside an article, how it is boilerplate
    held: list[str] = []
    article, state = False, TEXT

    def flush():
        text = " ".join(htmllib.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, article, state))

    def pop_to(i: int):
        nonlocal article, state
        del stack[i:]
        article, state = (stack[-1][1], stack[-1][2]) if stack else (False, TEXT)

    for m in _PIECE.finditer(page or ""):
        tag = m.group(3)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                held.append(piece)
            elif m.group(1):
                held.append(" ")
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag in BLOCK:
            flush()
        elif tag in VOID:
            held.append(" " if tag in ("br", "wbr") else "")
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and stack[i][2] != (stack[i - 1][2] if i else TEXT):
                        flush()
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break  # an inline end tag can't end a block
            continue
        if tag in BLOCK and stack:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        is_article = tag in ("article", "main")
        own = _boiler(tag, m.group(4), article)
        now = own if state in (TEXT, BELOW_NAMED) and own else state
        if is_article and own == TEXT and state == NAMED:
            now = BELOW_NAMED
        if tag not in BLOCK and now != state:
            flush()
        stack.append((tag, article or is_article, now))
        article, state = stack[-1][1:]
    flush()
    elsewhere = any(inside and how == TEXT for _, inside, how in out)
    return [(text, inside, how in (NAMED, CERTAIN) or (how == BELOW_NAMED and elsewhere)) for text, inside, how in out]


def repeated(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For every stream, which tokens lie in a run of ``run`` tokens that another stream has too.

    Ranks of 1, 2, 4, ... tokens by doubling are the suffix array's order up to that length; suffixes of one rank
    share so many tokens.
    """
    sizes = [len(s) for s in streams]
    page = np.repeat(np.arange(len(streams)), np.array(sizes, np.int64) + 1)
    top = max([int(s.max()) for s in streams if len(s)], default=0) + 1
    rank = np.concatenate([np.r_[s, top + i] for i, s in enumerate(streams)]).astype(np.int64)
    length = 1
    while length < run:
        step = min(length, run - length)
        after = np.full(len(rank), -1)  # behind a page's end
        if len(rank) > step:
            after[:-step] = np.where(page[step:] == page[:-step], rank[step:], -1)
        _, rank = np.unique(rank * (int(rank.max()) + 2) + after + 1, return_inverse=True)
        length += step
    n = len(rank)
    end = np.cumsum(np.array(sizes, np.int64) + 1) - 1
    whole = np.arange(n) + run <= end[page]
    least, most = np.full(n, len(streams)), np.full(n, -1)
    np.minimum.at(least, rank[whole], page[whole])
    np.maximum.at(most, rank[whole], page[whole])
    starts = np.flatnonzero(whole & (least[rank] < most[rank]))
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    covered = np.cumsum(cover)[:n] > 0
    return [covered[e - s : e] for s, e in zip(sizes, end)]


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    parsed = [blocks_of(p) for p in pages]
    words: dict[str, int] = {}
    streams, seen = [], {}
    for page, blocks in zip(pages, parsed):
        if page in seen:
            streams.append(np.zeros(0, np.int64))
            continue
        seen[page] = len(streams)
        streams.append(np.array([words.setdefault(w, len(words)) for text, inside, _ in blocks if not inside for w in text.split()], np.int64))
    marks = repeated(streams) if streams else []
    out = []
    for page, blocks in zip(pages, parsed):
        mark, at, kept = marks[seen[page]], 0, []
        for text, inside, boiler in blocks:
            covered = False
            if not inside:
                n = text.count(" ") + 1
                covered = bool(mark[at : at + n].all())
                at += n
            if not boiler and (inside or not covered):
                kept.append(text)
        out.append("\n".join(kept))
    return out


def run_hashes(host: str, stream: str, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the host and of every run of ``run`` tokens of the stream."""
    # other white space than the space parts no words here, as text of a block has none
    (words,) = word_hashes([stream.encode("utf-8", "surrogatepass")])
    n = len(words) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.full(n, int.from_bytes(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"), np.uint64)
    power = np.uint64(1)
    for j in range(run):
        power *= np.uint64(0x9E3779B97F4A7C15)
        h += words[j : j + n] * power
    return _mix(h).view(np.int64)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[^/:?#]+:)?//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    run_schema = pa.schema([("run", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])
    block = pa.struct([("text", pa.string()), ("inside", pa.bool_())])
    page_schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("blocks", pa.list_(block)), ("runs", pa.list_(pa.int64()))])

    def stream_of(blocks):
        return " ".join(text for text, inside, _ in blocks if not inside)

    def count(batches):
        for part in small_batches(batches):
            runs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for h, page in part:
                runs.append(run_hashes(h, stream_of(blocks_of(page))))
                key = hashlib.blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=8).digest()
                keys.append(np.full(len(runs[-1]), int.from_bytes(key, "little", signed=True)))
            runs, back = np.unique(np.concatenate(runs), return_inverse=True)
            keys, least = np.concatenate(keys), np.full(len(runs), np.iinfo(np.int64).max)
            most = np.full(len(runs), np.iinfo(np.int64).min)
            np.minimum.at(least, back, keys)
            np.maximum.at(most, back, keys)
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(least), pa.array(most)], schema=run_schema)

    def structure(batches):
        """The text, or the blocks and the stream's runs where repeats have a say."""
        for part in small_batches(batches):
            out = []
            for page_id, url, h, page in part:
                blocks = blocks_of(page)
                open_ = [not inside and not boiler for _, inside, boiler in blocks]
                runs = run_hashes(h, stream_of(blocks)) if any(open_) else []
                if len(runs):
                    # boilerplate keeps its place in the stream; inside is null for it
                    kept = [{"text": text, "inside": None if boiler and not inside else inside} for text, inside, boiler in blocks if not (boiler and inside)]
                    out.append((page_id, url, None, kept, runs.tolist()))
                else:
                    out.append((page_id, url, "\n".join(text for text, _, boiler in blocks if not boiler), None, None))
            yield rows_to_batch(out, page_schema)

    def finish(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
        for part in small_batches(batches):
            out = []
            for page_id, url, blocks, runs, hit in part:
                starts = np.flatnonzero(np.isin(np.array(runs, np.int64), np.array(hit or [], np.int64)))
                cover = np.zeros(len(runs) + RUN, np.int64)  # as many as tokens, and one
                cover[starts] += 1
                cover[starts + RUN] -= 1
                mark, at, kept = np.cumsum(cover)[:-1] > 0, 0, []
                for b in blocks:
                    covered = False
                    if not b["inside"]:
                        n = b["text"].count(" ") + 1
                        covered = bool(mark[at : at + n].all())
                        at += n
                    if b["inside"] is not None and not covered:
                        kept.append(b["text"])
                out.append((page_id, url, "\n".join(kept)))
            yield rows_to_batch(out, schema)

    parsed = rows.mapInArrow(structure, "page_id long, url string, text string, blocks array<struct<text: string, inside: boolean>>, runs array<long>")
    parsed = materialize(parsed.withColumn("rid", F.monotonically_increasing_id()), "pages")
    asking = parsed.filter("runs is not null")
    settled = parsed.filter("runs is null").select("page_id", "url", "text")
    if asking.isEmpty():
        return settled
    counted = rows.select("host", "html").mapInArrow(count, "run long, least long, most long")
    shared = counted.groupBy("run").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("run")
    met = asking.select("rid", F.explode(F.array_distinct("runs")).alias("run")).join(shared, "run")
    hits = met.groupBy("rid").agg(F.collect_list("run").alias("hit"))
    judged = asking.join(hits, "rid", "left").select("page_id", "url", "blocks", "runs", "hit")
    return settled.unionByName(judged.mapInArrow(finish, "page_id long, url string, text string"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
