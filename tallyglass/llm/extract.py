"""Operator 4: main text of web pages by a suffix array per host.

A page becomes blocks of text, each inside the article (an article or main element), outside it, or marked out: menus,
page headers and footers, sidebars, notices, adverts, forms, comments and hidden parts by element, role, class or id.  The
token streams of a host's pages are concatenated and their suffixes sorted (prefix doubling, to the depth of ``RUN`` tokens, which
decides what repeats); runs of RUN tokens or more that stand on several distinct pages cover boilerplate:

* outside the article a block goes when it is marked out, when at least half of it is covered by runs found on two pages and
  a tenth of the host's pages, ``OUTSIDE_PAGES`` at most, or when the page has an article, unless more than ``TEASER`` times the
  words of its articles stand outside of them and do not repeat: then the articles are teasers, and all of it is kept;
* inside the article a block goes when at least ``COVERED`` of it is covered by runs found on ``TEMPLATE_PAGES`` pages and
  ``TEMPLATE_SHARE`` of the host's pages.  Passages that articles merely share stay.

Names mark out by whole parts ("site-header", "comment-list"); one that begins with such a part and goes on with other words ("share-price",
"notice-of-motion") is only suspect: its blocks go where most of their text is links or where they repeat like blocks outside.

Where repetition would take more than half of what the page would keep otherwise, only blocks covered by runs on
``TEMPLATE_PAGES`` pages go, and none where nothing would be left: such a page is a copy, not a template.

Character references are decoded, white space in a block becomes one blank, blocks are joined by an empty line.  Null or
empty pages have an empty text, pages without a url are one host.  Repeated rows are separate pages.  Other columns are
ignored.

Scale.  Pages travel once, as compressed streams.  A host of more than ``SHARD`` characters is cut into shards by a hash of
the page, each sorted on its own; the pages of each run are summed over the shards of the host by a shuffle, so no host needs
one task and the result does not depend on the shards.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import q
from ..functions.store import materialise
from .arrays import SPACE, U, lean, runs, shingles, texts, word_hashes, words

RUN, COVERED, TEMPLATE_PAGES, TEMPLATE_SHARE = 8, 0.8, 8, 0.9
TEASER = 2  # times the words of the articles
OUTSIDE_SHARE, OUTSIDE_PAGES = 0.1, 5
HASH_BITS = 44  # of a run, where shards are summed
SHARD = 8_000_000
BROADCAST_HOSTS = 500_000
ARTICLE, OUTSIDE, MARKED = "a", "o", "m"

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "xmp"}
CLOSE = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
            "hr html legend li main menu nav ol option optgroup p pre section select summary table tbody tfoot thead tr ul".split())
#: Elements whose end closes what is still open inside; the rest is followed only while it is marked out.
HOLDS = set("article aside body center details dialog div dl fieldset figure footer form head header main menu nav ol section select table template ul svg math object "
            "button canvas video audio map".split())
OUT = set("aside button canvas dialog footer form head header menu nav select svg math object template video audio map fieldset datalist".split())
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
# Parts of class and id names.  A name marks its element out if a part of NAMES stands alone or last, or first before parts of FRAMES only.
NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
            "sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments commentlist respond disqus share sharing social "
            "related recommended newsletter subscribe subscription signup login search toolbar pagination pager widget copyright skip hidden".split())
FRAMES = set("area article articles bar block body bottom box button buttons card cards close col column container content count entry feed field form group heading holder "
             "icon icons inline inner input item items label left link links list main media message meta msg outer panel placeholder policy post posts preferences region reply right row "
             "section settings slot space stories strip teaser teasers text thread title toggle top unit us wrap wrapper zone".split())
#: Before "header" these name the head of the text itself.
OWN = set("article content entry headline post story title".split())
PLAIN_NAME = re.compile(r"(?:has|with|no|without|not|is)[-_].*", re.I)
CLEAR, SUSPECT, OUTRIGHT = range(3)


def _name(name: str) -> int:
    """Whether a class or id marks its element out: OUTRIGHT, or SUSPECT if a part of NAMES comes first and other words follow."""
    if PLAIN_NAME.fullmatch(name):
        return CLEAR
    parts = [p.rstrip("0123456789") or p for p in re.split("[-_]+", name.lower()) if p]
    hits = [p in NAMES for p in parts]
    if not any(hits) or parts[-1] == "header" and len(parts) > 1 and parts[-2] in OWN:
        return CLEAR
    rest = [p for p, hit in zip(parts, hits) if not hit]
    if hits[-1] or hits[0] and all(p in FRAMES or p.isdigit() for p in rest):
        return OUTRIGHT
    return SUSPECT if hits[0] else CLEAR


def _marked(tag: str, attributes: str) -> int:
    if tag in OUT:
        return OUTRIGHT
    if not attributes or tag in ("html", "body", "article", "main"):
        return CLEAR
    found = CLEAR
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            found = max([found, *map(_name, value.split())])
        elif name == "role":
            if value.lower() in ROLES:
                return OUTRIGHT
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUTRIGHT
    return found


def blocks(page: str) -> list[tuple[str, str]]:
    """(ARTICLE, OUTSIDE or MARKED, text) of the blocks in page order; the first two as capitals where a name is suspect."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, marked out, suspect, article
    marked = suspect = inside = linked = 0
    heading = link = False
    at = 0

    def flush():
        nonlocal linked
        size = sum(map(len, held))
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            kind = MARKED if marked and not (heading and inside and stack[-1][0] == "header" and marked == 1) else ARTICLE if inside else OUTSIDE
            if suspect and kind != MARKED:
                kind = MARKED if linked * 2 >= size else kind.upper()
            out.append((kind, text))
        linked = 0

    def pop():
        nonlocal marked, suspect, inside
        _, m, s, a = stack.pop()
        marked -= m
        suspect -= s
        inside -= a

    while True:
        found = TAG.search(page, at)
        if found is None:
            held.append(page[at:])
            break
        held.append(page[at:found.start()])
        linked += link * (found.start() - at)
        at = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                held.append(entities.escape(found[0][9:].removesuffix("]]>")))
            continue
        tag, closing = name.lower(), bool(found[1] or found[4])
        attributes = found[3] or found[6] or ""
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = CLOSE[tag].search(page, at)
                at = end.end() if end else len(page)
            held.append(" ")
            continue
        if tag == "br" or tag in ("td", "th"):
            held.append(" ")
            if tag == "br":
                continue
        if tag in BLOCK:
            flush()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
        if tag == "a":
            link = not closing
        if closing:
            if any(s[0] == tag for s in stack):
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in HOLDS:
            continue
        m = _marked(tag, attributes)
        if tag in BLOCK and stack and stack[-1][0] in ("p", "li", "dt", "dd") and (tag == stack[-1][0] or stack[-1][0] == "p"):
            pop()  # the next block ends an open paragraph or item
        if m or tag in HOLDS:
            m, s = m == OUTRIGHT, m == SUSPECT
            flush()
            a = tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes, re.I))
            stack.append((tag, m, s, a))
            marked += m
            suspect += s
            inside += a
    flush()
    return out


def standing(hashes: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, pages, first): the tokens at which a run of RUN tokens of one page begins, the number of distinct pages it
    stands on, and which of them are the first of their run.

    Ranks of suffixes by prefix doubling: after k rounds equal ranks mean equal first 2^k tokens of one page."""
    rank = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    place, depth = np.arange(len(hashes)), 1
    while depth < RUN:
        step = min(depth, RUN - depth)
        place = place[place + step < len(hashes)]
        place = place[(page[place] == page[place + step]) & (rank[place + step] >= 0)]
        pair = rank[place] * (len(hashes) + 1) + rank[place + step]
        new = np.full(len(hashes), -1, np.int64)
        new[place] = np.unique(pair, return_inverse=True)[1] if len(pair) else 0
        rank, depth = new, depth + step
    if not len(place):
        return place, place, np.zeros(0, bool)
    order = np.lexsort((page[place], rank[place]))  # the suffix array, to this depth, pages in order
    r, p = rank[place][order], page[place][order]
    starts = np.flatnonzero(np.diff(r, prepend=-1))
    fresh = np.ones(len(r), np.int64)
    fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    pages = np.add.reduceat(fresh, starts)
    first = np.zeros(len(r), bool)
    first[starts] = True
    return place[order], np.repeat(pages, np.diff(np.append(starts, len(r)))), first


def covered(begins: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in one of the runs that begin there."""
    common = np.zeros(size + 1, np.int64)
    np.add.at(common, begins, 1)
    np.add.at(common, begins + RUN, -1)
    return np.cumsum(common[:-1]) > 0


def _limits(pages: int) -> tuple[int, int]:
    """Pages on which a run outside and inside of articles must stand."""
    return min(OUTSIDE_PAGES, max(2, int(np.ceil(OUTSIDE_SHARE * pages)))), max(TEMPLATE_PAGES, int(np.ceil(TEMPLATE_SHARE * pages)))


def _run_hashes(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The upper ``HASH_BITS`` of the hashes of the runs."""
    if not len(begins):
        return np.zeros(0, np.int64)
    return (shingles(hashes, np.array([0, len(hashes)]), RUN, whole_short=False)[0][begins] >> U(64 - HASH_BITS)).view(np.int64)


def _tokens(pages: list[list[tuple[str, str]]]):
    """Blocks as one array; the hashes of their tokens; the number of tokens of each block; the page of each block."""
    flat = pa.array([t for p in pages for _, t in p], pa.large_string())
    page_of = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    hashes, size = [], []
    for _, _, raw, offsets in runs(flat):
        start, end, first = words(raw, offsets, ~SPACE)
        hashes.append(word_hashes(raw, start, end, fold=False))
        size.append(np.diff(first))
    return flat, np.concatenate([np.zeros(0, U), *hashes]), np.concatenate([np.zeros(0, np.int64), *size]), page_of


def shard_runs(pages: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, distinct pages) of every run of a shard."""
    _, hashes, size, page_of = _tokens(pages)
    begins, counts, first = standing(hashes, np.repeat(page_of, size))
    return _run_hashes(hashes, begins[first]), counts[first]


def choose(pages: list[list[tuple[str, str]]], total: int | None = None, common: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """Main text of every page of one host; of one of its shards, if ``total`` pages of the host and ``common``, the sorted hashes
    and the pages of the runs found on enough of them, are given."""
    flat, hashes, size, page_of = _tokens(pages)
    if not len(size):
        return [""] * len(pages)
    kinds = np.array([k for p in pages for k, _ in p], object)
    page = np.repeat(page_of, size)
    owner = np.repeat(np.arange(len(size)), size)
    if common is None:
        begins, counts, _ = standing(hashes, page)
    else:
        begins = np.arange(max(len(hashes) - RUN + 1, 0))
        begins = begins[page[begins] == page[begins + RUN - 1]]
        known, times = common
        counts = np.zeros(len(begins), np.int64)
        if len(known) and len(begins):
            value = _run_hashes(hashes, begins)
            at = np.minimum(np.searchsorted(known, value), len(known) - 1)
            counts = np.where(known[at] == value, times[at], 0)

    def share(least):
        return np.bincount(owner, covered(begins[counts >= least], len(hashes)), len(size)) / np.maximum(size, 1)

    suspect = (kinds == ARTICLE.upper()) | (kinds == OUTSIDE.upper())
    article, outside = (kinds == ARTICLE) | (kinds == ARTICLE.upper()), (kinds == OUTSIDE) | (kinds == OUTSIDE.upper())
    few, most = _limits(len(pages) if total is None else total)
    gone, template = np.zeros(len(size), bool), np.zeros(len(size), bool)
    if outside.any() or suspect.any():
        frame = outside | suspect
        gone |= frame & (share(few) >= 0.5)
        template |= frame & (share(max(few, TEMPLATE_PAGES)) >= 0.5)
    inside = article & (share(most) >= COVERED)
    gone, template = gone | inside, template | inside
    # articles hold the text, unless more of what stands on this page alone is outside of them: then they are teasers
    own = [np.bincount(page_of, size * (part & ~gone), len(pages)) for part in (article, outside)]
    has_article = np.bincount(page_of, article, len(pages)) > 0
    base = article | (outside & ~(has_article & (TEASER * own[0] >= own[1]))[page_of])
    held = np.bincount(page_of, size * base, len(pages))
    lost = np.bincount(page_of, size * (gone & base), len(pages))
    gone = np.where((lost * 2 > held)[page_of], template, gone)
    lost = np.bincount(page_of, size * (gone & base), len(pages))
    keep = base & ~(gone & (lost < held)[page_of])
    out: list[list[str]] = [[] for _ in pages]
    strings = flat.to_pylist()
    for i in np.flatnonzero(keep).tolist():
        out[page_of[i]].append(strings[i])
    return ["\n\n".join(x) for x in out]


def _pack(batches):
    """Parsed pages by (host, shard), compressed together."""
    codec = pa.Codec("zstd")
    for batch in batches:
        host, shard = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        order = sorted(range(len(host)), key=lambda i: (host[i], shard[i]))
        group: list[int] = []
        streams: list[str] = []
        ready, size = [], 0
        pages = texts(batch.column(4))

        def close():
            nonlocal group, streams, size
            if group:
                data = "\x1e".join(streams).encode("utf-8", "surrogatepass")
                ready.append((host[group[0]], shard[group[0]], [*group], len(data), codec.compress(data, asbytes=True)))
            group, streams, size = [], [], 0

        for i in order:
            if group and ((host[i], shard[i]) != (host[group[0]], shard[group[0]]) or size > 4_000_000):
                close()
            group.append(i)
            streams.append("\x1d".join(k + t for k, t in blocks(pages[i].as_py())))
            size += len(streams[-1])
        close()
        if ready:
            members = np.concatenate([r[2] for r in ready])
            where = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in ready])]).astype(np.int32))
            take = pa.array(members)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], pa.string()), pa.array([r[1] for r in ready], pa.int32()),
                                              pa.ListArray.from_arrays(where, batch.column(0).take(take)), pa.ListArray.from_arrays(where, batch.column(1).take(take)),
                                              pa.array([r[3] for r in ready], pa.int64()), pa.array([r[4] for r in ready], pa.binary())], ["host", "shard", "pages", "urls", "size", "data"])


def _unpacked(pdf: pd.DataFrame):
    codec = pa.Codec("zstd")
    ids, urls, pages = [], [], []
    for i, u, n, data in zip(pdf["pages"], pdf["urls"], pdf["size"], pdf["data"]):
        ids.extend(i)
        urls.extend(u)
        body = codec.decompress(data, int(n), asbytes=True).decode("utf-8", "surrogatepass") if n else ""
        pages.extend([(b[0], b[1:]) for b in p.split("\x1d") if b] for p in body.split("\x1e"))
    return ids, urls, pages


def _unpack(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, urls, pages = _unpacked(pdf)
    return pd.DataFrame({"page": ids, "url": urls, "text": choose(pages)})


def _squeeze(run: np.ndarray, pages: np.ndarray) -> bytes:
    """Sorted hashes as differences, and page numbers, byte plane after byte plane, compressed."""
    step = np.diff(run, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return pa.Codec("zstd").compress(step.tobytes() + pages.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unsqueeze(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 10 * n, asbytes=True), np.uint8).reshape(10, n)
    step = np.zeros((n, 8), np.uint8)
    step[:, :6] = planes[:6].T
    return np.cumsum(step.view("<u8").ravel().astype(np.int64)), np.ascontiguousarray(planes[6:].T).view("<u4").ravel().astype(np.int64)


def _count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of a shard in buckets by their hash, one for two shards of the host."""
    run, pages = shard_runs(_unpacked(pdf)[2])
    order = np.argsort(run)
    run, pages = run[order], pages[order]
    buckets = min(-(-int(pdf["shards"].iloc[0]) // 2), 1 << 16)
    cuts = np.searchsorted((run * buckets) >> HASH_BITS, np.arange(buckets + 1))
    rows = [(key[0], i, key[1], int(pdf["total"].iloc[0]), int(b - a), _squeeze(run[a:b], pages[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pd.DataFrame(rows, columns=["owner", "bucket", "part", "total", "n", "data"])


def _sum(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of a bucket that stand on enough pages of the host, for each shard that holds them."""
    run, pages = (np.concatenate(x) for x in zip(*[_unsqueeze(d, int(n)) for d, n in zip(pdf["data"], pdf["n"])]))
    part = np.repeat(pdf["part"].to_numpy(), pdf["n"].to_numpy())
    total = int(pdf["total"].iloc[0])
    values, at = np.unique(run, return_inverse=True)
    count = np.bincount(at, pages, len(values)).astype(np.int64)[at]
    keep = count >= _limits(total)[0]
    return pd.DataFrame({"owner": key[0], "part": part[keep], "run": run[keep], "count": count[keep], "total": total})


def _unpack_shard(pdf: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
    ids, urls, pages = _unpacked(pdf)
    common = common.sort_values("run")
    total = int(common["total"].iloc[0]) if len(common) else len(pages)
    return pd.DataFrame({"page": ids, "url": urls, "text": choose(pages, total, (common["run"].to_numpy(np.int64), common["count"].to_numpy(np.int64)))})


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", shard: int = SHARD) -> DataFrame:
    """One row per row of ``pages``: key, url and ``text``."""
    host = F.coalesce(F.regexp_extract(F.lower(q(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))
    base = pages.select(q(key).alias("page"), q(url).alias("url"), host.alias("host"), q(html).alias("html"))
    large = base.groupBy("host").agg(F.sum(F.length("html")).alias("size"), F.count(F.lit(1)).alias("total")).filter(F.col("size") > shard).select(
        F.col("host").alias("large"), F.ceil(F.col("size") / shard).cast("int").alias("shards"), "total")
    large = materialise(large, "hosts")
    hosts = large.count()
    few = hosts <= BROADCAST_HOSTS
    side = F.broadcast(large) if few else large
    base = base.join(side.drop("total"), F.col("host") == F.col("large"), "left").select(
        "page", "url", "host", F.when(F.col("shards").isNull(), 0).otherwise(F.pmod(F.xxhash64("page", "url"), F.col("shards"))).cast("int").alias("shard"), "html", "shards")
    kind, text = base.schema["page"].dataType.simpleString(), base.schema["url"].dataType.simpleString()
    out = f"page {kind}, url {text}, text string"

    def packed(rows):
        return rows.drop("shards").mapInArrow(lean(_pack), f"host string, shard int, pages array<{kind}>, urls array<{text}>, size long, data binary")

    whole = packed(base.filter("shards is null")).groupBy("host", "shard").applyInPandas(_unpack, out)
    if hosts:
        side = side.select(F.xxhash64("large").alias("of"), "shards", "total")
        cut = packed(base.filter("shards is not null")).withColumn("owner", F.xxhash64("host")).withColumnRenamed("shard", "part").drop("host")
        cut = cut.join(F.broadcast(side) if few else side, F.col("owner") == F.col("of")).drop("of")
        counts = cut.groupBy("owner", "part").applyInPandas(_count, "owner long, bucket int, part int, total long, n long, data binary")
        common = counts.groupBy("owner", "bucket").applyInPandas(_sum, "owner long, part int, run long, count long, total long")
        whole = whole.unionAll(cut.groupBy("owner", "part").cogroup(common.groupBy("owner", "part")).applyInPandas(_unpack_shard, out))
    return whole.select(F.col("page").alias(key), F.col("url").alias(url), "text")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
