"""Main text of web pages: long substrings that a host's distinct pages share, checked by zones of the markup."""

from __future__ import annotations

import functools
import html as _html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .common import materialise, read

#: Words of a substring that counts as boilerplate, and distinct pages of a host that must share it.
RUN, MIN_PAGES = 8, 3
#: Pages of which this share of the 3-word windows is common are near copies; least hashes by which they are found and compared.
NEAR, BAND, SKETCH = 0.9, 16, 128
#: Bits of a window's hash that are counted first, and of these the bits that name a bucket; characters of pages taken together.
KEY_BITS, BUCKET_BITS = 36, 10
SLICE = 8_000_000

#: Elements whose content is no markup, elements that hold no page text or are never part of an article, elements that break text.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
ASIDE = {"nav", "header", "footer", "aside", "button", "dialog", "menu", "head", "fieldset", "noscript", "template", "svg", "math", "object", "select", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
NAMES = set(
    "nav navbar navigation menu header masthead footer sidebar side ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription comment comments respond replies reply disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager popup modal overlay login signup signin search form toolbar widget skip adsbygoogle advertorial".split()
)
#: The names that head a compound after any other word (``acme-footer``); of these the adverts, which count inside sentences too.
HEADS = set("nav navbar navigation menu masthead footer sidebar ads advert adverts advertisement advertorial adsbygoogle sponsored newsletter comments disqus breadcrumb breadcrumbs pagination pager popup modal toolbar gdpr".split())
ADVERTS = set("ad ads advert adverts advertisement advertising adsbygoogle advertorial sponsor sponsored promo promotion".split())
#: Words that stand beside a name and say no more than where or what kind of box it is.
BOXES = set(
    "area articles bar block body bottom box btn button buttons col column container content desktop fixed global google group head icon icons inner item items label layer left less link links list local main media mobile outer page panel post posts primary right row secondary section site slot stack sticky stories sub text title top unit wrap wrapper".split()
)
NEGATED = {"has", "with", "no", "without", "non", "not", "is"}
#: Names of sections whose articles are not the page's own.
OTHERS = {"comment", "comments", "respond", "replies", "reply", "disqus", "related", "recommended"}
#: Where an end tag stops looking for its element, and the elements that a start tag ends, up to others.
SCOPE = {"table", "td", "th", "caption", "object", "template", "html"}
ENDS_P = set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
IMPLIED = {
    "li": ({"li"}, SCOPE | {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, SCOPE | {"dl"}),
    "dd": ({"dt", "dd"}, SCOPE | {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "template"}),
    "td": ({"td", "th"}, {"tr", "table", "template"}),
    "th": ({"td", "th"}, {"tr", "table", "template"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_P = ({"p"}, SCOPE | {"button"})
_STOP = re.compile(r"""[>"']""")
_NEXT = re.compile(r"\s*(?:</?([a-zA-Z][^\s/>]*)|$)")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {name: re.compile(f"</{name}(?![a-z0-9])", re.IGNORECASE) for name in RAW}


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Place of the bracket that ends the tag at ``at``, or -1; brackets in quoted values do not count.

    ``missing`` holds the quotes that do not come again, so that a page is searched once for each.
    """
    while m := _STOP.search(page, at):
        mark, at = m[0], m.end()
        if mark == ">":
            return m.start()
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and mark not in missing:
            close = page.find(mark, at)
            if close < 0:
                missing.add(mark)
            else:
                at = close + 1
    return -1


def _words(part: str) -> list[str]:
    """The words that a part of a name is made of: itself, or two known ones written together (``cookiebanner``)."""
    if part not in NAMES:
        for k in range(2, len(part) - 1):
            a, b = part[:k], part[k:]
            if a in NAMES and (b in NAMES or b in BOXES) or a in BOXES and b in NAMES:
                return [a, b]
    return [part]


@functools.lru_cache(20_000)
def ruled_out(name: str, free: bool) -> frozenset[str]:
    """The words of one class name or id that say that the element holds no main text; none if it says otherwise.

    All its parts must be known: NAMES, BOXES, numbers, or a prefix of up to two letters. So ``ad-box-2`` counts, and
    ``ad-hoc`` and ``social-history`` do not. If ``free``, a name of HEADS may also follow or be followed by other words
    (``acme-footer-inner``), as classes are; ids are often headings (``history-of-advertising``).
    """
    parts = [w for p in re.split(r"[-_:.]+", name) if p for w in _words(p)]
    found = frozenset(p for p in parts if p in NAMES)
    if not found or parts[0] in NEGATED:
        return frozenset()
    known = [p in NAMES or p in BOXES or p[0].isdigit() or k == 0 and len(p) < 3 for k, p in enumerate(parts)]
    if all(known):
        return found
    last = next((p for p in reversed(parts) if p not in BOXES and not p[0].isdigit()), "")
    return found if free and last in HEADS and not NEGATED & set(parts) else frozenset()


def _zone(name: str, attrs: str) -> tuple[bool, bool, bool, bool, bool]:
    """(holds no main text, does so by its class, id or form, holds others' articles, is an advert, is the page's main part)."""
    found = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    main = name == "main" or found.get("role") == "main"
    if main or name in ("html", "body"):
        return False, False, False, False, main
    hard = name in ASIDE or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES
    hard = hard or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    words = {w for n in found.get("class", "").split() for w in ruled_out(n, True)} | {w for n in found.get("id", "").split() for w in ruled_out(n, False)}
    soft = name == "form" or bool(words) and name not in HEADINGS
    return hard, soft, bool(words & OTHERS), bool(words & ADVERTS) and name != "a", False


def _alone(page: str, pos: int, name: str) -> bool:
    """Whether nothing but space stands between an inline element's first end tag after ``pos`` and the end of its block."""
    end = page.find(f"</{name}", pos)
    gt = page.find(">", end) if end >= 0 else -1
    m = _NEXT.match(page, gt + 1) if gt >= 0 else None
    return m is not None and (m[1] is None or m[1].lower() not in INLINE)


def blocks(page: str) -> tuple[list[str], list[bool], bool]:
    """(texts of the page's blocks in order, whether each belongs to the article, whether markup names an article)."""
    return parse(page)[:3]


def parse(page: str) -> tuple[list[str], list[bool], bool, list[bool]]:
    """What ``blocks`` gives, and whether each block is links alone, outside headings.

    A block ends at every element that is not inline. Character references are decoded and white space is one space.
    Classes and ids rule out whole elements; an inline one only if it fills its block, adverts (but links) always.
    One pass with a stack of open elements and the end tags that HTML implies. An article in a wrapper whose class or
    form would rule it out counts if the page has no other.
    """
    names: list[tuple[str, bool, bool, bool, bool, bool]] = []  # name, hard, soft, others, article, main
    hard = soft = others = article = main = outside = links = heads = 0
    out: list[tuple] = []
    run: list[str] = []
    bare = False  # whether the block has words outside links or stands in a heading

    def flush() -> None:
        nonlocal bare
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append((text, hard > 0, soft > 0, others > 0, soft > outside, article > 0, main > 0, not bare))
            bare = False

    def add(text: str) -> None:
        nonlocal bare
        run.append(text)
        if not bare:
            bare = heads > 0 or not links and not text.isspace()

    def close(k: int) -> None:
        nonlocal hard, soft, others, article, main, links, heads
        if any(x[1] or x[2] or x[4] or x[5] for x in names[k:]):
            flush()
        for x, h, s, o, r, w in names[k:]:
            links, heads = links - (x == "a"), heads - (x in HEADINGS)
            hard, soft, others, article, main = hard - h, soft - s, others - o, article - r, main - w
        del names[k:]

    def end_implied(ended: set[str], stops: set[str]) -> None:
        last = -1
        for k in range(len(names) - 1, -1, -1):
            if names[k][0] in ended:
                last = k
            elif names[k][0] in stops:
                break
        if last >= 0:
            close(last)

    pos, n, missing = 0, len(page), set()
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            pos = n if end < 0 else end + 3
            continue
        head = page[lt + 1 : lt + 2]
        if not head or not (head.isascii() and (head.isalpha() or head in "/!?")):
            add("<")
            pos = lt + 1
            continue
        gt = page.find(">", lt) if head in "!?/" else _tag_end(page, lt + 1, missing)
        if gt < 0:
            break
        tag, pos = page[lt + 1 : gt], gt + 1
        m = _NAME.match(tag)
        if head in "!?" or not m:
            continue
        name = m[1].lower()
        inline = name in INLINE
        if not inline:
            flush()
        if head == "/":
            for k in range(len(names) - 1, -1, -1):
                if names[k][0] == name:
                    close(k)
                    break
                if inline and names[k][0] not in INLINE or name not in SCOPE and names[k][0] in SCOPE:
                    break
            continue
        if name in RAW:
            if not tag.endswith("/"):
                end = _RAW_END[name].search(page, pos)
                pos = n if end is None else (page.find(">", end.end()) + 1 or n)
            continue
        if name in ENDS_P:
            end_implied(*_P)
        if name in IMPLIED:
            end_implied(*IMPLIED[name])
        if name in VOID or tag.endswith("/") and name not in ("p", "div"):
            continue
        attrs = tag[m.end() :]
        h, s, o, ad, w = _zone(name, attrs) if attrs else (name in ASIDE, name == "form", False, False, name == "main")
        if inline and s and not ad and ("".join(run).strip() or not _alone(page, pos, name)):
            s = o = False
        r = name == "article"
        if h or s:
            flush()
        if (r or w) and not article and not main:
            outside = soft
        names.append((name, h, s, o, r, w))
        links, heads = links + (name == "a"), heads + (name in HEADINGS)
        hard, soft, others, article, main = hard + h, soft + s, others + o, article + r, main + w
    flush()
    chosen: list[bool] = []
    for zone in (5, 6):  # article, main
        for kept in ([not b[1] and not b[2] for b in out], [not b[1] and not b[3] and not b[4] for b in out]):
            chosen = [k and b[zone] for k, b in zip(kept, out, strict=True)]
            if any(chosen):
                return [b[0] for b in out], chosen, True, [b[7] for b in out]
    return [b[0] for b in out], [not b[1] and not b[2] for b in out], False, [b[7] for b in out]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _coded(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(a code of each word of the pages' blocks, in order; words of each page)."""
    split = pc.split_pattern(pa.array([b for p in pages for b in p], pa.large_string()), " ")
    words = pc.dictionary_encode(pc.list_flatten(split))
    names = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words.dictionary.to_pylist()], np.uint64)
    upto = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy()))).astype(np.int64)
    sizes = np.diff(upto[np.concatenate(([0], np.cumsum([len(p) for p in pages], dtype=np.int64)))])
    return names[words.indices.to_numpy()], sizes


def _rolled(codes: np.ndarray, run: int) -> np.ndarray:
    size = max(0, len(codes) - run + 1)
    h = _mixed(codes[:size])
    for k in range(1, run):
        h = _mixed(h + codes[k : k + size])
    return h


def window_hashes(hosts: list[str], codes: np.ndarray, sizes: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, page, place in the page) of each window of ``run`` words of a page, in order.

    Suffixes of one host's pages that share a prefix of ``run`` words share the hash: they stand together in a suffix array.
    """
    h, page = _rolled(codes, run), np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(page[: len(h)] == page[run - 1 :])
    page = page[at]
    seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in hosts], np.uint64)
    return _mixed(h[at] + seeds[page]), page, at - (np.cumsum(sizes) - sizes)[page]


def _sketches(codes: np.ndarray) -> tuple[list[int], list[int]]:
    """(bands, least window hashes) of a page's word codes: near copies mostly agree in a band, and are compared by the least hashes."""
    h = _distinct(_rolled(codes, 3).view(np.int64))
    at = int(np.searchsorted(h, 0))
    parts = [p for p in (h[:at][:BAND], h[:at][-BAND:], h[at:][:BAND], h[at:][-BAND:]) if len(p) == BAND]
    return [xxhash.xxh64_intdigest(p.tobytes()) for p in parts], h[:SKETCH].tolist()


def _content(host: str, texts: list[str]) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{' '.join(texts)}".encode()) - (1 << 63)


def _parsed(batches):
    """(hosts, texts of the blocks that markup leaves, keys) of pages, about SLICE characters at a time."""
    hosts, pages, keys, size = [], [], [], 0
    for batch in batches:
        for host, key, page in zip(batch.column("host").to_pylist(), batch.column("page_key").to_pylist(), batch.column("html"), strict=True):
            texts, kept, _ = blocks(page.as_py() or "")
            hosts.append(host)
            keys.append(key)
            pages.append([t for t, k in zip(texts, kept, strict=True) if k])
            size += sum(map(len, pages[-1]))
            if size >= SLICE:
                yield hosts, pages, keys
                hosts, pages, keys, size = [], [], [], 0
    if pages:
        yield hosts, pages, keys


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]]


def _keys(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - KEY_BITS)


def _common_keys(pages: DataFrame, min_pages: int) -> DataFrame:
    """(key): the first KEY_BITS bits of window hashes that ``min_pages`` or more pages hold, of ``pages(host, html)``.

    A task sends a key at most ``min_pages`` times; keys go to buckets as sorted differences, two to three bytes each
    once they are compressed, and each bucket counts its own. A few keys too many do no harm: hashes are counted later.
    """
    low, m = np.uint64(KEY_BITS - BUCKET_BITS), min_pages - 1

    def send(batches):
        for hosts, texts, _ in _parsed(batches):
            h, page, _ = window_hashes(hosts, *_coded(texts))
            keys = _distinct(_keys(h) << np.uint64(64 - KEY_BITS) | page.astype(np.uint64)) >> np.uint64(64 - KEY_BITS)
            keys = np.concatenate((keys[:min_pages], keys[min_pages:][keys[min_pages:] != keys[: max(0, len(keys) - min_pages)]]))
            buckets = (keys >> low).astype(np.int32)
            values = (keys & ((np.uint64(1) << low) - np.uint64(1))).astype(np.uint32)
            edges = np.concatenate(([0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(keys)])).tolist()
            parts = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
            packed = [np.diff(values[a:b], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[[a for a, _ in parts]]), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def count(key, table):
        parts = [np.frombuffer(p, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for p in table.column("packed").to_pylist()]
        values = np.sort(np.concatenate([np.cumsum(p, dtype=np.uint32) for p in parts]))
        common = _distinct(values[m:][values[m:] == values[: max(0, len(values) - m)]]).astype(np.int64)
        return pa.table({"key": common | (key[0].as_py() << int(low))})

    return pages.mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(count, "key long")


def _width(count: int) -> int:
    """Bits that number a bitmap's places: 32 places or more for each of ``count`` rows, but 2 ** 30 (128 MB) at most."""
    return min(30, max(20, (32 * count).bit_length()))


def _bitmap(rows: DataFrame, place: Column, width: int) -> np.ndarray:
    """The places that ``rows`` hold, as a bitmap: it only lets pass what is looked up exactly later."""
    found = np.zeros((1 << width) // 8, np.uint8)
    places = rows.select((place.bitwiseAND((1 << width) - 1) + 1).alias("place"))
    for r in places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map")).collect():
        found[(r.part - 1) * len(r.map) :][: len(r.map)] = np.frombuffer(r.map, np.uint8)
    return found


def _passes(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64) & (8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def candidates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_key, content, bands, sketch, windows, places): pages of ``pages(host, html, page_key)`` with their windows that may be shared."""
    common = materialise(_common_keys(pages, min_pages), "common-windows")
    width = _width(common.count())
    shift = KEY_BITS - width
    known = pages.sparkSession.sparkContext.broadcast([_bitmap(common, F.col("key"), width), _bitmap(common, F.shiftright("key", shift), width)])

    def find(batches):
        first, second = known.value
        for hosts, texts, names in _parsed(batches):
            codes, sizes = _coded(texts)
            h, page, place = window_hashes(hosts, codes, sizes)
            keys = _keys(h)
            hit = np.flatnonzero(_passes(first, keys))
            hit = hit[_passes(second, keys[hit] >> np.uint64(shift))]
            h, page, place = h[hit].view(np.int64), page[hit], place[hit]
            starts = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1]))[: len(page)])
            chosen, edges = page[starts].tolist(), pa.array(np.append(starts, len(page)).astype(np.int32))
            firsts = np.cumsum(sizes) - sizes
            marks = [_sketches(codes[firsts[p] : firsts[p] + sizes[p]]) for p in chosen]
            contents = [_content(hosts[p], texts[p]) for p in chosen]
            seeded = [[xxhash.xxh64_intdigest(f"{hosts[p]} {b}") - (1 << 63) for b in m[0]] for p, m in zip(chosen, marks, strict=True)]
            longs = pa.list_(pa.int64())
            cols = [pa.array([names[p] for p in chosen], pa.int64()), pa.array(contents, pa.int64()), pa.array(seeded, longs), pa.array([m[1] for m in marks], longs)]
            cols += [pa.ListArray.from_arrays(edges, pa.array(h)), pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, ["page_key", "content", "bands", "sketch", "windows", "places"])

    return pages.mapInArrow(find, "page_key long, content long, bands array<long>, sketch array<long>, windows array<long>, places array<int>")


def _kinds(pages: DataFrame) -> DataFrame:
    """(content, kind) of ``pages(content, bands, sketch)`` that have near copies: kind is equal in a group of them.

    Pages that share a band are compared with one of them by their least hashes; a row per page and band, never pairs.
    """
    held = pages.select("content", F.explode("bands").alias("band")).distinct()
    hubs = held.groupBy("band").agg(F.min("content").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
    pairs = materialise(held.join(hubs, "band").filter("content != hub").select("content", "hub").distinct(), "page-pairs")
    ends = pairs.select("content").unionByName(pairs.select(F.col("hub").alias("content"))).distinct()
    marks = pages.select("content", "sketch").join(ends, "content", "left_semi").dropDuplicates(["content"])
    hub_marks = marks.select(F.col("content").alias("hub"), F.col("sketch").alias("hub_sketch"))
    union = F.slice(F.array_sort(F.array_union("sketch", "hub_sketch")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("sketch", "hub_sketch"), union))
    near = pairs.join(marks, "content").join(hub_marks, "hub").filter(both >= NEAR * F.size(union))
    return graph.components(near.select(F.col("content").alias("u"), F.col("hub").alias("v"))).select(F.col("node").alias("content"), F.col("component").alias("kind"))


def shared_windows(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(h): hashes in ``windows`` of ``min_pages`` or more distinct contents of a host, near copies counted once.

    ``pages(content, bands, sketch, windows)``, hashes and contents of a host its own. Counted in two combined steps,
    (hash, kind) then hash, over all pages of a host, however many.
    """
    kinds = _kinds(pages).withColumnRenamed("content", "content_")
    found = pages.select("content", "windows").join(kinds, F.col("content") == F.col("content_"), "left")
    seen = found.select(F.coalesce("kind", "content").alias("kind"), F.explode("windows").alias("h")).distinct()
    return seen.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("h")


def shared_places(pages: DataFrame) -> DataFrame:
    """(page_key, places): where windows start that pages of the host share; pages without one have no row."""
    marked = materialise(candidates(pages), "page-windows")
    shared = materialise(shared_windows(marked), "shared-windows")
    each = marked.select("page_key", F.explode(F.arrays_zip("windows", "places")).alias("w")).select("page_key", F.col("w.windows").alias("h"), F.col("w.places").alias("place"))
    return materialise(each.join(shared, "h").groupBy("page_key").agg(F.collect_set("place").alias("places")), "shared-places")


def covered(size: int, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``run`` words that begins at one of ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:size] > 0


def _unique(block: list[str], mask: np.ndarray) -> list[str]:
    """The block's words outside shared substrings; of a block not covered whole, stretches of under RUN words stay."""
    if mask.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    out, at = [], 0
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if stop - start >= RUN:
            out += block[at:start]
            at = stop
    return out + block[at:]


def own_text(texts: list[str], links: list[bool], named: bool, places: list[int]) -> tuple[str, int, int]:
    """(a page's text, its words in shared substrings, those of them that are dropped); ``places`` is where shared windows start.

    Shared substrings go. Where markup names the article it checks them: what it shows as the article's own is restored,
    and only blocks of links alone go, where runs of such blocks are shared: a menu without a name.
    """
    if not places:
        return " ".join(texts), 0, 0
    split, starts = [b.split(" ") for b in texts], np.array(places, np.int64)
    mask, sizes = covered(sum(map(len, split)), starts), [len(b) for b in split]
    gone = mask
    if named:
        loose = np.concatenate(([0], np.cumsum(np.repeat(links, sizes))))
        gone = covered(len(mask), starts[loose[starts + RUN] - loose[starts] == RUN])
    at, words = 0, []
    for b in split:
        part = gone[at : at + len(b)]
        at += len(b)
        if not named:
            words += _unique(b, part)
        elif not part.all():
            words += b
    return " ".join(words), int(mask.sum()), len(mask) - len(words)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, host_words, dropped_words): a row per input row.

    Every page gives the blocks that markup leaves: those of the article (or else main) where markup names one, less menus,
    headers, footers, sidebars, notices, adverts, forms and comments. In them substrings of RUN words that MIN_PAGES
    distinct pages of the host share are boilerplate (``host_words``) and go; unique runs stay. Where markup names the
    article, it checks that: passages that it shows as the article's own are restored, menus of links are not.
    ``dropped_words`` counts what is lost in the end. Suffixes are grouped by a hash of their first RUN words, as a suffix
    array orders them, and counted over all pages of the host; pages are parsed once to find hashes that may be shared,
    once to count these, and once for their texts, so that only such hashes and the texts that hold them are shuffled whole.
    Null html gives an empty text, null urls share one host; repeated rows stay; an empty table gives an empty one.
    """
    host = F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lower(host).alias("host"), F.col(html_col).alias("html"))
    base = base.withColumn("page_key", F.xxhash64("host", "html"))
    kind = dict(base.dtypes)["id"]
    places = shared_places(base.select("host", "html", "page_key"))
    known = pages.sparkSession.sparkContext.broadcast(_bitmap(places, F.col("page_key"), _width(places.count())))

    def rows(batch, got):
        cols = [batch.column("id"), batch.column("url"), pa.array([g[0] for g in got], pa.string())]
        cols += [pa.array(c, pa.int64()) for c in ([len(g[0]) for g in got], [g[1] for g in got], [g[2] for g in got])]
        return pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars", "host_words", "dropped_words"])

    def whole(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_passes(known.value, batch.column("page_key").to_numpy())))
            found = [blocks(h.as_py() or "") for h in batch.column("html")]
            yield rows(batch, [(" ".join(t for t, k in zip(texts, kept, strict=True) if k), 0, 0) for texts, kept, _ in found])

    def split(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_passes(known.value, batch.column("page_key").to_numpy())))
            found = [parse(h.as_py() or "") for h in batch.column("html")]
            kept = [[t for t, k in zip(f[0], f[1], strict=True) if k] for f in found]
            links = [[x for x, k in zip(f[3], f[1], strict=True) if k] for f in found]
            cols = [batch.column(c) for c in ("id", "url", "page_key")] + [pa.array(kept, pa.list_(pa.string())), pa.array(links, pa.list_(pa.bool_())), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "url", "page_key", "texts", "links", "named"])

    def finish(batches):
        for batch in batches:
            yield rows(batch, [own_text(t, x, n, p or []) for t, x, n, p in zip(*(batch.column(c).to_pylist() for c in ("texts", "links", "named", "places")), strict=True)])

    out = f"id {kind}, url string, text string, n_chars long, host_words long, dropped_words long"
    sharing = base.mapInArrow(split, f"id {kind}, url string, page_key long, texts array<string>, links array<boolean>, named boolean").join(places.hint("merge"), "page_key", "left")
    return base.mapInArrow(whole, out).unionByName(sharing.select("id", "url", "texts", "links", "named", "places").mapInArrow(finish, out))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
