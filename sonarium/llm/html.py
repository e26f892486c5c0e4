"""Main text of web pages, with a suffix array per host for boilerplate.

Markup sorts the blocks of a page into chrome (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments), main (inside an article or
main element) and open ones (neither). All of them enter the suffix array: the
token streams of a host's pages are concatenated, and substrings of RUN tokens
that stand on distinct pages are found. Repetition then carries what markup says
on one page to the others:

* a run that is chrome on one page and stands in the main part of two distinct
  pages is chrome there too (markup is overruled). One that stands in the main
  part of a single page is merely quoted by a menu or a teaser, and stays;
* a run that is never chrome, but main on some page, is an article's prose, and
  stays in open blocks as well, even where other runs overlap it (markup confirms);
* a run that stands in open blocks only, or is chrome on some page, goes from
  open blocks.

Open blocks of fewer than RUN tokens go if the same block stands on another
page. Where a page marks its main content, open blocks count only if the marked
part is LITTLE of the text. Pages of equal main and open text count as one page.

A run matters only if it stands in a chrome or open block somewhere. So the main
part of a page sends to its host's suffix array only the stretches of which a
fingerprint is that of a chrome or open run: the fingerprint of a run is the
least hash of its GRAM-token windows, equal for equal runs, and a filter of at
most MOST_BITS bits tells which there are. Chance hits send more, never less.

The suffix array is built by prefix doubling up to RUN tokens, so neighbours of
equal rank are exactly the suffixes with a common prefix of that length. Hosts
are dealt out in parts of about PART_BYTES of text, and what repeats between the
parts of a host is exchanged in two steps, which change no result: parts list
the fingerprints of their runs, each once; for those that two parts list, they
list their runs, with the least and greatest page of each and what markup says,
and get back what holds for the host as a whole.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles
from .urlfilter import host_of

RUN, GRAM, PART_BYTES = 16, 6, 1_000_000
LITTLE = 0.25
#: What a page weighs besides its text.
PAGE_BYTES = 64
#: The filter has FILTER_X bits for each fingerprint, but not more than MOST_BITS.
FILTER_X, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
MAIN, CHROME, OPEN = "m", "c", "o"
_BITS = np.zeros(128, np.int64)
_BITS[[ord(MAIN), ord(CHROME), ord(OPEN)]] = IS_MAIN, IS_CHROME, IS_OPEN = 1, 2, 4
_LEAST, _GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object select xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu button head".split())
CHROME_NAMES = frozenset(
    """ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header legal login masthead
    menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related recommended search share sharing sidebar
    signup social sponsor sponsored subscribe subscription toolbar topbar widget complementary contentinfo""".split()
)
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
KEEPS_CLASS = frozenset("html body main".split())


def is_chrome(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME_TAGS or (tag == "header" and not in_main):
        return True
    if not attrs or tag in KEEPS_CLASS:
        return False
    for found in NAMES.findall(attrs):
        for name in "".join(found).lower().split():
            parts = set(re.split(r"[-_]+", name))
            if parts & CHROME_NAMES and not parts & CONTENT_NAMES:
                return True
    return False


def blocks(page: str | None) -> tuple[bool, list[tuple[str, str]]]:
    """(whether the page marks main content, its blocks in order as (kind, text)); references decoded, white space single, no empty blocks."""
    found: list[tuple[str, str]] = []
    marked = False
    if not page:
        return marked, found
    stack: list[tuple[str, bool, bool]] = []
    depth: dict[str, int] = {}
    chrome = main = 0
    held: list[str] = []
    kind = OPEN

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append((kind, text))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            first = page[m.start()]
            if first != "<" or m.end() == m.start() + 1:
                now = CHROME if chrome else MAIN if main else OPEN
                if now != kind:
                    flush()
                    kind = now
                held.append(m.group())
            continue
        tag = tag.lower()
        if tag not in INLINE:
            if tag == "br":
                held.append("\n")
            else:
                flush()
        if m.group("close"):
            if depth.get(tag):
                while stack:
                    name, was_chrome, was_main = stack.pop()
                    depth[name] -= 1
                    chrome -= was_chrome
                    main -= was_main
                    if name == tag:
                        break
            continue
        attrs = m.group("attrs")
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        is_main = not chrome and (tag in ("article", "main") or "main" in attrs and bool(re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I)))
        hidden = is_chrome(tag, attrs, main > 0)
        is_main = is_main and not hidden
        marked = marked or is_main
        stack.append((tag, hidden, is_main))
        depth[tag] = depth.get(tag, 0) + 1
        chrome += hidden
        main += is_main
    flush()
    return marked, found


@dataclass
class Part:
    """Pages as one stream: a border, which equals nothing, stands after each stretch of one kind of a page."""

    texts: list[bytes]
    kinds: list[str]
    copies: np.ndarray
    #: Of the tokens: hash, page, block (counted over all pages), position in the page and place in the stream.
    hashes: np.ndarray
    page: np.ndarray
    block: np.ndarray
    position: np.ndarray
    at: np.ndarray
    length: int
    #: Of the blocks: page and kind; an empty page has one block of no kind.
    block_page: np.ndarray
    block_kind: np.ndarray

    def spread(self, of_tokens: np.ndarray, border: int = 0) -> np.ndarray:
        """Values of the tokens at their places in the stream."""
        out = np.full(self.length, border, of_tokens.dtype)
        out[self.at] = of_tokens
        return out


def part(texts: list[bytes], kinds: list[str], copies: list[int] | None = None, firsts: list[np.ndarray] | None = None) -> Part:
    """texts: the blocks of each page, one a line; kinds: a letter for each block; pages of equal copies count as one; firsts: the position of each block's first token, where blocks are left out."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    hashes, first = shingles.placed_words(data)
    block = np.searchsorted(np.flatnonzero(data == 10), first)
    lines = [max(1, len(k)) for k in kinds]
    block_page = np.repeat(np.arange(len(kinds)), lines)
    block_kind = _BITS[np.frombuffer("".join(k or "\0" for k in kinds).encode(), np.uint8)]
    page, kind = block_page[block], block_kind[block]
    if firsts is None:
        position = np.arange(len(block)) - np.searchsorted(page, page)
    else:
        position = np.concatenate([np.zeros(0, np.int64), *(f if len(f) else [0] for f in firsts)])[block] + np.arange(len(block)) - np.searchsorted(block, block)
    new = np.ones(len(block), bool)
    new[1:] = (page[1:] != page[:-1]) | (kind[1:] != kind[:-1]) | (position[1:] != position[:-1] + 1)
    at = np.arange(len(block)) + np.cumsum(new) - 1
    own = np.arange(len(texts)) if copies is None else np.array(copies, np.int64)
    return Part(texts, kinds, own, hashes, page, block, position, at, len(block) + int(new.sum()), block_page, block_kind)


def _classes(p: Part, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(the suffix array by run tokens, where its classes of equal run start)."""
    rank = np.zeros(p.length, np.int64)
    borders = np.ones(p.length, bool)
    borders[p.at] = False
    n = int(borders.sum())
    rank[borders] = np.arange(n)
    rank[p.at] = n + np.unique(p.hashes, return_inverse=True)[1]
    length = 1
    while length < run:
        step = min(length, run - length)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])


def _windows(p: Part, n: int) -> np.ndarray:
    """64-bit hashes of the n tokens from each place; meaningless where there are fewer before a border."""
    values = np.append(p.spread(p.hashes), np.zeros(n, np.uint64))
    hashes = np.zeros(p.length, np.uint64)
    for i in range(n):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + values[i : i + p.length]
    return shingles.mix(hashes)


def _whole(p: Part, run: int) -> np.ndarray:
    """Places from which run tokens stand before a border."""
    taken = np.zeros(p.length + run, np.int64)
    taken[p.at] = 1
    sums = np.concatenate(([0], np.cumsum(taken)))
    return np.flatnonzero(sums[run : run + p.length] - sums[: p.length] == run)


def _fingerprints(p: Part, run: int, places: np.ndarray) -> np.ndarray:
    """The least hash of the GRAM-token windows inside the run at each of the places."""
    size = min(GRAM, run)
    grams = np.append(_windows(p, size), np.zeros(run, np.uint64))
    least = grams[places]
    for i in range(1, run - size + 1):
        least = np.minimum(least, grams[places + i])
    return least.view(np.int64)


def _short_blocks(p: Part, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(the open blocks of fewer than run tokens, their hashes)."""
    starts = np.flatnonzero(np.append(True, p.block[1:] != p.block[:-1])[: len(p.block)])
    if not len(starts):
        return starts, starts
    sizes = np.diff(np.append(starts, len(p.block)))
    place = np.arange(len(p.block)) - np.repeat(starts, sizes)
    hashes = shingles.mix(np.add.reduceat(shingles.mix(p.hashes + place.astype(np.uint64) * shingles._STEP), starts) ^ np.uint64(0xA5A5A5A5))
    short = (p.block_kind[p.block[starts]] == IS_OPEN) & (sizes < run)
    return p.block[starts][short], hashes[short].view(np.int64)


def _summed(keys: np.ndarray, copies: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Of classes of rows (from starts on, in order): key, least and greatest page, kinds, least and greatest page where the kind is main."""
    if not len(starts):
        return {n: np.empty(0, np.int64) for n in ("run", "low", "high", "bits", "main_low", "main_high")}
    main = bits == IS_MAIN
    return {
        "run": keys[starts],
        "low": np.minimum.reduceat(copies, starts),
        "high": np.maximum.reduceat(copies, starts),
        "bits": np.bitwise_or.reduceat(bits, starts),
        "main_low": np.minimum.reduceat(np.where(main, copies, _GREATEST), starts),
        "main_high": np.maximum.reduceat(np.where(main, copies, _LEAST), starts),
    }


#: What is told of classes of equal runs: they go from main blocks; from open ones, as chrome; from open ones, unless confirmed; they are an article's.
TOLD = ("overruled", "chrome", "bare", "confirmed")


def _told(x: dict) -> dict:
    """TOLD from what _summed or the whole host has; for arrays and for columns alike."""
    repeated, chrome, main = x["low"] != x["high"], x["bits"] % 4 >= IS_CHROME, x["bits"] % 2 == IS_MAIN
    said = repeated & chrome & (x["main_low"] < x["main_high"]), repeated & chrome, repeated & ~chrome & ~main, repeated & ~chrome & main
    return dict(zip(TOLD, said, strict=True))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(keys)])


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each value its place in the sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    found = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[found] == values, found, -1)


def boilerplate(p: Part, run: int = RUN, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Which tokens are boilerplate. known: what holds on the whole host for runs and short blocks (by hash, sorted)."""
    copies, kinds = p.spread(p.copies[p.page]), p.spread(p.block_kind[p.block])
    said = {n: np.zeros(p.length, bool) for n in TOLD}
    order, starts = _classes(p, run)
    if len(order):
        sizes = np.diff(np.append(starts, len(order)))
        for n, x in _told(_summed(order, copies[order], kinds[order], starts)).items():
            said[n][order] = np.repeat(x, sizes)
    blocks_, hashes = _short_blocks(p, run)
    gone = np.zeros(len(p.block_page), bool)
    if len(blocks_):
        order, starts = _grouped(hashes)
        pages = p.copies[p.block_page[blocks_]][order]
        gone[blocks_[order]] = np.repeat(np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts), np.diff(np.append(starts, len(order))))
    if known is not None and len(known["run"]):
        places = _whole(p, run)
        found = _in(_windows(p, run)[places].view(np.int64), known["run"])
        told = found >= 0
        for n in TOLD:
            said[n][places[told]] = known[n][found[told]]
        gone[blocks_[_in(hashes, known["run"]) >= 0]] = True

    def covered(starts: np.ndarray) -> np.ndarray:
        """The tokens in runs that start where told."""
        cover = np.zeros(p.length + run + 1, np.int64)
        hit = np.flatnonzero(starts)
        cover[hit] += 1
        cover[hit + run] -= 1
        return np.cumsum(cover)[p.at] > 0

    of_main, of_open = kinds == IS_MAIN, kinds == IS_OPEN
    return covered(of_main & said["overruled"]) | covered(of_open & said["chrome"]) | (covered(of_open & said["bare"]) & ~covered(of_open & said["confirmed"])) | gone[p.block]


def main_text(raw: bytes, letters: str, gone: np.ndarray | None = None) -> str:
    """The main text of a page from its blocks (one a line), their kinds and which of its tokens are boilerplate."""
    lines = raw.decode().split("\n") if letters else []
    if gone is not None and gone.any():
        words = [(k, w) for k, line in zip(letters, lines, strict=True) for w in line.split(" ")]
        kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
    else:
        kept = list(zip(letters, lines, strict=True))
    count = lambda kind: sum(x.count(" ") + 1 for k, x in kept if k == kind)
    main = count(MAIN)
    wanted = MAIN if main and main >= LITTLE * (main + count(OPEN)) else MAIN + OPEN
    return " ".join(x for k, x in kept if k in wanted)


def texts_of(p: Part, gone: np.ndarray) -> list[str]:
    """The main text of each page of a part that holds whole pages."""
    ends = np.searchsorted(p.page, np.arange(len(p.texts) + 1))
    return [main_text(raw, k, gone[a:b]) for raw, k, a, b in zip(p.texts, p.kinds, ends[:-1], ends[1:], strict=True)]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, page_id, url, host, html) to the same with packed blocks, their kinds and copy for html; copy is equal for equal main and open text."""
    for batch in batches:
        packed, kinds, copies = [], [], []
        for page in batch.column(4):
            found = blocks(page.as_py())[1]
            packed.append(zlib.compress("\n".join(t for _, t in found).encode("utf-8", "replace")))  # blocks hold no line ends
            kinds.append("".join(k for k, _ in found))
            content = " ".join(t for k, t in found if k != CHROME)
            copies.append(int.from_bytes(hashlib.blake2b(content.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True))
        new = [pa.array(packed, pa.binary()), pa.array(kinds, pa.string()), pa.array(copies, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], names=["rid", "page_id", "url", "host", "packed", "kinds", "copy"])


def _runs(batch: pa.RecordBatch, run: int) -> tuple[Part, np.ndarray, np.ndarray, np.ndarray]:
    """(the pages (host, packed, kinds) as a part, places of runs, their fingerprints mixed with the host, their kinds)."""
    p = part([zlib.decompress(x) for x in batch.column("packed").to_pylist()], batch.column("kinds").to_pylist())
    places = _whole(p, run)
    hosts = np.array([zlib.crc32((h or "").encode()) for h in batch.column("host").to_pylist()], np.uint64)
    prints = _fingerprints(p, run, places).view(np.uint64) ^ shingles.mix(p.spread(hosts[p.page])[places])
    return p, places, prints, p.spread(p.block_kind[p.block])[places]


def _asked_prints(run: int):
    """(host, packed, kinds) to the fingerprints of chrome and open runs."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, prints, kinds = _runs(batch, run)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(prints[kinds != IS_MAIN]).view(np.int64))], names=["print"])

    return listed


def _sent(run: int, bits):
    """(rid, host, packed, kinds, copy) to the pages as their host's suffix array needs them: chrome and open blocks, and stretches of main whose fingerprints are in the filter. Pages without chrome and open blocks, and without such stretches, send nothing."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")
        for batch in batches:
            p, places, prints, kinds = _runs(batch, run)
            hit = places[(kinds == IS_MAIN) & (on[prints & np.uint64(len(on) - 1)] == 1)]
            cover = np.zeros(p.length + run + 1, np.int64)
            cover[hit] += 1
            cover[hit + run] -= 1
            wanted = (np.cumsum(cover)[p.at] > 0) | (p.block_kind[p.block] != IS_MAIN)
            ends = np.searchsorted(p.page, np.arange(len(p.texts) + 1))
            rows, packed, letters, firsts, sizes = [], [], [], [], []
            for i in range(len(p.texts)):
                here = np.flatnonzero(wanted[ends[i] : ends[i + 1]]) + ends[i]
                if not len(here):
                    continue
                # pieces: tokens that follow one another in a block
                cuts = np.flatnonzero((np.diff(here) != 1) | (np.diff(p.block[here]) != 0)) + 1
                first, last = here[np.append(0, cuts)], here[np.append(cuts, len(here)) - 1]
                starts = np.searchsorted(p.block, p.block[first])
                lines, base = p.texts[i].decode().split("\n"), int(np.searchsorted(p.block_page, i))
                text = []
                for a, b, s in zip(first.tolist(), last.tolist(), starts.tolist(), strict=True):
                    line = lines[p.block[a] - base]
                    text.append(" ".join(line.split(" ")[a - s : b - s + 1]) if p.block_kind[p.block[a]] == IS_MAIN else line)
                data = "\n".join(text).encode()
                rows.append(i)
                packed.append(zlib.compress(data))
                letters.append("".join(p.kinds[i][p.block[a] - base] for a in first.tolist()))
                firsts.append((first - ends[i]).astype(np.int32).tobytes())
                sizes.append(len(data) + PAGE_BYTES)
            some = batch.take(pa.array(rows, pa.int64()))
            columns = [some.column(n) for n in ("rid", "page_id", "url", "host", "copy", "marked")]
            new = [pa.array(packed, pa.binary()), pa.array(letters, pa.string()), pa.array(firsts, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=["rid", "page_id", "url", "host", "copy", "marked", "packed", "kinds", "firsts", "size"])

    return send


def _part(group: pa.Table) -> Part:
    firsts = [np.frombuffer(x, np.int32) for x in group["firsts"].to_pylist()]
    return part([zlib.decompress(x) for x in group["packed"].to_pylist()], group["kinds"].to_pylist(), group["copy"].to_pylist(), firsts)


def _listed(group: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(next(iter(columns.values())))
    keys = {k: np.full(n, group[k][0].as_py(), np.int64) for k in ("hid", "part")}
    return pa.table(keys | columns)


def _listed_fingerprints(run: int):
    """A part of a host to (hid, part, print): the distinct fingerprints of its runs, and its short open blocks."""

    def listed(group: pa.Table) -> pa.Table:
        p = _part(group)
        return _listed(group, {"print": np.unique(np.concatenate((_fingerprints(p, run, _whole(p, run)), _short_blocks(p, run)[1])))})

    return listed


def _listed_runs(run: int):
    """A part of a host, and the fingerprints that it shares with other parts, to (hid, part, run, low, high, bits, main_low, main_high)."""

    def listed(group: pa.Table, shared: pa.Table) -> pa.Table:
        if not group.num_rows or not shared.num_rows:
            return pa.schema([(n, pa.int64()) for n in ("hid", "part", "run", "low", "high", "bits", "main_low", "main_high")]).empty_table()
        p, prints = _part(group), np.sort(shared["print"].to_numpy())
        places = _whole(p, run)
        places = places[_in(_fingerprints(p, run, places), prints) >= 0]
        blocks_, hashes = _short_blocks(p, run)
        common_ = _in(hashes, prints) >= 0
        keys = np.concatenate((_windows(p, run)[places].view(np.int64), hashes[common_]))
        copies = np.concatenate((p.spread(p.copies[p.page])[places], p.copies[p.block_page[blocks_[common_]]]))
        bits = np.concatenate((p.spread(p.block_kind[p.block])[places], np.full(int(common_.sum()), IS_OPEN)))
        order, starts = _grouped(keys)
        return _listed(group, _summed(keys[order], copies[order], bits[order], starts))

    return listed


def _judged(run: int):
    """A part of a host, and what the host says about its runs, to (rid, page_id, url, text, gone): the text of pages that mark no main content, and which tokens go from others."""

    def judge(group: pa.Table, known: pa.Table) -> pa.Table:
        p = _part(group)
        order = np.argsort(known["run"].to_numpy())
        gone = boilerplate(p, run, {n: np.asarray(known[n])[order] for n in ("run", *TOLD)})
        ends = np.searchsorted(p.page, np.arange(len(p.texts) + 1))
        texts, cuts = [], []
        for raw, kinds, a, b in zip(p.texts, p.kinds, ends[:-1], ends[1:], strict=True):
            marked = bool(group["marked"][len(texts)].as_py())
            cut = p.position[a:b][gone[a:b]].astype(np.int32)
            texts.append(None if marked else main_text(raw, kinds, gone[a:b]))
            cuts.append(cut.tobytes() if marked and len(cut) else None)
        return pa.table({"rid": group["rid"], "page_id": group["page_id"], "url": group["url"], "text": pa.array(texts, pa.string()), "gone": pa.array(cuts, pa.binary())})

    return judge


def _marked_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, packed, kinds, gone) to (page_id, url, text)."""
    for batch in batches:
        out = []
        for packed, kinds, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            raw, gone = zlib.decompress(packed), None
            if cut is not None:
                gone = np.zeros(raw.count(b" ") + raw.count(b"\n") + 1, bool)
                gone[np.frombuffer(cut, np.int32)] = True
            out.append(main_text(raw, kinds, gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _filter(prints: DataFrame):
    """A broadcast filter with a bit on for each of the prints: at most MOST_BITS / 32768 rows come to the driver, whatever the input."""
    n = prints.agg(F.approx_count_distinct("print")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_X * n).bit_length()))
    bit = F.col("print").bitwiseAND(F.lit(bits - 1))
    maps = prints.groupBy(F.shiftright(bit, 15).alias("at")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("map"))
    out = bytearray(bits // 8)
    for r in maps.toLocalIterator():
        out[r.at * 4096 : (r.at + 1) * 4096] = r.map
    return prints.sparkSession.sparkContext.broadcast(bytes(out))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", run: int = RUN, part_bytes: int = PART_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null or empty page has the empty text. Pages without a host make up a
    host of their own. Repeated rows stay, but count as one page. n_chars
    counts code points; no page is cut. Other columns of pages are not read; an
    empty table gives an empty table.
    """
    kinds = {c: pages.select(c).schema[0].dataType.simpleString() for c in (page_id, url)}
    ids = f"page_id {kinds[page_id]}, url {kinds[url]}"
    own = [F.col(page_id).alias("page_id"), F.col(url).alias("url")]
    # rid is only ever read from the table that holds it
    read = pages.select(F.monotonically_increasing_id().alias("rid"), *own, F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.col(body).alias("html"))
    streams = common.written(read.mapInArrow(_streams, f"rid long, {ids}, host string, packed binary, kinds string, copy long"), "page-streams")
    marked = F.contains("kinds", F.lit(MAIN)) | ~F.contains("kinds", F.lit(OPEN))
    beside = streams.where(F.col("kinds").rlike(f"[{CHROME}{OPEN}]"))
    asked = common.written(beside.select("host", "packed", "kinds").mapInArrow(_asked_prints(run), "print long"), "asked-prints")
    sent = streams.withColumn("marked", marked).mapInArrow(_sent(run, _filter(asked)), f"rid long, {ids}, host string, copy long, marked boolean, packed binary, kinds string, firsts binary, size long")
    sent = common.written(sent, "sent-streams")
    sizes = sent.groupBy("host").agg(F.ceil(F.sum("size") / part_bytes).cast("long").alias("parts")).where("parts > 1")
    large = common.written(sizes.select("host", "parts", F.monotonically_increasing_id().alias("hid")), "large-hosts")
    dealt = sent.join(large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0)))
    several = dealt.where("hid IS NOT NULL").select("hid", "part", "packed", "kinds", "copy", "firsts")
    prints = several.groupBy("hid", "part").applyInArrow(_listed_fingerprints(run), "hid long, part long, print long")
    # a part lists a key once, so that a window holds no more rows than the host has parts
    same = Window.partitionBy("hid", "print")
    shared = prints.withColumn("least", F.min("part").over(same)).withColumn("most", F.max("part").over(same)).where("least <> most").select("hid", "part", "print")
    runs = several.groupBy("hid", "part").cogroup(shared.groupBy("hid", "part")).applyInArrow(_listed_runs(run), "hid long, part long, run long, low long, high long, bits long, main_low long, main_high long")
    of_run = Window.partitionBy("hid", "run")
    whole = {"low": F.min, "high": F.max, "bits": F.bit_or, "main_low": F.min, "main_high": F.max}
    told = runs.select("hid", "part", "run", *(f(c).over(of_run).alias(c) for c, f in whole.items())).where("low <> high")
    flags = [x.alias(n) for n, x in _told({c: F.col(c) for c in whole}).items()]
    known = told.select("hid", "part", "run", *flags).join(large.select("hid", "host"), "hid").select("host", "part", "run", *TOLD)
    mine = dealt.select("host", "part", "rid", "page_id", "url", "packed", "kinds", "copy", "firsts", "marked")
    judged = mine.groupBy("host", "part").cogroup(known.groupBy("host", "part")).applyInArrow(_judged(run), f"rid long, {ids}, text string, gone binary")
    judged = common.written(judged.where("text IS NOT NULL OR gone IS NOT NULL"), "judged-pages")
    gone = judged.where("gone IS NOT NULL").select("rid", "gone")
    rest = streams.where(marked).select("rid", "page_id", "url", "packed", "kinds")
    rest = rest.withColumn("gone", F.lit(None).cast("binary")) if gone.isEmpty() else rest.join(gone, "rid", "left")
    texts = rest.select("page_id", "url", "packed", "kinds", "gone").mapInArrow(_marked_texts, f"{ids}, text string")
    return texts.unionByName(judged.where("text IS NOT NULL").select("page_id", "url", "text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; see extract for nulls, repeated rows and empty tables."""
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op9_host_suffix_array": op9_host_suffix_array}
ORACLE: dict[str, str] = {}
