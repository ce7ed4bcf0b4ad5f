"""Main text of web pages by a host suffix array over what the markup leaves.

Pages are read as blocks in page order. A page's candidates are the blocks inside its article or main elements, without notices, adverts,
forms and comments that the markup names; where it has none, the blocks outside menus, headers, footers and the like. The
host decides on all candidates: their token streams are laid end to end, and all suffixes are brought together by their first tokens, the
leading part of a suffix array, sharded by host and key. Suffixes that meet are a repeated substring. It is boilerplate if at least half of the host's pages
hold it and these otherwise differ; blocks that such substrings cover go, the unique runs stay. An article's headings and its page's title are its own, however many articles share them.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LONG = 8  # tokens that a repeated substring has at least
COVERED = 0.5  # share of a block's tokens from which on it goes
TEASER = 0.25  # share of the text outside chrome that the article has at least
SHARE = 0.5  # share of a host's distinct pages that boilerplate is on at least; below, a repeated run is what articles have in common
ALIKE = 0.8  # mean resemblance of the pages that hold a substring, from which on they are copies of each other
SIGNS = 256  # bits of a page's sketch
SHARD_CHARS = 16_000_000  # of HTML whose suffixes one group holds
HOST_CELLS = 1 << 16  # in which hosts are sized
FLAGS = 1 << 23  # in which pages with repeated substrings are marked

_rng = np.random.Generator(np.random.PCG64(11))
POWERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLOTS = _rng.integers(0, 1 << 63, SIGNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.DOTALL)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.DOTALL)
NAME = re.compile(r"[a-z]+", re.IGNORECASE)
HEADING = re.compile("h[1-6]")
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What ends an open element of the first kind when it begins.
ENDS = {
    "p": BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
CHROME = frozenset("nav header footer aside form button select dialog menu head search fieldset datalist audio video map".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer copyright comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login pagination pager skip toolbar widget".split()
)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre".split())


class Page:
    """A page's blocks: (text, inside an article or main element, heading), and its title."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.title = ""
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool, bool]] = []  # element, whether in chrome, whether in the article
        self.read(source)

    def flush(self, chrome: bool, inside: bool) -> None:
        text = " ".join(markup.unescape("".join(self.parts)).split()) if self.parts else ""
        self.parts.clear()
        if text and not chrome:
            self.blocks.append((text, inside, any(HEADING.fullmatch(x[0]) for x in self.stack)))

    @staticmethod
    def kind(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
        """Whether the element is chrome, and whether it marks the article."""
        words, tokens, role, hidden = [], [], "", False
        if attributes.strip():
            for key, *values, bare in ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if bare or key.lower() == "aria-hidden" and value.lower() == "true":
                    hidden = True
                elif key.lower() in ("class", "id"):
                    tokens += value.lower().split()
                    words += [w.lower() for w in NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))]
                elif key.lower() == "role":
                    role = value.lower()
        marks = name in ("article", "main") or role in ("main", "article")
        named = set(tokens if inside and name in TEXT else words)  # within the article, a part of a class doesn't name a paragraph
        own_article = marks and name == "article" and not {"comment", "comments", "reply", "ad", "related"} & named
        by_name = bool(CHROME_WORDS & named) and name not in ("html", "body", "main") and not own_article
        chrome = hidden or name in CHROME or role in CHROME_ROLES or by_name
        return chrome, marks

    def read(self, source: str) -> None:
        at, stack = 0, self.stack
        chrome = inside = False
        while True:
            found = TOKEN.search(source, at)
            if found is None:
                self.parts.append(source[at:])
                break
            self.parts.append(source[at : found.start()])
            at = found.end()
            closing, name, attributes = found.groups()
            if name is None:
                continue
            name = name.lower()
            if not closing and name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                if name == "title" and not self.title:
                    self.title = " ".join(markup.unescape(source[at : end.start() if end else len(source)]).split())
                at = end.end() if end else len(source)
                continue
            block = name in BLOCK
            if not block and not attributes.strip() and not closing and name not in CHROME:
                if name in VOID:
                    self.parts.append(" " if name == "br" else "")
                continue  # plain inline elements change nothing
            if closing:
                if any(x[0] == name for x in stack):
                    self.flush(chrome, inside)
                    while stack.pop()[0] != name:
                        pass
                    chrome, inside = stack[-1][1:] if stack else (False, False)
                elif block:
                    self.flush(chrome, inside)
                continue
            if name in VOID:
                if block:
                    self.flush(chrome, inside)
                elif name == "br":
                    self.parts.append(" ")
                continue
            if block:
                self.flush(chrome, inside)
                while stack and name in ENDS.get(stack[-1][0], ()):
                    stack.pop()
                    chrome, inside = stack[-1][1:] if stack else (False, False)
            own, marks = self.kind(name, attributes, inside)
            if name == "header" and inside:
                own = False  # an article's heading is its own
            if not block and not own and not marks:
                continue
            if not block:
                self.flush(chrome, inside)
            chrome, inside = chrome or own, inside or marks
            stack.append((name, chrome, inside))
        self.flush(chrome, inside)


def candidates(source: str) -> list[tuple[str, bool]]:
    """The article's blocks, and of each whether it is the page's own in any case: a heading of the article, or the page's title.

    If the markup encloses no article, or one with less than TEASER of the text outside chrome, all blocks outside chrome.
    """
    page = Page(source)
    within = sum(len(t) for t, inside, _ in page.blocks if inside)
    enclosed = within > 0 and within >= TEASER * sum(len(t) for t, *_ in page.blocks)
    return [(t, inside and heading or t == page.title) for t, inside, heading in page.blocks if inside or not enclosed]


def marked_text(source: str) -> str:
    return "\n".join(t for t, _ in candidates(source))


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z+]*:?//", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]


def host_cell(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host) % HOST_CELLS


def numbers(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))


def heads_of(hashed: np.ndarray, long: int) -> np.ndarray:
    """A number for the first `long` tokens of each suffix that has so many."""
    n = max(0, len(hashed) - long + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(long):
        out = (out + hashed[j : j + n]) * POWERS[j % len(POWERS)]
    return out ^ (out >> np.uint64(31))


def sketch(hashed: np.ndarray) -> np.ndarray:
    """A bit of the least number of each slot over the distinct tokens: two pages agree in a bit with probability (1 + resemblance) / 2."""
    distinct = np.unique(hashed)
    least = np.full(SIGNS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(distinct), 2048):
        least = np.minimum(least, (distinct[i : i + 2048, None] * SLOTS).min(axis=0))
    return np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool))


def boilerplate(heads: np.ndarray, page: np.ndarray, keys: np.ndarray, streams: np.ndarray, signs: np.ndarray, alike: float = ALIKE, share: float = SHARE) -> np.ndarray:
    """Which suffixes begin a substring that repeats over the given share of all distinct pages, and over pages that otherwise differ.

    heads and page (an index) are of suffixes; keys, streams and signs of pages. Equal streams count as one page. The sum over a bit of all pages
    that hold a substring, taken as +1 and -1, gives their mean resemblance over all pairs without meeting pairs.
    """
    _, stream = np.unique(streams, return_inverse=True)
    _, key = np.unique(keys, return_inverse=True)
    order = np.lexsort((stream[page], heads))
    h, s, p = heads[order], stream[page][order], page[order]
    out = np.zeros(len(heads), dtype=bool)
    if not len(h):
        return out
    new = np.r_[True, h[1:] != h[:-1]]
    starts = np.flatnonzero(new)
    k = key[p]
    several = (np.minimum.reduceat(k, starts) < np.maximum.reduceat(k, starts)) & (np.minimum.reduceat(s, starts) < np.maximum.reduceat(s, starts))
    group = np.cumsum(new) - 1
    once = (new | np.r_[True, s[1:] != s[:-1]]) & several[group]
    if not once.any():
        return out
    g, held = group[once], p[once]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    n = np.diff(np.r_[first, len(g)]).astype(np.float64)
    squares = np.zeros(len(n))
    for byte in range(signs.shape[1]):
        ones = np.add.reduceat(np.unpackbits(signs[held, byte][:, None], axis=1).astype(np.int64), first, axis=0)
        squares += ((2 * ones - n[:, None]) ** 2).sum(axis=1)
    resemblance = (squares / (8 * signs.shape[1]) - n) / (n * (n - 1))
    gone = np.zeros(len(starts), dtype=bool)
    gone[g[first]] = (resemblance < alike) & (n >= share * (stream.max() + 1))
    out[order] = gone[group]
    return out


def unique_runs(blocks: list[tuple[str, bool]], repeated: np.ndarray, long: int = LONG, covered: float = COVERED) -> str:
    """The page's own blocks, and those of which less than the covered share lies in substrings that begin with one of the repeated heads."""
    words = [b.split() for b, _ in blocks]
    found = np.flatnonzero(np.isin(heads_of(numbers([t for b in words for t in b]), long) & np.uint64(0xFFFFFFFFFF), repeated))
    cover = np.zeros(sum(map(len, words)) + 1, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + long, -1)
    total = np.r_[0, np.cumsum(np.cumsum(cover) > 0)]
    ends = np.cumsum([0, *map(len, words)])
    return "\n".join(b for (b, own), i, j in zip(blocks, ends[:-1], ends[1:], strict=True) if own or total[j] - total[i] < covered * (j - i))


def main_text(pages: DataFrame, long: int = LONG, covered: float = COVERED, shard_chars: int = SHARD_CHARS, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of pages(page_id, url, html).

    Character references are decoded; white space inside a block becomes one space; blocks are joined in page order by one line feed. A null or empty html,
    or one without text, gives the empty text. Rows that repeat page_id and url are one page to the host, and so are pages of equal token streams; each gives a row. Null urls are one host.
    All pages take part in their host's suffix array. Hosts are sized in a fixed number of cells, and a large one's suffixes are dealt by
    their leading tokens to as many groups as its size asks for: a group has a bounded share of the host's suffixes, but for those of one run that all its pages hold. The pages that a
    group knows, those with a suffix there, stand for the host's. Suffixes travel as packed differences of
    40-bit numbers beside a group's pages. Only pages that a fixed-size bitmap marks as having repeated substrings are joined with them.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url").alias("key"))

    @F.pandas_udf("int")
    def cell_of(urls: pd.Series) -> pd.Series:
        return pd.Series([host_cell(host_of(u)) for u in urls], dtype=np.int32)

    sizes = np.zeros(HOST_CELLS, dtype=np.int64)
    for r in pages.groupBy(cell_of("url").alias("cell")).agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("chars")).collect():
        sizes[r["cell"]] = r["chars"]
    shards = spark.sparkContext.broadcast(1 + sizes // shard_chars)

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed: dict[tuple[str, int], list] = {}
            for url, source, key in zip(batch["url"], batch["html"], batch["key"], strict=True):
                tokens = [t for b, _ in candidates(source or "") for t in b.split()]
                if len(tokens) < long:
                    continue
                hashed = numbers(tokens)
                heads, host = np.unique(heads_of(hashed, long)), host_of(url)
                page = (np.int64(key), xxhash.xxh3_64_intdigest(hashed.tobytes()), sketch(hashed).tobytes())
                parts = int(shards.value[host_cell(host)])
                to = (heads >> np.uint64(40)) % np.uint64(parts)
                for part in range(parts) if parts < 64 else np.unique(to).tolist():
                    own = heads[to == part] if parts > 1 else heads
                    if len(own):
                        packed.setdefault((host, int(part)), []).append((page, np.diff(np.sort(own & np.uint64(0xFFFFFFFFFF)), prepend=np.uint64(0))))
            rows = []
            for (host, part), found in packed.items():
                values = np.concatenate([x for _, x in found])
                keys, streams = np.array([p[0] for p, _ in found], dtype=np.int64), np.array([p[1] for p, _ in found], dtype=np.uint64)
                counts = np.array([len(x) for _, x in found], dtype=np.int32)
                low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint8)
                signs = b"".join(p[2] for p, _ in found)
                rows.append((host, part, keys.tobytes(), streams.tobytes(), signs, counts.tobytes(), low.tobytes(), zlib.compress(high.tobytes(), 1)))
            if rows:
                yield pd.DataFrame(rows, columns=["host", "part", "keys", "streams", "signs", "counts", "low", "high"])

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        keys, streams, counts, low = (np.frombuffer(b"".join(group[c]), dtype=t) for c, t in (("keys", np.int64), ("streams", np.uint64), ("counts", np.int32), ("low", np.uint32)))
        high = np.frombuffer(b"".join(map(zlib.decompress, group["high"])), dtype=np.uint8)
        signs = np.frombuffer(b"".join(group["signs"]), dtype=np.uint8).reshape(len(keys), -1)
        total = np.cumsum(np.r_[np.uint64(0), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)])
        heads = total[1:] - np.repeat(total[np.cumsum(counts) - counts], counts)
        page = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        gone = boilerplate(heads, page, keys, streams, signs, share=share)
        heads, page = heads[gone], page[gone]
        at, first = np.unique(page, return_index=True)
        return pd.DataFrame({"key": keys[at], "heads": [x.tobytes() for x in np.split(heads, first[1:])] if len(at) else []})

    suffix = pages.mapInPandas(suffixes, "host string, part int, keys binary, streams binary, signs binary, counts binary, low binary, high binary")
    found = cut(suffix.groupBy("host", "part").applyInPandas(repeated, "key long, heads binary"))
    bit = F.pmod("key", F.lit(FLAGS))
    bitmap = np.zeros(FLAGS // 8, dtype=np.uint8)
    for r in found.groupBy(F.bitmap_bucket_number(bit + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits")).collect():
        at = (r["bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    flags = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def flagged(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy() & (FLAGS - 1)
        return pd.Series((flags.value[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool))

    @F.pandas_udf("string")
    def text_alone(sources: pd.Series) -> pd.Series:
        return pd.Series([marked_text(s or "") for s in sources], dtype=object)

    @F.pandas_udf("binary")
    def packed_text(sources: pd.Series) -> pd.Series:
        """The blocks a line each, own ones after a mark."""
        lines = ("\n".join("!" * own + " " * (not own) + b for b, own in candidates(s or "")) for s in sources)
        return pd.Series([zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in lines], dtype=object)

    @F.pandas_udf("string")
    def text_beside(texts: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for packed, found in zip(texts, heads, strict=True):
            lines = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
            blocks = [(x[1:], x[0] == "!") for x in lines if x]
            out.append(unique_runs(blocks, np.frombuffer(b"".join(found if found is not None else []), dtype=np.uint64), long, covered))
        return pd.Series(out, dtype=object)

    alone = pages.where(~flagged("key")).select("page_id", "url", text_alone("html").alias("text"))
    beside = pages.where(flagged("key")).select("page_id", "url", "key", packed_text("html").alias("packed"))
    decided = beside.join(found.groupBy("key").agg(F.collect_list("heads").alias("heads")), "key", "left").select("page_id", "url", text_beside("packed", "heads").alias("text"))
    return alone.unionByName(decided).withColumn("n_chars", F.char_length("text").cast("long"))
