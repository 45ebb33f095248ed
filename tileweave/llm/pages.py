"""Main text of HTML pages: structure first, then what a host's pages repeat.

Blocks of running text are cut out of the markup, without the parts that structure marks as furniture. A host's
pages are dealt into shards that only bound memory. The token streams of a shard are concatenated and their suffixes
ranked by prefix doubling; suffixes of one rank share ``DEPTH`` tokens or more, and the substrings that distinct pages
of the host repeat are what runs of such suffixes cover. The shards' ranks are merged by the hash of their tokens. Frequent substrings are
boilerplate, and the tokens between stay. Those that are mostly
found on pages which consist of frequent ones by more than half are text of copies and stay on those.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tileweave.session import cut_lineage

#: Tokens of a repeated substring; share of a host's different pages (and least number) it must occur in.
DEPTH, SHARE, LEAST = 16, 0.2, 5
#: A page with a larger share of repeated tokens may be a copy of other pages, which is not furniture.
WHOLE = 0.5
#: Hosts are dealt into shards of about so many pages and characters of text.
SHARD_PAGES, SHARD_CHARS = 400, 4_000_000
#: Lists of up to so many hosts and hashes are broadcast (some 50 bytes a host, 8 a hash); more are joined by shuffle.
BROADCAST_HOSTS, BROADCAST_HASHES = 200_000, 4_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("head nav header footer aside form menu button select option noscript template iframe object svg canvas dialog audio video figure-tools".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar "
    "sidenav menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies share sharing social related recommended newsletter "
    "subscribe subscription popup modal overlay masthead widget widgets toolbar pagination pager login signup copyright disclaimer footer skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSED_BY_BLOCK = frozenset(("p",))
#: Elements that may hold articles of others (comments, teasers).
_OPEN_ENDED = frozenset(("section", "aside", "ul", "ol", "li", "article", "template", "dialog"))

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=/?[a-zA-Z])[^<]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PARTS = re.compile(r"[a-z]+")


def _furniture(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is furniture by tag, state, role or name. Inside an article only whole class names and ids count."""
    if name in _FURNITURE:
        return True
    if not rest.strip(" /"):
        return False
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if found.get("role", "") in _ROLES:
        return True
    named = found.get("class", "") + " " + found.get("id", "")
    # Pages and articles are what is looked for, whatever they are called.
    return name not in ("html", "body", "main", "article") and not _NAMES.isdisjoint(named.split() if inside else _NAME_PARTS.findall(named))


def blocks_of(page: str | None) -> list[str]:
    """The blocks of a page's main text in order.

    Text of the longest ``article`` (else ``main``, else the body) counts, without elements that are furniture by tag,
    role, class or id; of equally long articles the first. Headings inside an article's header stay. End tags without a start are ignored;
    unclosed elements end with the page. ``<br>`` is white space.
    """
    page = page or ""
    out: dict[int, list[str]] = {0: [], 1: []}
    articles: list[list[str]] = []
    stack: list[tuple[str, bool]] = []
    buffer: list[str] = []
    hidden, rank, at, seen = 0, 0, 0, False

    def flush():
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            (articles[-1] if rank == 2 else out[rank]).append(text)

    def shown():
        if not hidden:
            return True
        return hidden == 1 and rank == 2 and any(n == "header" and h for n, h in stack) and any(n in _HEADINGS for n, _ in stack)

    def where():
        names = [n for n, _ in stack]
        return 2 if "article" in names else 1 if "main" in names else 0

    for m in _MARKUP.finditer(page):
        if m.start() > at and shown():
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m["end"]:
            if any(n == name for n, _ in stack):
                while True:
                    gone, was = stack.pop()
                    hidden -= was
                    if gone == name:
                        break
                rank = where()
        elif name not in _VOID:
            if name in _BLOCK and stack and stack[-1][0] in _CLOSED_BY_BLOCK:
                stack.pop()
            skip = _furniture(name, m["rest"] or "", rank == 2)
            if name in ("article", "main") and not skip and not seen and not any(h and n in _OPEN_ENDED for n, h in stack):
                # The first article of a page is not part of furniture that was left open before it.
                stack, hidden = [], 0
                seen = name == "article"
            if name == "article" and not any(n == "article" for n, _ in stack):
                articles.append([])
            if not (m["rest"] or "").endswith("/") or name in _BLOCK:
                stack.append((name, skip))
                hidden += skip
                rank = where()
    if at < len(page) and shown():
        buffer.append(page[at:])
    flush()
    return max(articles, key=lambda blocks: sum(map(len, blocks)), default=None) or out[1] or out[0]


def suffix_ranks(joined: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The rank of the suffix at each position by its first ``depth`` numbers: prefix doubling, 1, 2, 4, ... at a time."""
    rank, reach = np.unique(joined, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(len(rank) - step, 0)] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        reach += step
    return rank


def unique_text(blocks: list[str], covered: np.ndarray, whole: float = WHOLE) -> str:
    """The blocks without covered tokens, joined by line breaks."""
    if not covered.any() or covered.mean() > whole:
        return "\n".join(blocks)
    out, at = [], 0
    for b in blocks:
        tokens = b.split(" ")
        kept = [t for t, c in zip(tokens, covered[at : at + len(tokens)]) if not c]
        at += len(tokens)
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def host_of(url):
    """Host of a url column: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class _Shard:
    """The pages of one row of ``_packed``: the concatenated streams, and of each suffix of ``DEPTH`` tokens or more its page and code.

    Suffixes of equal rank have one code, the hash of their first ``DEPTH`` tokens, which other shards share.
    """

    def __init__(self, blob: bytes, contents: list[int]):
        self.table = pa.ipc.open_stream(blob).read_all()
        self.blocks = [zlib.decompress(p).decode().split("\n") for p in self.table["packed"].to_pylist()]
        tokens = [[t for b in bs for t in b.split(" ")] for bs in self.blocks]
        self.ends = np.cumsum([0] + [len(t) for t in tokens])
        page = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        codes, words = pd.factorize(np.array([t for ts in tokens for t in ts], object))
        runs = max(len(page) - DEPTH + 1, 0)
        self.start = np.flatnonzero(page[:runs] == page[DEPTH - 1 : DEPTH - 1 + runs])
        ranks, first, rank = np.unique(suffix_ranks(codes)[self.start], return_index=True, return_inverse=True)
        word, code = pd.util.hash_array(words, categorize=False), np.zeros(len(ranks), np.uint64)
        for k in range(DEPTH):
            code = code * np.uint64(0x9E3779B97F4A7C15) + word[codes[self.start[first] + k]]
        self.code, self.page = code.view(np.int64)[rank], page[self.start]
        self.content = np.array(contents, np.int64)

    def pairs(self, hit) -> pd.DataFrame:
        """The different runs of ``hit`` by page content."""
        return pd.DataFrame({"code": self.code[hit], "content": self.content[self.page[hit]]}).drop_duplicates()

    def covered(self, hit) -> list[np.ndarray]:
        """For each page, which tokens the runs of ``hit`` cover."""
        edge = np.zeros(self.ends[-1] + 1, np.int64)
        np.add.at(edge, self.start[hit], 1)
        np.add.at(edge, self.start[hit] + DEPTH, -1)
        flags = np.cumsum(edge)[:-1] > 0
        return [flags[a:b] for a, b in zip(self.ends, self.ends[1:])]

    def mostly(self, hit) -> np.ndarray:
        """Whether each page is covered by more than ``WHOLE``."""
        return np.array([c.size > 0 and c.mean() > WHOLE for c in self.covered(hit)], bool)


def _packed(table: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    rows = table.select(["page_id", "url", "packed"]).combine_chunks()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
    return pa.table([table["host"][:1], table["shards"][:1], blob, pa.array([table["content"].to_pylist()], pa.list_(pa.int64()))], names=["host", "shards", "blob", "contents"])


def _shards_with(shards: DataFrame, lists: DataFrame, hashes: int) -> DataFrame:
    """Shards with what their host has in ``lists``; broadcast, unless that is large."""
    return shards.join(F.broadcast(lists) if hashes <= BROADCAST_HASHES else lists, "host", "left")


def _rows(batch: pa.RecordBatch):
    """One row at a time, as each may be large."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _array(values) -> np.ndarray:
    return np.array([] if values is None else values, np.int64)


def _frequent(shards: DataFrame) -> tuple[DataFrame, int]:
    """``host, codes, copied``: the frequent runs of each host, and those of them that are text of copies; and their number."""
    pages = shards.select("host", "shards", F.explode("contents").alias("content")).distinct().groupBy("host", "shards").agg(F.count("*").alias("n"))
    pages = cut_lineage(pages.select("host", F.greatest(F.lit(float(LEAST)), F.col("n") * SHARE).alias("limit"), F.col("shards").alias("over")))

    def local(batches):
        # A run that is frequent in the host has its average share of that in some shard.
        for b in batches:
            for host, limit, over, blob, contents in _rows(b):
                shard = _Shard(blob, contents)
                counts = shard.pairs(slice(None))["code"].value_counts()
                codes = counts.index[counts.to_numpy() >= limit / over].to_numpy(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(codes), pa.string()), pa.array(codes, pa.int64())], names=["host", "code"])

    def listed(rows, *columns):
        lists = cut_lineage(rows.groupBy("host").agg(*columns))
        return lists, lists.agg(F.sum(F.size("codes"))).first()[0] or 0

    placed = _shards_with(shards, pages, pages.count()).select("host", "limit", "over", "blob", "contents")
    lists, size = listed(placed.mapInArrow(local, "host string, code bigint").distinct(), F.collect_list("code").alias("codes"))

    def pairs(batches):
        for b in batches:
            for host, blob, contents, codes in _rows(b):
                shard = _Shard(blob, contents)
                hit = np.isin(shard.code, _array(codes))
                most = shard.content[shard.mostly(hit)]
                found = shard.pairs(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(found), pa.string()), pa.array(found["code"].to_numpy()), pa.array(found["content"].to_numpy()), pa.array(np.isin(found["content"], most))],
                    names=["host", "code", "content", "most"],
                )

    def counted(lists, size):
        rows = _shards_with(shards, lists, size).select("host", "blob", "contents", "codes").where("codes is not null")
        rows = rows.mapInArrow(pairs, "host string, code bigint, content bigint, most boolean")
        return rows.distinct().groupBy("host", "code").agg(F.count("*").alias("n"), F.count_if("most").alias("most"))

    exact = counted(lists, size).join(F.broadcast(pages) if pages.count() <= BROADCAST_HOSTS else pages, "host").where("n >= limit")
    lists, size = listed(exact, F.collect_list("code").alias("codes"))
    # Only with the exact list it is known which pages are mostly made of frequent runs.
    return listed(counted(lists, size), F.collect_list("code").alias("codes"), F.collect_list(F.when(F.col("most") * 2 > F.col("n"), F.col("code"))).alias("copied"))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the main text, blocks joined by line breaks.

    Null html gives an empty text; a null url or one without ``://`` belongs to the empty host; an empty table gives no rows;
    very long pages are read whole. Repeated rows each give a row and count as one page when substrings are counted. Columns besides ``page_id, url,
    html`` are ignored.
    """
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = T.StructType([T.StructField("page_id", kinds["page_id"]), T.StructField("url", T.StringType())])

    packed = T.StructType([schema["page_id"], schema["url"], T.StructField("packed", T.BinaryType()), T.StructField("content", T.LongType())])

    def cut(batches):
        for b in batches:
            blocks = [blocks_of(h.as_py()) for h in b.column(2)]
            content = pd.util.hash_array(np.array([" ".join(x) for x in blocks], object), categorize=False).view(np.int64)
            packs = [zlib.compress("\n".join(x).encode()) for x in blocks]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packs, pa.binary()), pa.array(content)], names=packed.names)

    rows = pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(cut, packed)
    # Shards are sized by the raw pages, so that pages need not be parsed for it.
    sizes = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))
    sizes = sizes.select("host", F.greatest(F.ceil(F.col("n") / SHARD_PAGES), F.ceil(F.coalesce("chars", F.lit(0)) / SHARD_CHARS), F.lit(1)).alias("shards"))
    sizes = cut_lineage(sizes.where(F.col("shards") > 1))
    placed = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(sizes) if sizes.count() <= BROADCAST_HOSTS else sizes, "host", "left")
    # One key, so that the groups are dealt anew and not by host as after a join.
    placed = placed.withColumn("shards", F.coalesce("shards", F.lit(1)))
    shard = F.pmod(F.xxhash64("url", F.col("page_id").cast("string")), F.col("shards"))
    placed = placed.select("host", "shards", "page_id", "url", "packed", "content", F.concat_ws(" ", "host", shard).alias("cell"))
    shards = cut_lineage(placed.groupBy("cell").applyInArrow(_packed, "host string, shards bigint, blob binary, contents array<bigint>"))
    lists, size = _frequent(shards)
    out = T.StructType([schema["page_id"], schema["url"], T.StructField("text", T.StringType())])

    def keep(batches):
        for b in batches:
            for blob, contents, codes, copied in _rows(b):
                shard = _Shard(blob, contents)
                hit = np.isin(shard.code, _array(codes))
                most = shard.mostly(hit)
                # A page of mostly frequent runs loses those that are furniture elsewhere.
                gone = hit & ~(most[shard.page] & np.isin(shard.code, _array(copied)))
                text = pa.array([unique_text(bs, c, 1.0) for bs, c in zip(shard.blocks, shard.covered(gone))], pa.string())
                yield from pa.table([shard.table["page_id"], shard.table["url"], text], names=out.names).to_batches()

    done = _shards_with(shards, lists, size).select("blob", "contents", "codes", "copied").mapInArrow(keep, out)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
