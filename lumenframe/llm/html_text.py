"""Main text of web pages: markup regions, then long substrings repeated across a host's pages.

A page is read as blocks of text. Regions that by their tag, role, class or id hold menus, page headers
and footers, sidebars, notices, adverts, forms, scripts, styles or reader comments give none. Blocks
inside an article (or main) element are the article and stay. All other blocks, beside an article or on
pages without one, are judged by their host: the tokens outside of articles are concatenated to one stream
a page, and all suffixes of a host's streams are brought into order by their first ``RUN`` tokens. Suffixes
that share these adjoin; where they come from distinct pages their run is covered, and runs that overlap
make longer ones. A block whose tokens are covered for the most part is boilerplate, and unique runs stay.
Pages of equal content count as one page, so a copy covers nothing. Suffixes are dealt by host and run,
never by host alone, so hosts have any size and a page's text depends on all pages of its host.

Article blocks aren't judged by repeats: articles share lines and are copied to other addresses, and the
text asked for is the whole article. ``covered_chars`` counts what was removed as covered.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
two line feeds in page order. Null or empty pages, and pages without text, give the empty string.
Unclosed tags end as browsers end them: a paragraph at the next block, a region with its parent.
A very long page is held whole by one task. Repeated rows are kept, each with its text, and null or equal
page_ids and urls don't matter. An empty table gives no rows; extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.textkit import BASE, bounded_batches, mix
from lumenframe.plans.staging import Staged

RUN, COVERED = 8, 0.7
#: Copies of a host's repeated runs for the join, so that a run on most pages isn't one key.
SALTS = 16

# Element names and attribute words of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
APART = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
LOOSE = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notification", "alert", "popup", "modal", "overlay", "comment", "comments", "commentlist", "respond", "disqus", "replies", "sidebar", "aside", "widget", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search",
    "footer", "masthead", "topbar", "toolbar", "pagination", "pager", "skip", "complementary", "contentinfo", "dialog",
}
TALK = {"comment", "comments", "commentlist", "respond", "disqus", "replies", "related", "recommended", "sidebar", "aside", "widget"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _marks(attrs: str) -> tuple[set[str], bool]:
    """Words of an element's class, id and role; whether it is hidden."""
    words, hidden = set(), False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name in ("class", "id", "role"):
            words.update(_WORD.findall(value))
    return words, hidden


FREE, MAIN, REGION = 0, 1, 2


def page_blocks(page: str | None) -> tuple[list[str], list[int]]:
    """(texts, states) of a page's blocks: of an article, of a boilerplate region, or free."""
    texts, states = [], []
    buf: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that matter: (name, "skip" | "talk" | "article" | "")
    skip = talk = body = 0

    def flush() -> None:
        if buf:
            t = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            buf.clear()
            if t:
                texts.append(t)
                states.append(REGION if skip else MAIN if body else FREE)

    def close(k: int) -> None:
        nonlocal skip, talk, body
        while len(stack) > k:
            what = stack[-1][1]
            if what:
                flush()
            stack.pop()
            skip -= what in ("skip", "talk")
            talk -= what == "talk"
            body -= what == "article"

    page, at = page or "", 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    close(k)
                    break
                if stack[k][0] not in LOOSE and name in LOOSE:
                    break
            if name in BLOCKS:
                flush()
            continue
        if name in RAW:
            if m[3].rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "img", "wbr", "input"):
                buf.append("" if name == "wbr" else " ")
            continue
        if name in BLOCKS:
            flush()
            if stack and stack[-1][0] in LOOSE and (stack[-1][0] == name or stack[-1][0] == "p"):
                close(len(stack) - 1)
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        words, hidden = _marks(m[3]) if m[3] else (set(), False)
        main = name in ("article", "main") or "main" in words and name in ("div", "section") and "article" in words
        if main and skip and not talk:
            for k, (_, what) in enumerate(stack):
                if what == "skip":
                    close(k)
                    break
        what = ""
        if words & TALK and not (main and not words & {"comment", "comments"}):
            what = "talk"
        elif not main and (name in APART or hidden or words & WORDS or name == "header" and not body):
            what = "skip" if name != "body" and name != "html" else ""
        elif main:
            what = "article"
        if what:
            flush()
        skip += what in ("skip", "talk")
        talk += what == "talk"
        body += what == "article"
        if name in BLOCKS or what or skip:
            stack.append((name, what))
    flush()
    return texts, states


READ = "row long, host string, page_id long, url string, page long, texts array<string>, states array<int>, runs array<long>"


def stream_runs(texts: list[str], states: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each block outside of articles, hash of the ``RUN`` tokens at each place of their stream).

    A shorter stream is one run.
    """
    words = [t.split() for t, s in zip(texts, states, strict=True) if s != MAIN]
    tokens = np.array([xxhash.xxh3_64_intdigest(w.encode()) for ws in words for w in ws], np.uint64)
    n = max(0, len(tokens) - RUN + 1) or min(1, len(tokens))
    run = np.zeros(n, np.uint64)
    for j in range(min(RUN, len(tokens))):
        run *= BASE
        run += tokens[j : j + n]
    return np.array([len(w) for w in words], np.int64), mix(run).view(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of every page; those of regions only where the page has blocks to judge."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part, kept, runs, pages = batch.slice(lo, 512), [], [], []
            for page in part.column(3).to_pylist():
                texts, states = page_blocks(page)
                runs.append(np.unique(stream_runs(texts, states)[1]).tolist())
                pages.append(xxhash.xxh3_64_intdigest(chr(0).join(texts).encode()) - (1 << 63))
                if FREE not in states:
                    texts, states = [t for t, s in zip(texts, states, strict=True) if s == MAIN], [MAIN] * states.count(MAIN)
                kept.append((texts, states))
            texts, states = zip(*kept, strict=True)
            rows = pa.array(np.arange(row, row + part.num_rows))
            yield pa.RecordBatch.from_arrays([rows, *part.columns[:3], pa.array(pages, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))], ["row", "host", "page_id", "url", "page", "texts", "states", "runs"])
            row += part.num_rows


def covered_blocks(texts: list[str], states: list[int], repeated: set[int]) -> list[bool]:
    """Which blocks are free and lie for the most part in repeated runs."""
    sizes, runs = stream_runs(texts, states)
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    starts = np.flatnonzero([r in repeated for r in runs.tolist()])
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + RUN, len(edge) - 1), -1)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    hits = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[ends])
    outside = iter((hits >= COVERED * sizes).tolist())
    return [s != MAIN and next(outside) and s == FREE for s in states]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, gone = [], []
        for texts, states, repeated in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            covered = covered_blocks(texts, states, set(repeated or ())) if FREE in states else [False] * len(texts)
            out.append("\n\n".join(t for t, s, c in zip(texts, states, covered, strict=True) if s != REGION and not c))
            gone.append(sum(len(t) for t, c in zip(texts, covered, strict=True) if c))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_chars", "covered_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, covered_chars) of every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host")
    read = Staged(pages.select(host, F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_read, READ), "blocks").df
    open_ = read.where(F.array_contains("states", FREE))
    suffixes = read.select("host", "page", F.explode("runs").alias("run"))
    repeated = suffixes.groupBy("host", "run").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last").select("host", "run")
    dealt = repeated.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    hits = open_.select("host", "row", F.explode("runs").alias("run"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")).join(dealt, ["host", "run", "salt"])
    judged = open_.join(hits.groupBy("row").agg(F.collect_list("run").alias("repeated")), "row", "left").select("page_id", "url", "texts", "states", "repeated")
    plain = read.where(~F.array_contains("states", FREE)).select("page_id", "url", "texts", "states", F.lit(None).cast("array<long>").alias("repeated"))
    return judged.union(plain).mapInArrow(_judge, "page_id long, url string, text string, n_chars long, covered_chars long")


def op3_host_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
