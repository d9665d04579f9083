"""Main text of pages: page structure plus differencing against the page of the nearest URL.

A page is cut into lines, one per block. Containers that say what they are (nav, footer, scripts,
elements of class "ad" and so on) are left out. Differencing then decides on every page: pages of a host are
sorted by URL path, each is aligned with its nearest neighbour by longest common subsequence, and lines that
both share are deleted, but for those inside an article. A neighbour that is itself a copy of the page says
nothing about its frame, so the next one is taken, up to the end of the host.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import settle
from motorgrid.operators.skew import cut_by_ranges, running_total
from motorgrid.session import store

# Pages of one host, in order of their paths, that are compared at once; other slices follow where needed.
SLICE_PAGES = 128
# Pages before and after a slice that it sees as well.
OVERLAP = 8
# A neighbour that shares more than this of the article, or of the page if it has none, is a copy.
COPY_SHARE = 0.8

# Elements and class or id words that mark what is not main text.
DROPPED = frozenset((
    "script style noscript template head title nav footer aside form button select option textarea "
    "iframe object embed svg canvas dialog menu menuitem input label fieldset audio video").split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
MARKS = frozenset((
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination popup promo related share sharing sidebar sponsor sponsored "
    "sponsors subscribe subscription toolbar widget widgets").split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen".split())
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
MAIN = frozenset(("article", "main"))

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?i)\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true")
_MARK_WORD = re.compile(r"[a-z0-9]+")


def _dropped(name: str, attrs: str, in_main: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", '""', attrs)):
        return True
    for kind, *values in _ATTR.findall(attrs):
        words = _MARK_WORD.findall("".join(values).lower())
        if kind.lower() == "role":
            if not ROLES.isdisjoint(words):
                return True
        elif not MARKS.isdisjoint(words):
            return True
    return False


def page_lines(html: str) -> list[tuple[str, bool]]:
    """(line, inside an article) per block of the page that its markup does not rule out."""
    lines: list[tuple[str, bool]] = []
    text: list[str] = []
    # Open elements as (name, is dropped, is an article); counts of both.
    stack: list[tuple[str, bool, bool]] = []
    drops = mains = 0

    def flush() -> None:
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append((line, mains > 0))

    def pop(to: int) -> None:
        nonlocal drops, mains
        while len(stack) > to:
            name, dropped, main = stack.pop()
            if name in BLOCKS and not drops:
                flush()
            drops -= dropped
            mains -= main

    pos = 0
    for tag in _TAG.finditer(html):
        if not drops and tag.start() > pos:
            text.append(html[pos:tag.start()])
        pos = tag.end()
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        if tag["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            else:
                if name in BLOCKS and not drops:
                    flush()
            continue
        if name == "br" and not drops:
            text.append(" ")
        if name in CLOSES_P or name in ("li", "td", "th", "tr", "dd", "dt", "option"):
            # An open paragraph, item or cell ends where the next one begins.
            ends = {name} if name in ("li", "td", "th", "tr", "option") else (
                {"dd", "dt"} if name in ("dd", "dt") else {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in BLOCKS and not drops:
            flush()
        if name in VOID or tag["attrs"].rstrip().endswith("/"):
            continue
        dropped, main = _dropped(name, tag["attrs"], mains > 0), name in MAIN
        if dropped and not drops:
            flush()
        stack.append((name, dropped, main))
        drops += dropped
        mains += main
    if not drops:
        text.append(html[pos:])
    flush()
    return lines


def _forward(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``, bit-parallel."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    open_ = full
    for x in a:
        hit = open_ & where.get(x, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    bits = np.unpackbits(np.frombuffer(
        open_.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``, in linear memory."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append(k)
        if i >= k or j >= m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        half = (i + k) // 2
        total = _forward(a[i:half], b[j:m]) + _forward(a[half:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(total.argmax())
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, fixed = [], []
        for html in batch.column("_html"):
            found = page_lines(html.as_py() or "")
            lines.append([x for x, _ in found])
            fixed.append([main for _, main in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("_host"), batch.column("_path"),
             pa.array(lines, pa.list_(pa.string())), pa.array(fixed, pa.list_(pa.bool_()))],
            names=["page_id", "url", "_host", "_path", "_lines", "_fixed"])


def shared_lines(own: list[tuple], other: list[tuple], fixed: list[bool]) -> set[int] | None:
    """Positions of ``own`` that align with ``other``; None if ``other`` is a copy of ``own``.

    Lines are (code, length). Whether it is a copy is judged by the ``fixed`` lines, those inside an
    article, if there are any, else by all.
    """
    both = set(own).intersection(other)
    kept = [i for i, x in enumerate(own) if x in both]
    code = {x: i for i, x in enumerate(both)}
    found = [kept[i] for i in common_lines([code[own[i]] for i in kept], [code[x] for x in other if x in both])]
    judged = fixed if any(fixed) else [True] * len(own)
    same = sum(own[i][1] for i in found if judged[i])
    return None if same > COPY_SHARE * sum(x[1] for x, main in zip(own, judged) if main) else set(found)


def prefix(own: str, other: str) -> int:
    """Length of the common beginning of two paths."""
    return len(os.path.commonprefix((own, other)))


def _search(group: pa.Table) -> pa.Table:
    """For the pages asked for in a slice, the nearest page of a block on a side that is no copy.

    ``_side`` is -1 or 1, the side on which the block lies, or 0 for the slice itself: both sides. ``_gone`` are
    the lines that both share, without those inside an article.
    """
    rows = group.to_pydict()
    order = sorted(range(group.num_rows), key=lambda i: rows["_pos"][i])
    block = [i for i in order if rows["_there"][i]]
    lines = [tuple(zip(codes, sizes)) for codes, sizes in zip(rows["_codes"], rows["_sizes"])]
    out: dict[str, list] = {"_row": [], "_way": [], "_prefix": [], "_gone": [], "_block": []}
    for i in order:
        if not rows["_asked"][i]:
            continue
        own, at, fixed = lines[i], rows["_pos"][i], rows["_fixed"][i]
        seen = {own}
        for way in (-1, 1) if rows["_side"][i] == 0 else (rows["_side"][i],):
            if rows["_way"][i] not in (0, way):
                continue
            for j in block if way > 0 else reversed(block):
                if (rows["_pos"][j] - at) * way <= 0:
                    continue
                if lines[j] in seen:
                    continue
                shared = shared_lines(own, lines[j], fixed)
                if shared is None:
                    seen.add(lines[j])
                    continue
                out["_row"].append(rows["_row"][i])
                out["_way"].append(way)
                out["_prefix"].append(prefix(rows["_path"][i], rows["_path"][j]))
                out["_gone"].append(sorted(k for k in shared if not fixed[k]))
                out["_block"].append(rows["_block"][i])
                break
    return pa.table(out, pa.schema([("_row", pa.int64()), ("_way", pa.int32()), ("_prefix", pa.int32()),
                                    ("_gone", pa.list_(pa.int32())), ("_block", pa.int64())]))


def _frames(parsed: DataFrame, slice_pages: int) -> DataFrame:
    """_row and _gone, the positions of the lines of a page that belong to the host's frame, where there are any.

    Pages of a host stand in order of their paths, in slices of ``slice_pages``; pages without lines have
    nothing to compare and stand aside. The nearest page that is no copy is sought to the left and to the
    right: in the slice itself and the ends of those beside it, then in one slice on each side, then in two
    more, in four more and so on, but only for the pages and sides that have found none. A group holds a
    slice and a block. The side with the longer common path counts, left on ties. Lines are compared by
    64-bit hash and length.
    """
    members = parsed.where(F.size("_lines") > 0)
    keys = members.select("_row", "_host", "_path", F.coalesce("url", F.lit("")).alias("_url"), "page_id")
    order = ["_path", "_url", "page_id", "_row"]
    placed = running_total(cut_by_ranges(keys, ["_host"], order), ["_host"], order, F.col("_piece"), F.lit(1),
                           "_pos").select("_row", "_pos", F.floor(F.col("_pos") / slice_pages).alias("_slice"))
    facts = ["_row", "_pos", "_path", "_codes", "_sizes", "_fixed"]
    members = settle(members.select(
        "_row", "_host", "_path", F.transform("_lines", lambda line: F.xxhash64(line)).alias("_codes"),
        F.transform("_lines", lambda line: F.length(line)).alias("_sizes"), "_fixed").join(placed, "_row"), "members")
    last = members.groupBy("_host").agg(F.max("_slice").alias("_last"))
    # What is still sought: a page, and the side or both (0).
    todo = members.join(last, "_host").select(
        "_row", "_host", "_slice", "_last", F.lit(0).alias("_way"), F.exists("_fixed", lambda main: ~main).alias("_any"))
    edge = min(OVERLAP, slice_pages)
    blocks = F.array_distinct(F.array("_slice", *[
        F.floor((F.col("_pos") + step) / slice_pages) for step in (-edge, edge)]))
    groups = members.withColumn("_block", F.explode(blocks)).select(
        "_host", F.col("_block").alias("_from"), "_block", F.lit(0).alias("_side"), *facts,
        (F.col("_block") == F.col("_slice")).alias("_asked"), F.lit(True).alias("_there"), F.lit(0).alias("_way"))
    found = None
    near, far = 0, 0
    while True:
        hits = groups.groupBy("_host", "_from", "_block", "_side").applyInArrow(
            _search, "_row long, _way int, _prefix int, _gone array<int>, _block long")
        # Of the blocks of this round the nearest with a hit counts; those of earlier rounds were nearer.
        best = settle(hits.groupBy("_row", "_way").agg(F.min_by(
            F.struct("_prefix", "_gone"), F.col("_way") * F.col("_block")).alias("_hit")), "hits")
        found = best if found is None else found.unionByName(best)
        sides = todo.withColumn("_way", F.explode(F.when(F.col("_way") == 0, F.array(F.lit(-1), F.lit(1))).otherwise(
            F.array(F.col("_way")))))
        near, far = far + 1, max(1, 2 * far + 1)
        # Farther slices only for pages with a line outside articles, as no other can go.
        todo = settle(sides.where("_any").join(best.select("_row", "_way"), ["_row", "_way"], "left_anti").where(
            F.col("_slice") + F.col("_way") * near >= 0).where(
            F.col("_slice") + F.col("_way") * near <= F.col("_last")).select(todo.columns), "todo")
        if todo.isEmpty():
            break
        steps = todo.withColumn("_side", F.col("_way")).withColumn(
            "_step", F.explode(F.sequence(F.lit(near), F.lit(far)))).withColumn(
            "_block", F.col("_slice") + F.col("_side") * F.col("_step")).where("_block between 0 and _last")
        asked = steps.join(members.select(*facts), "_row").select(
            "_host", F.col("_slice").alias("_from"), "_block", "_side", *facts,
            F.lit(True).alias("_asked"), F.lit(False).alias("_there"), "_way")
        there = steps.select("_host", F.col("_slice").alias("_from"), "_block", "_side").distinct().join(
            members.select("_host", F.col("_slice").alias("_block"), *facts), ["_host", "_block"]).select(
            "_host", "_from", "_block", "_side", *facts,
            F.lit(False).alias("_asked"), F.lit(True).alias("_there"), F.lit(0).alias("_way"))
        groups = asked.unionByName(there)
    return found.groupBy("_row").agg(
        F.max_by("_hit._gone", F.struct("_hit._prefix", -F.col("_way"))).alias("_gone")).where(F.size("_gone") > 0)


def main_text(pages: DataFrame, slice_pages: int = SLICE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars per row of ``pages`` (page_id, url, html).

    Text of a block is decoded, its white space runs become one space, and blocks are joined by line
    feeds in page order. A line goes if its containers say so, or if it stands outside articles and the
    nearest page has it as well; where no page of the host is other than a copy, such lines stay. Null or
    empty html gives an empty text. Pages without a host are compared with each other. Repeated rows get
    equal results, an empty table none; other columns are not looked at.
    """
    staged = pages.select("page_id", "url", F.col("html").alias("_html"))
    url = F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    staged = staged.withColumn(
        "_host", F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)).withColumn(
        "_path", F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    # Written once: the pages are parsed once, and their row numbers hold.
    parsed = store(staged.mapInArrow(
        _parser, f"page_id {kind}, url string, _host string, _path string, _lines array<string>, "
        "_fixed array<boolean>").withColumn("_row", F.monotonically_increasing_id()), "parsed")
    # Small where the markup has settled most pages: the join then leaves the texts where they are.
    frames = settle(_frames(parsed, slice_pages), "frames")
    kept = F.filter("_lines", lambda line, k: F.col("_gone").isNull() | ~F.array_contains("_gone", k))
    whole = parsed.join(frames, "_row", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return whole.withColumn("n_chars", F.length("text").cast("bigint"))
