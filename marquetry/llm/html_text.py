"""Text of web pages by tag-path ratios.

A page is cut into tags and text nodes; a node's path is the chain of open elements from root to leaf.  For each path the page's text
length and punctuation are added up over its nodes, and divided by their number; the two ratios are multiplied.  Along
the sequence of nodes these values are smoothed with a Gaussian, then averaged for each path, and paths whose
value reaches ``THRESHOLD`` standard deviations of the smoothed sequence are content.  The text of content nodes is returned, with
line breaks between block elements and white space collapsed.

Cases: null and empty pages, and pages without visible text, give an empty text; if no path has punctuation, text length alone
counts.  Comments, the head, and what is in ``script style noscript template textarea svg iframe`` are left out.  Tags that are never closed end with
their parent; end tags without a start are ignored.  A tag that the page's end cuts off is left out with what follows it; if it is a quote
that is never closed which reaches the end, quotes aren't heeded in tags from there on.  Pages are read whole, in time and memory linear in their length,
however deep elements are nested.  Rows stand for themselves: repeated rows give repeated results, and a null ``page_id`` is
carried along.  Paths whose value is just the threshold count.  An empty table gives an empty result.  Only ``page_id`` and ``html`` are read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import table

SIGMA = 1.0
THRESHOLD = 0.6

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_OPEN = re.compile(r"<(?:[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_SPACE = re.compile(r"\s+")
#: An element of the key closes an open one of the value, all of which are blocks, if that is the nearest open block.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES |= {t: ("p",) for t in _BLOCK - {"br", "option", "td", "th", "tr", "li", "dd", "dt", "body", "head", "html", "title"}}


def nodes(page: str) -> list[tuple[int, str, bool]]:
    """(path, text, whether a block begins before it) of each text node with visible text, in order; paths are numbered."""
    out: list[tuple[int, str, bool]] = []
    #: open elements: tag, number of the path, place of the nearest block at or above it
    stack: list[tuple[str, int, int]] = [("", 0, -1)]
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = {}
    fresh, quotes, at, end = True, True, 0, len(page)

    def text(raw: str) -> None:
        nonlocal fresh
        if opened.get("head"):
            return
        clean = _SPACE.sub(" ", _html.unescape(raw))
        if clean.strip():
            out.append((stack[-1][1], clean, fresh))
            fresh = False
        elif clean and out and not fresh and not out[-1][1].endswith(" "):
            out[-1] = (out[-1][0], out[-1][1] + " ", out[-1][2])

    def close(depth: int) -> None:
        """Ends the elements from this depth on."""
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    def begin(tag: str) -> None:
        path = paths.setdefault((stack[-1][1], tag), len(paths) + 1)
        stack.append((tag, path, len(stack) if tag in _BLOCK else stack[-1][2]))
        opened[tag] = opened.get(tag, 0) + 1

    while at < end:
        m = _OPEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        if m.group(2) is None:
            m = _COMMENT.match(page, m.start())
            at = m.end()
            if m.group().startswith("<![CDATA["):
                text(_html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            at = page.find(">", m.end()) + 1
            if not at:
                break
            quotes = False
        else:
            at = rest.end()
        tag, whole = m.group(2).lower(), page[at - 2] == "/"
        fresh = fresh or tag in _BLOCK
        if m.group(1):
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
        elif tag in _RAW and not whole:
            stop = _RAW[tag].search(page, at)
            at = end if stop is None else stop.start()
            begin(tag)
        elif tag not in _VOID and not whole:
            if tag == "body" and opened.get("head"):
                while opened["head"]:
                    close(len(stack) - 1)
            block = stack[-1][2]
            if block > 0 and stack[block][0] in _CLOSES.get(tag, ()):
                close(block)
            begin(tag)
    return out


def path_scores(found: list[tuple[int, str, bool]], sigma: float = SIGMA) -> tuple[dict[int, float], float]:
    """Each path's smoothed value, and the standard deviation of the smoothed sequence."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, text, _ in found:
        length[path] = length.get(path, 0) + len(text.strip())
        marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(text))
        count[path] = count.get(path, 0) + 1
    punctuated = any(marks.values())
    fused = {p: length[p] / n * (marks[p] / n if punctuated else 1.0) for p, n in count.items()}
    values = np.array([fused[p] for p, _, _ in found])
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    smooth = np.convolve(values, kernel)[reach:-reach] / weight
    total: dict[int, float] = {}
    for (p, _, _), v in zip(found, smooth.tolist(), strict=True):
        total[p] = total.get(p, 0.0) + v
    return {p: v / count[p] for p, v in total.items()}, float(smooth.std())


def extract(page: str | None, threshold: float = THRESHOLD, sigma: float = SIGMA) -> tuple[str, int, int]:
    """The page's text, its content nodes and all its text nodes."""
    found = nodes(page or "")
    if not found:
        return "", 0, 0
    scores, deviation = path_scores(found, sigma)
    kept, parts, fresh = 0, [], False
    for path, text, block in found:
        fresh = fresh or block
        if scores[path] >= threshold * deviation:
            kept += 1
            parts.append(("\n" if fresh and parts else "") + (text.lstrip() if fresh or not parts else text))
            fresh = False
    lines = (line.strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line), kept, len(found)


def extracted(pages: DataFrame, threshold: float = THRESHOLD, sigma: float = SIGMA) -> DataFrame:
    """(page_id, text, content_nodes, text_nodes) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept, all_nodes = zip(*(extract(h.as_py(), threshold, sigma) for h in b.column(1)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kept, pa.int64()), pa.array(all_nodes, pa.int64())], ["page_id", "text", "content_nodes", "text_nodes"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string, content_nodes long, text_nodes long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
