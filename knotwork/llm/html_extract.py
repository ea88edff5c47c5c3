"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's parser streams a page's events.  Text gathers into lines, one for each block
element's stretch, each with the number of tags that it holds.  A line's ratio is its characters per
tag, with link text not counting; the ratios are smoothed with a Gaussian along the page.  What tags,
roles, classes and marked containers say of a line weighs its smoothed ratio down, and two clusters of
the logarithms, parted at the iterated midpoint of their means, tell content lines from the rest.

Containers are then gone through from the page downwards.  One whose text is mostly content lines and
that holds no line of links besides is a region: all its lines belong to the article, headings and
short ones too, but for lines that are weighed down and are no content.  Of any other container the
content lines stay and the containers inside are looked at; one without content lines goes.  Scripts,
styles, form controls and hidden elements have no text at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: What is left of a line's ratio: in a menu, footer, form or the like; where a class word hints at that; outside of marked containers that hold content.
OTHER, HINTED, OUTSIDE = 0.03, 0.3, 0.1
#: Weight from which a line of a region stays without being content.
PLAIN = 0.25
#: Share of a container's text in content lines that makes it a region.
SHARE = 0.5
#: Clusters whose means are nearer than a factor of this are one.
APART = 2.5
# Element names as HTML defines them, and the words that pages name their parts by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WITHOUT_TEXT = frozenset("script style noscript template head title button select option textarea input iframe object svg canvas audio video map math datalist".split())
SKIPPED = frozenset("nav footer aside form fieldset menu dialog".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul nav footer aside form fieldset menu dialog".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = BLOCKS - {"br", "body", "html"}
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidebars aside footer header masthead topbar comment comments disqus respond reply replies cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager skip toolbar tags copyright legal disclaimer".split()
)
#: Of these, words that also name an article's own parts or subjects: they are hints, and nothing at all inside a marked container.
GENERIC = frozenset("header footer banner promotion masthead legal disclaimer copyright notice notices widget widgets tags related respond modal overlay menu skip social share sharing consent".split())
#: Elements of running text, whose class words say nothing inside a marked container.
TEXTUAL = frozenset("p span a b i em strong u s small q cite code sub sup mark abbr time label li dd dt h1 h2 h3 h4 h5 h6 td th blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
WITHOUT = frozenset("has no with without hide".split())  # "has-sidebar" says something about the page, not what the element is
#: How the part for readers begins, and what stands above what a reader wrote.
COMMENTS = re.compile(
    r"\W*(?:\d+\s+|no\s+|all\s+|show\s+)?(?:reader\s+)?(?:comments?|replies|responses|thoughts\s+on|leave\s+a\s+(?:reply|comment)|what\s+readers\s+(?:say|think)|"
    r"join\s+the\s+(?:conversation|discussion)|(?:leser)?kommentare?|antworten|commentaires?|réactions|comentarios?|respuestas)\b.{0,40}$",
    re.IGNORECASE,
)
BYLINE = re.compile(r"\d{1,2}[:.]\d{2}|\b(?:19|20)\d\d\b|\b(?:ago|says|said|wrote|schrieb|sagt|vor|dit|écrit|hace|dijo|dice|escribió)\b", re.IGNORECASE)
SHORT = 60
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element shows no text."""
    if tag in WITHOUT_TEXT:
        return True
    if tag in ("html", "body"):
        return False
    return any(n == "hidden" or n == "aria-hidden" and v == "true" or n == "style" and "display:none" in (v or "").replace(" ", "").lower() for n, v in attrs)


def _weight(tag: str, attrs: list[tuple[str, str | None]], marked: bool) -> float:
    """What an element's tag and attributes leave of its lines' ratios; ``marked``: inside an article or main element."""
    if tag in SKIPPED or tag == "header" and not marked:
        return OTHER
    if tag in ("html", "body", "article", "main"):
        return 1.0
    out = 1.0
    for name, value in attrs:
        value = value or ""
        if name == "role" and value.lower() in SKIPPED_ROLES:
            return OTHER
        if name in ("class", "id") and not (marked and tag in TEXTUAL):
            words = [w.lower() for w in _SPLIT.split(value)]
            found = {w for k, w in enumerate(words) if w in OTHER_WORDS and (k == 0 or words[k - 1] not in WITHOUT)}
            if found - GENERIC:
                return OTHER
            if found and not marked:
                out = HINTED
    return out


class Lines(HTMLParser):
    """Collects lines (text, tags, link characters, container, weight) and containers (parent, whether marked, tag and class)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, float]] = []  # tag, without text, container, weight
        self.skipping = 0
        self.region = 0  # open article and main elements
        self.parents: list[int] = [-1]
        self.marked: list[bool] = [False]
        self.under: list[bool] = [False]  # whether it or one around it is marked
        self.kinds: list[tuple[str, str]] = [("html", "")]  # tag and class
        self.lines: list[tuple[str, int, int, int, float]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def container(self) -> int:
        return self.open[-1][2] if self.open else 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.container(), self.open[-1][3] if self.open else 1.0))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if not self.skipping:
                self.tags += 1
                if tag in BLOCKS:
                    self.flush()
            return
        if tag in CLOSES_P and not self.skipping:
            self._close_p()
        if tag in BLOCKS and not self.skipping:
            self.flush()
        inside = self.container()
        skipped = not self.skipping and _hidden(tag, attrs)
        weight = self.open[-1][3] if self.open else 1.0
        if not self.skipping and not skipped:
            own = _weight(tag, attrs, self.region > 0)
            if own < 1 and tag not in BLOCKS:
                self.flush()
            weight *= own
            if tag in BLOCKS and tag != "p":
                self.parents.append(inside)
                self.kinds.append((tag, next((v or "" for k, v in attrs if k == "class"), "")))
                self.marked.append(tag in ("article", "main") or any(k == "role" and v == "main" for k, v in attrs))
                self.under.append(self.marked[-1] or self.under[inside])
                inside = len(self.parents) - 1
        elif skipped:
            self.flush()
        if not self.skipping:
            self.tags += 1
        self.open.append((tag, skipped, inside, weight))
        self.skipping += skipped
        self.region += tag in ("article", "main")
        self.links += tag == "a"

    def _close_p(self) -> None:
        """An open paragraph ends where a block begins, unless a block lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "p":
                self._close(k)
                return
            if self.open[k][0] in BLOCKS:
                return

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            tag, skipped, _, weight = self.open[-1]
            if not self.skipping and (tag in BLOCKS or weight < (self.open[-2][3] if len(self.open) > 1 else 1.0)):
                self.flush()
            self.open.pop()
            self.skipping -= skipped
            self.region -= tag in ("article", "main")
            self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if not self.skipping:
                    self.tags += 1
                self._close(k)
                return
            if self.open[k][1] and tag in ("body", "html"):
                return
        if tag == "p" and not self.skipping:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._close(0)
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of ``sigma`` lines, with the weights scaled at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, kernel)[reach : reach + n] / np.convolve(np.ones(n), kernel)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of one-dimensional values: the midpoint of their means, iterated."""
    t = float(values.mean())
    for _ in range(100):
        low, high = values[values <= t], values[values > t]
        if not len(high):
            return t
        after = (float(low.mean()) + float(high.mean())) / 2
        if abs(after - t) < 1e-9:
            break
        t = after
    return t


def content(scores: np.ndarray) -> np.ndarray:
    """Which of the scores are in the upper of two clusters of their logarithms; all, where the clusters are not apart."""
    logs = np.log(scores + 0.01 * scores.max(initial=0) + 1e-9)
    upper = logs > threshold(logs)
    if upper.all() or not upper.any() or logs[upper].mean() - logs[~upper].mean() < math.log(APART):
        return np.ones(len(scores), bool)
    return upper


def _readers(parser: Lines) -> set[int]:
    """Containers of what readers wrote: those that begin with such a heading, or repeat one form with a name and a time first."""
    n = len(parser.lines)
    begin, last = [n] * len(parser.parents), [-1] * len(parser.parents)
    for i, line in enumerate(parser.lines):
        begin[line[3]], last[line[3]] = min(begin[line[3]], i), i
    for k in range(len(parser.parents) - 1, 0, -1):
        parent = parser.parents[k]
        begin[parent], last[parent] = min(begin[parent], begin[k]), max(last[parent], last[k])
    first = {k: i for k, i in enumerate(begin) if i < n}
    out: set[int] = set()
    alike: dict[tuple, list[int]] = {}
    for k, i in first.items():
        text, kind = parser.lines[i][0], parser.kinds[k]
        if k and i and len(text) <= SHORT and not parser.marked[k] and kind[0] not in TEXTUAL:
            if COMMENTS.match(text):
                out.add(k)
            elif kind[0] in ("div", "section", "li") and last[k] > i and BYLINE.search(text):
                alike.setdefault((parser.parents[k], kind), []).append(k)
    for same in alike.values():
        if len(same) > 1:
            out.update(same)
    for text, _, _, k, _ in parser.lines:  # a heading in no container but its own: it and what follows beside it
        if len(text) <= SHORT and parser.kinds[k][0] in HEADINGS and COMMENTS.match(text):
            out.update(c for c in first if c >= k and parser.parents[c] == parser.parents[k])
    return out


def weights(parser: Lines) -> np.ndarray:
    """What tags, classes, marks and readers' parts leave of each line's ratio."""
    lines = parser.lines
    out = np.array([line[4] for line in lines])
    inside = np.array([parser.under[line[3]] for line in lines])
    if inside.any() and not inside.all():
        sizes = np.array([max(0, len(t) - linked) for t, _, linked, _, _ in lines]) * out
        if 2 * sizes[inside].sum() >= sizes.sum() > 0:
            out[~inside] *= OUTSIDE
    if readers := _readers(parser):
        theirs: list[bool] = []
        for k, parent in enumerate(parser.parents):
            theirs.append(k in readers or parent >= 0 and theirs[parent])
        out[[theirs[line[3]] for line in lines]] *= OTHER
    return out


def main_text(html: str | None) -> str:
    """The text of the article in a whole page; empty if there is none.

    Broken markup is taken as the parser takes it; an unclosed element ends with its parent.
    """
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    own = np.array([max(0, len(t) - linked) for t, _, linked, _, _ in lines], float)
    weight = weights(parser)
    if not (own * weight).any():
        return ""
    scores = weight * smoothed(own / np.array([max(1, line[1]) for line in lines], float))
    # a smoothed ratio has its neighbours' text in it: links beside the article take none of that
    scores *= [1.0 if parser.under[line[3]] else o / len(line[0]) for line, o in zip(lines, own.tolist(), strict=True)]
    good, plain = (content(scores) & (scores > 0)).tolist(), (weight >= PLAIN).tolist()
    n = len(parser.parents)
    size, rich, foul, noise = [0] * n, [0] * n, [False] * n, []
    for (text, _, linked, k, _), g, p in zip(lines, good, plain, strict=True):
        noise.append(not g and 2 * linked >= len(text) and not parser.under[k])
        if p:
            size[k] += len(text)
            rich[k] += len(text) * g
            foul[k] |= noise[-1]
    for k in range(n - 1, 0, -1):  # containers come after their parents
        parent = parser.parents[k]
        size[parent] += size[k]
        rich[parent] += rich[k]
        foul[parent] |= foul[k]
    dense = [r > 0 and r >= SHARE * s for r, s in zip(rich, size, strict=True)]
    region: list[bool] = []
    for k in range(n):
        region.append(dense[k] and not foul[k] or k > 0 and region[parser.parents[k]])
    kept = []
    for (text, _, _, k, _), g, p, links in zip(lines, good, plain, noise, strict=True):
        if region[k]:
            keep = p or g
        else:  # a part of running text goes with what surrounds it
            while k and parser.kinds[k][0] in TEXTUAL:
                k = parser.parents[k]
            keep = g or dense[k] and p and not links
        if keep:
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page; a null page counts as empty and has empty text.

    Repeated rows each get a row; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b["html"]]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pick(pages, page_id="page_id", url="url", html=html_col)
    kinds = {k: rows.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
