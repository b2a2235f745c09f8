"""Main text of web pages by tag-path ratios.

The blocks of a page are grouped by their root-to-leaf tag path. A path's text and punctuation per block are aggregated, smoothed along the page between blocks of
related paths, and fused to a score; names that speak against an element lower it. The scores decide which container holds the content, and a threshold on paths what
is taken beside it. Left out before are elements that are no content by tag, role or state, and those whose names say so without their text speaking against it.
Every step takes time in proportion to the page, however deep or broken its markup is: paths are numbered nodes with a parent.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the score that the container must hold, and share of the best score that a path outside it must reach.
HELD, OUTSIDE = 0.7, 0.6
#: Doubt from which an element is left out, what sentences of SENTENCES characters take from it, and what a name of content takes.
DOUBT, SENTENCES, CONTENT_NAME = 0.5, 300, 0.75
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
                     "pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
            "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl menu table tbody thead tfoot tr td th div section article body html select nav".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("head nav footer aside button select option datalist noscript object svg math canvas audio video menu dialog template label legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: an id is an anchor there, no name of a part of the page.
TEXTUAL = HEADINGS | frozenset("p li blockquote pre dt dd td th tr figure figcaption a span small ins font".split())
#: Inline elements that names are read of; emphasis and the like belong to their sentence.
NAMED_INLINE = frozenset("a span small ins font".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond shoutbox".split())
WORDS = COMMENTS | frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies dropdown footer gdpr legal login masthead "
                             "menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion recommended related reply "
                             "search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar tracking widget widgets".split())
#: Those of WORDS that are also what an article may be about.
TOPICS = frozenset("advertising legal login menu navigation notice notices promotion related reply search sharing social subscription tracking widget widgets".split())
CONTENT = frozenset("article body content entry main post story text".split())
#: Words that say nothing on their own; any other word beside one of WORDS makes the name a doubtful one.
NEUTRAL = CONTENT | frozenset("area articles bar block bottom box button buttons col column container fixed form global group header icon icons inner item items js large left link links list "
                              "mobile module news outer page panel posts primary reader region right row secondary section site slot small sticky stories title top unit user wrap wrapper "
                              "zone".split())
#: Words of a name that states how an element around is laid out.
STATES = frozenset("closed has is no off on open with without enabled disabled".split())

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_COMMENT_END = re.compile("--!?>")
_TO_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile("[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、！？；：]")


class Tags:
    """Iterator of (start, end, closing, name, attributes) over the tags of a page. Comments and the insides of scripts and the like count as tags without a name.

    A tag ends at the first > outside quotes. Where quotes do not close before the page ends, that tag and all later ones end at the next >.
    """

    def __init__(self, page: str):
        self.page, self.strict = page, True

    def _end(self, at: int) -> int:
        if self.strict:
            found = _TO_END.match(self.page, at)
            if found:
                return found.end()
            self.strict = False
        return self.page.find(">", at) + 1

    def __iter__(self):
        page, at = self.page, 0
        while found := _OPEN.search(page, at):
            start, name = found.start(), (found[3] or "").lower()
            if found[1]:
                if page.startswith((">", "->"), found.end()):
                    at = page.index(">", found.end()) + 1
                else:
                    close = _COMMENT_END.search(page, found.end())
                    at = close.end() if close else len(page)
                yield start, at, False, "", ""
                continue
            at = self._end(found.end()) if name else page.find(">", found.end()) + 1
            if not at:  # an unfinished tag ends the page
                yield start, len(page), False, "", ""
                return
            if name in RAW and not found[2]:
                close = _RAW_END[name].search(page, at)
                at = (page.find(">", close.end()) + 1 or len(page)) if close else len(page)
                yield start, at, False, "", ""
            else:
                yield start, at, bool(found[2]), name, page[found.end() : at - 1]


def _doubt(tag: str, names: list[tuple[str, str]], inside: bool) -> float:
    """How strongly the names of an element speak against it: 1 a name of a removed part, less for one that is an anchor or may be the article's topic, 2 reader comments."""
    most, content = 0.0, False
    for kind, value in names:
        if kind == "id" and tag in TEXTUAL:
            continue
        for token in value.split():
            pieces = [p.lower() for p in _PIECES.findall(token)]
            if not pieces or STATES.intersection(pieces):
                continue
            against = [p for p in pieces if p in WORDS or p == "header" and not inside and not CONTENT.intersection(pieces)]
            if not against:
                content = content or CONTENT.issuperset(pieces) or NEUTRAL.issuperset(pieces) and bool(CONTENT.intersection(pieces))
            elif all(p in WORDS or p in NEUTRAL or len(p) == 1 for p in pieces):
                if COMMENTS.intersection(against):
                    return 2.0
                weak = inside and (kind == "id" or TOPICS.issuperset(against))
                most = max(most, (DOUBT if kind == "id" else CONTENT_NAME) if weak else 1.0)
            else:
                most = max(most, 0.45 * len(against) / len(pieces))
    return max(most - CONTENT_NAME * content, 0.0)


class Page:
    """Blocks of a page, its elements, and its paths as numbered nodes (`up`, `labels`, `kinds`; node 0 is the root, parents come before children)."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.paths: list[int] = []
        self.owners: list[int] = []
        self.up, self.kinds = [-1], [""]
        self._nodes: dict[tuple[int, str], int] = {}
        self.parents, self.doubts, self.holds = [-1], [0.0], [False]  # of the elements; 0 is the page
        self._read(page)
        self._leave_out()

    def _node(self, parent: int, label: str, kind: str) -> int:
        node = self._nodes.setdefault((parent, label), len(self.up))
        if node == len(self.up):
            self.up.append(parent)
            self.kinds.append(kind)
        return node

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int, bool, str]] = []  # tag, path node, element, left out, kind
        where: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        scopes: list[int] = []
        buffer: list[str] = []
        linked = in_link = articles = 0

        def out() -> bool:
            return bool(stack) and stack[-1][3]

        def end_block() -> None:
            nonlocal linked
            if buffer:
                text = "".join(buffer)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.texts.append(text)
                    self.links.append(linked)
                    self.paths.append(stack[-1][1] if stack else 0)
                    self.owners.append(stack[-1][2] if stack else 0)
                buffer.clear()
            linked = 0

        def pop(to: int) -> None:
            nonlocal in_link, articles
            if any(entry[0] not in INLINE for entry in stack[to:]):
                end_block()
            while len(stack) > to:
                tag, _, _, _, kind = stack.pop()
                where[tag].pop()
                in_link -= tag == "a"
                articles -= kind in ("article", "main")
                if scopes and scopes[-1] == len(stack):
                    scopes.pop()

        def words(text: str) -> None:
            nonlocal linked
            if text and not out():
                buffer.append(text)
                if in_link:
                    linked += len(text)

        at = 0
        for start, end, closing, tag, attributes in Tags(page):
            words(page[at:start])
            at = end
            if not tag:
                continue
            if closing:
                if where.get(tag):
                    pop(where[tag][-1])
                continue
            if tag == "br":
                words(" ")
                continue
            if tag not in INLINE:
                end_block()
                close = ("p",) if tag in CLOSES_P else SIBLINGS.get(tag, ())
                while close:
                    last = max((where[name][-1] for name in close if where.get(name)), default=-1)
                    if last < 0 or scopes and last < scopes[-1]:
                        break
                    pop(last)
                    if tag in ("p", "li", "option") or tag in CLOSES_P:
                        break
                if tag == "body" and where.get("head"):
                    pop(where["head"][-1])
            if tag in VOID:
                continue
            names, kind, gone = [], tag, out() or tag in LEFT_OUT or tag == "header" and not articles
            for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "role":
                    role = value.strip().lower()
                    gone = gone or role in ROLES and tag not in ("html", "body", "main", "article")
                    kind = role if role in ("main", "article") and tag not in INLINE else kind
                elif name in ("class", "id"):
                    names.append((name, value))
                elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
                    gone = True
            doubt = 0.0
            if names and not gone and tag not in ("html", "body") and (tag not in INLINE or tag in NAMED_INLINE):
                doubt = _doubt(tag, names, articles > 0)
            if tag in INLINE:
                if not gone and doubt >= 1.0:
                    gone = True
                    words(" ")
                node, element = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            else:
                parent = stack[-1][1] if stack else 0
                node = parent if gone else self._node(parent, kind + "".join("." + _DIGITS.sub("", v) for _, v in names), kind)
                element = stack[-1][2] if stack else 0
                if not gone:
                    self.parents.append(element)
                    self.doubts.append(max(doubt, 1.0 if tag == "form" else 0.0))
                    self.holds.append(kind in ("article", "main") and doubt < 1.0)
                    element = len(self.parents) - 1
            where.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append((tag, node, element, gone, kind))
            in_link += tag == "a"
            articles += kind in ("article", "main")
        words(page[at:])
        end_block()

    def _leave_out(self) -> None:
        """Takes out the blocks of elements that their names speak against more than their text for them; an element around the article or most of the page stays."""
        if not any(self.doubts):
            self.doubt = [0.0] * len(self.texts)
            return
        plain, marks, held = [0] * len(self.parents), [0] * len(self.parents), list(self.holds)
        for text, links, owner in zip(self.texts, self.links, self.owners):
            plain[owner] += max(len(text) - links, 0)
            marks[owner] += len(_PUNCTUATION.findall(text))
        for e in range(len(self.parents) - 1, 0, -1):
            up = self.parents[e]
            plain[up] += plain[e]
            marks[up] += marks[e]
            held[up] = held[up] or held[e] and self.doubts[e] < 2.0
        gone, doubt = [False] * len(self.parents), [0.0] * len(self.parents)
        for e in range(1, len(self.parents)):
            own, up = self.doubts[e], self.parents[e]
            sentences = min(plain[e] / SENTENCES, 1.0) if marks[e] >= 2 else 0.0
            around = held[e] or plain[e] > 0.5 * plain[0] and plain[e] > 2 * SENTENCES
            gone[e] = gone[up] or own >= 2.0 or own - 0.5 * sentences >= DOUBT and not around
            doubt[e] = max(doubt[up], 0.0 if around else own)
        rows = [i for i, owner in enumerate(self.owners) if not gone[owner]]
        self.texts, self.links, self.paths, self.doubt = ([seq[i] for i in rows] for seq in (self.texts, self.links, self.paths, [doubt[o] for o in self.owners]))

    def scores(self) -> np.ndarray:
        """Score of each block: text and punctuation per block of its path, smoothed over the two blocks on either side by how much of the path they share, multiplied, and
        lowered by the doubt about its names."""
        n, nodes = len(self.texts), len(self.up)
        path = np.array(self.paths)
        count = np.bincount(path, minlength=nodes)
        text = np.bincount(path, [max(len(t) - k, 0) for t, k in zip(self.texts, self.links)], minlength=nodes)
        marks = np.bincount(path, [len(_PUNCTUATION.findall(t)) for t in self.texts], minlength=nodes)
        ratio = np.stack([text[path] / count[path], 1 + marks[path] / count[path]], axis=1)
        weight, smooth = np.ones(n), ratio.copy()
        depth = [0] * nodes
        for node in range(1, nodes):
            depth[node] = depth[self.up[node]] + 1
        near: dict[tuple[int, int], float] = {}
        for step, fall in ((1, 0.6), (2, 0.14)):
            share = np.zeros(max(n - step, 0))
            for i in range(n - step):
                pair = (self.paths[i], self.paths[i + step])
                if pair not in near:
                    near[pair] = self._related(*pair, depth)
                share[i] = fall * near[pair]
            if len(share):
                smooth[:-step] += share[:, None] * ratio[step:]
                smooth[step:] += share[:, None] * ratio[:-step]
                weight[:-step] += share
                weight[step:] += share
        return np.log1p(smooth / weight[:, None]).prod(axis=1) * (1 - np.minimum(np.array(self.doubt), 1.0))

    def _related(self, a: int, b: int, depth: list[int]) -> float:
        """Share of the longer of two paths that both begin with. The steps are no more than the tags between neighbouring blocks."""
        longest = max(depth[a], depth[b], 1)
        while a != b:
            if depth[a] >= depth[b]:
                a = self.up[a]
            else:
                b = self.up[b]
        return depth[a] / longest

    def select(self) -> list[bool]:
        """Which blocks are content."""
        if not self.texts:
            return []
        score = self.scores()
        up, kinds, nodes = self.up, self.kinds, len(self.up)
        mass = np.bincount(self.paths, score * [len(t) for t in self.texts], minlength=nodes).tolist()
        for node in range(nodes - 1, 0, -1):
            mass[up[node]] += mass[node]
        # Articles, outermost first; a main element gives way to the articles that hold most of it.
        within, below, named = [False] * nodes, [0.0] * nodes, []
        for node in range(nodes - 1, 0, -1):
            below[up[node]] += mass[node] if kinds[node] == "article" else below[node]
        for node in range(1, nodes):
            within[node] = within[up[node]]
            if kinds[node] in ("article", "main") and not within[node] and mass[node] and not (kinds[node] == "main" and below[node] >= HELD * mass[node]):
                within[node] = True
                named.append(node)
        whole = bool(named) and sum(mass[p] for p in named) >= 0.25 * mass[0]
        if whole:
            chosen, least = set(named), np.inf
        else:
            chosen, least, deepest, depth = {0}, OUTSIDE * float(score.max()), 0, [0] * nodes
            for node in range(1, nodes):
                depth[node] = depth[up[node]] + 1
                if mass[node] >= HELD * mass[0] and depth[node] > depth[deepest] and kinds[node] not in HEADINGS and kinds[node] not in ("p", "pre", "blockquote", "li"):
                    deepest = node
            chosen = {deepest}
        inside = [False] * nodes
        for node in range(nodes):
            inside[node] = node in chosen or node > 0 and inside[up[node]]
        beside = {up[p] for p in chosen if p}
        path = np.array(self.paths)
        count, chars, links = (np.bincount(path, values, minlength=nodes) for values in (None, [len(t) for t in self.texts], self.links))
        best = np.zeros(nodes)
        np.maximum.at(best, path, score)
        keep = [inside[p] or kinds[p] in ("h1", "h2") and up[p] in beside or bool(best[p] >= least) for p in self.paths]
        if whole:
            return keep
        # Lists of links are the article's own only between parts of it.
        listed = [bool(links[p] >= 0.9 * chars[p] and chars[p] < 40 * count[p] and count[p] > 1) for p in self.paths]
        firm = [i for i, (k, short) in enumerate(zip(keep, listed)) if k and not short]
        return [k and (not short or bool(firm) and firm[0] < i < firm[-1]) for i, (k, short) in enumerate(zip(keep, listed))]


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by line feeds."""
    parsed = Page(page or "")
    return "\n".join(text for text, keep in zip(parsed.texts, parsed.select()) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns plus the main text of each page. A missing or empty page, or one without content, has an empty text; a column named as the result is replaced; rows are
    neither moved nor joined. Deep, unclosed and broken markup takes time in proportion to the page, and text at any depth is found."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(main_text, na_action=None)

    return pages.withColumn(text, run(F.col(html).cast("string")))
