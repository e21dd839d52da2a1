"""Main text of web pages: the maximum-scoring run of a page's words and tags.

A page is a sequence of words and tags. What is never content (scripts, styles,
forms, menus, side columns, notices, adverts, reader comments, page headers and
footers) is cut out first, by element and by class, id and role names; the first
article or main element is never cut, whatever its or its ancestors' names. In what
is left, inside the marked article where a page has one, words score positive and
tags negative, by weights counted on the pages that mark their article themselves;
one linear scan finds the contiguous run of the largest sum. Its blocks are the text.

Without a marked article a word's weight follows the block it stands in and whether
it is linked: words of a kind that lies outside of articles, the parts cut out
counted too, score negative, so that the scan leaves out what no name gives away.

Defined results: null or empty html gives the empty text; so does a page without
words outside the parts cut out; of equal runs the first, and the longest from
there; an element that is not closed ends where its parent does, a paragraph, list
item or cell at the next one, and without any of these at the next article or main
element, else with the page; without any labelled page the weights are the priors;
rows that repeat get equal results; other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard, by what they mean here.
RAW = frozenset("script style title textarea noscript template iframe xmp noframes".split())
NOISE = frozenset("nav aside footer form menu button select option input label dialog object embed svg canvas audio video map datalist fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
CONTENT = frozenset("article main".split())
BLOCK = frozenset("html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote section header figure "
                  "figcaption address hr br center details summary meta link base".split())
# Words that name a part of a page which is not its text.
HINT = re.compile(
    r"^(?:[\w]+[-_])*(?:ads?|adverts?|advertisement|advertising|adbox|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|disclaimer|footer|footnav|"
    r"gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo|related|respond|share|sharing|sidebar|signup|"
    r"site-?header|page-?header|skip|social|sponsor(?:ed)?|subscribe|toolbar|widget|alert|search|login)(?:[-_](?:area|bar|block|box|container|inner|item|links?|"
    r"list|main|section|top|bottom|left|right|wrapper|wrap|\d+))*$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening element of the second kind ends, as the HTML standard has it.
_ENDS = {"p": BLOCK - {"br", "link", "meta", "base"} | CONTENT | {"nav", "aside", "footer", "form", "menu"}, "li": frozenset(["li"]), "option": frozenset(["option"]),
         "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_UNLESS = re.compile(r"^(?:no|has|with|without|not)[-_]", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_NAMED = re.compile(r"""\b(class|id|role|aria-label|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][\w:-]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>""", re.S)

WORD, LINKED, CUT = "#word", "#linked", "#cut"
#: A tag costs BASE to three times BASE, by its share outside of content; PRIOR is the weight of
#: the prior shares, the second of them for words inside links.
#: Linked words that no labelled page tells about are taken as rather outside, so they weigh a little less than nothing.
BASE, PRIOR, PRIOR_OUT, PRIOR_LINKED = 0.05, 20.0, 0.3, 0.6


@dataclass(slots=True)
class Part:
    """A tag, or a run of text (name is None)."""
    name: str | None
    closing: bool
    noise: bool
    text: str


def parts(page: str) -> list[Part]:
    """Tags and decoded runs of text in page order."""
    out: list[Part] = []
    at, n, lower = 0, len(page), None
    last = page.rfind(">") + 1  # beyond it no tag ends

    def words(piece: str) -> None:
        if piece:
            out.append(Part(None, False, False, html.unescape(piece)))

    while at < n:
        found = _TOKEN.search(page, at, last)
        if not found:
            words(page[at:].partition("<!--")[0])
            break
        words(page[at:found.start()])
        at = found.end()
        name = found.group(2) or found.group(5)
        if not name:
            if found.group(0).startswith("<![CDATA["):
                words(html.escape(found.group(0)[9:].removesuffix("]]>"), quote=False))
            continue
        name, closing = name.lower(), bool(found.group(1) or found.group(4))
        attributes = found.group(3) or found.group(6) or ""
        if name in RAW and not closing:
            lower = page.lower() if lower is None else lower
            if len(lower) != n:
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lower.find(f"</{name}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
            continue
        out.append(Part(name, closing, not closing and _is_noise(name, attributes), ""))
        if attributes.endswith("/") and not closing and name not in VOID and name in NOISE:
            out.append(Part(name, True, False, ""))
    return out


def _is_noise(name: str, attributes: str) -> bool:
    if name in NOISE:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, *values in _NAMED.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" and not value and name not in VOID:
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and any(HINT.match(word) and not _UNLESS.match(word) for word in value.split()):
            return True
    return False


def _spans(found: list[Part]) -> dict[int, int]:
    """Where the element opened at each place ends: its closing tag, or the last part before its implied end."""
    ends: dict[int, int] = {}
    stack: list[int] = []
    opened: Counter = Counter()
    for i, p in enumerate(found):
        if p.name is None or p.name in VOID:
            continue
        if p.closing:
            if opened[p.name]:
                while stack:
                    at = stack.pop()
                    opened[found[at].name] -= 1
                    if found[at].name == p.name:
                        ends[at] = i
                        break
                    ends[at] = i - 1
            continue
        while stack and p.name in _ENDS.get(found[stack[-1]].name, ()):
            at = stack.pop()
            opened[found[at].name] -= 1
            ends[at] = i - 1
        stack.append(i)
        opened[p.name] += 1
    return ends


def _all_parts(page: str) -> list[tuple[Part, int]]:
    """Every part with 1 inside an article or main element, 0 outside, -1 where it is cut out."""
    found = parts(page)
    ends = _spans(found)
    bodies = [i for i, p in enumerate(found) if p.name in CONTENT and not p.closing]
    first = bodies[0] if bodies else None
    out: list[tuple[Part, int]] = []
    i, inside = 0, 0
    while i < len(found):
        p = found[i]
        page_header = p.name == "header" and not p.closing and not inside
        if (p.noise or page_header) and p.name not in VOID and i != first:
            end = ends.get(i)
            if end is None:
                end = next((b - 1 for b in bodies if b > i), len(found) - 1)
            holds = first is not None and i < first <= end
            spared = holds and (p.name not in NOISE or p.name in ("form", "fieldset")) or inside and p.name in HEADINGS
            if not spared:
                out += [(Part(CUT, False, False, ""), int(inside > 0)), *((q, -1) for q in found[i:end + 1])]
                i = end + 1
                continue
        if p.name in CONTENT:
            inside = max(0, inside + (-1 if p.closing else 1))
        out.append((p, int(inside > 0)))
        i += 1
    return out


def content_parts(page: str) -> list[tuple[Part, bool]]:
    """What is left after the cuts, each with whether an article or main element holds it."""
    return [(p, state == 1) for p, state in _all_parts(page) if state >= 0]


def _key(name: str) -> str:
    return name if name in BLOCK or name in INLINE or name in CONTENT or name == CUT else "other"


def _events(found: list[Part], blocks: bool = False) -> Iterator[tuple[str, int]]:
    """(key, how many) of each part; linked words with no other text before them in their block are a kind of
    their own, with ``blocks`` those of each block too."""
    linked, block, prose = False, "", False
    for p in found:
        if p.name is None:
            n = len(p.text.split())
            prose = prose or (n > 0 and not linked)
            yield (LINKED if linked and not prose else f"{WORD}:{block}" if blocks and block else WORD), n
        else:
            if p.name == "a":
                linked = not p.closing
            elif p.name not in INLINE:
                linked = prose = False
                block = "" if p.closing or p.name == CUT else _key(p.name)
            yield _key(p.name), 1


def counted(page: str) -> dict[str, tuple[int, int]]:
    """Tags and words inside and outside of the marked article; nothing where none is marked.

    Words are counted as such in what the cuts leave, and by their blocks in the whole page.
    """
    whole = _all_parts(page)
    if not any(state == 1 for _, state in whole):
        return {}
    held: tuple[Counter, Counter] = (Counter(), Counter())
    found = [(p, state) for p, state in whole if state >= 0]
    for (key, n), (_, state) in zip(_events([p for p, _ in found]), found, strict=True):
        held[state != 1][key] += n
    for (key, n), (_, state) in zip(_events([p for p, _ in whole], True), whole, strict=True):
        if key.startswith(f"{WORD}:"):
            held[state != 1][key] += n
    return {k: (held[0][k], held[1][k]) for k in held[0].keys() | held[1].keys()}


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Words: their share inside, less for words in links and, as evidence grows, for blocks that lie outside.
    Tags: minus BASE times one plus twice their share outside."""
    out = {}
    kinds = {"other", *BLOCK, *INLINE, *CONTENT}
    for key in {WORD, LINKED, *kinds, *(f"{WORD}:{k}" for k in kinds), *counts}:
        inside, outside = counts.get(key, (0, 0))
        seen = inside + outside
        share = (outside + PRIOR * (PRIOR_LINKED if key == LINKED else PRIOR_OUT)) / (seen + PRIOR)
        if key.startswith(f"{WORD}:"):
            out[key] = 1 - share * (1 + 2 * seen / (seen + PRIOR))
        else:
            out[key] = {WORD: 1 - share, LINKED: 1 - 2 * share, CUT: 0.0}.get(key, -BASE * (1 + 2 * share))
    return {**out, CUT: 0.0}


def main_text(page: str, weight: dict[str, float]) -> str:
    """The blocks of the best run, joined by blanks."""
    left = content_parts(page)
    found = [p for p, inside in left if inside]
    marked = any(p.name is None and p.text.split() for p in found)
    if not marked:
        found = [p for p, _ in left]
    best, best_from, best_to, running, start = 0.0, 0, 0, 0.0, 0
    for i, (key, n) in enumerate(_events(found, not marked)):
        running += n * weight[key]
        if running <= 0:
            running, start = 0.0, i + 1
        elif running > best or (running == best and start == best_from):
            best, best_from, best_to = running, start, i + 1
    pieces = [p.text if p.name is None else "" if p.name in INLINE else " " for p in found[best_from:best_to]]
    return " ".join("".join(pieces).split())


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0):
            for key, (a, b) in counted(page.as_py() or "").items():
                inside[key] += a
                outside[key] += b
    keys = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())],
                                     ["key", "inside", "outside"])


def train(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all pages that mark their article; one row for each element name reaches the driver."""
    rows = pages.select(F.col(html_col).alias("html")).filter(F.col("html").isNotNull()).mapInArrow(
        _count_batches, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside"), F.sum("outside")).collect()
    return weights({r[0]: (r[1], r[2]) for r in rows})


def extract(pages: DataFrame, weight: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(page.as_py() or "", weight) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
