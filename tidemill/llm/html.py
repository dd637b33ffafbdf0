"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. What lies in menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles (known by
tag, role or class words) is no candidate. Pass one decides the other blocks by
length, link density and stop-word density; pass two lets the undecided short ones
inherit the label of their nearest decided neighbours. Inside an article or main
element a block is undecided where the densities alone would reject it, and if
nothing at all is decided around, undecided blocks are kept. Where no block of a page
has the stop words of a known language, length and link density decide alone, and
blocks of links never pass their label to long ones with few links.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import chunks, free_name, map_batches

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have he in is it its of on or she that the they this to was were which who will with not but you we i his her their",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wir zu zum zur",
    "fr": "à au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous y",
    "es": "a al como con de del el ella en es esta este ha la las le lo los más me mi no o para pero por que se si sin sobre su sus también un una y ya",
}

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head nav header footer aside form menu dialog button select option datalist iframe object canvas svg math map audio video noframes applet fieldset legend".split())
_RAW = "script|style|noscript|template|textarea|title|xmp|noembed"
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
_MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice alert popup popover modal overlay "
    "sidebar side aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations subscribe subscription newsletter signup login register widget widgets pagination pager copyright disclaimer".split()
)
#: Marks that void themselves on no page, however much of its text they hold.
_REMARKS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that a class may add to a mark; any other makes it a class of its own (article-with-sidebar).
_PLACES = frozenset(
    "site main page global primary secondary left right top bottom sticky fixed inner outer box block area wrap wrapper container bar list section slot unit zone panel group "
    "button buttons link links post posts article articles story stories item items icon icons text label title form thread count row col column info message the my js".split()
)
#: Marks that too many classes end with for other reasons (right-side, read-and-share).
_FAINT = frozenset("side aside alert notice related social share sharing register login foot header consent modal respond reply".split())
#: Marks that a class may begin with, whatever follows (comment-body, ad-300x250).
_LEADS = frozenset("ad ads adbox adslot advert adverts advertisement sponsored comment comments commentlist disqus reply replies newsletter sidebar breadcrumb breadcrumbs pagination".split())
#: Words that make a class tell about what is around it, or be none of a mark's.
_ABOUT = frozenset("no not non with without has have and free hoc open opened closed enabled disabled allowed layout theme template".split())
# A tag ends at ">" outside quoted values or with the page; possessive, so that time is linear.
_REST = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)|\Z))?+)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>]){_REST}(?:\Z|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})(?P<done>>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s>"'][^\s>]*+)|(?=>)|\Z))?+["']?""")
_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class BlockRules:
    """Thresholds in characters and shares."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.20
    stop_high: float = 0.30
    link_share: float = 0.33
    stop_words: frozenset[str] = field(default_factory=lambda: frozenset(w for words in STOP_WORDS.values() for w in words.split()))


@dataclass
class Block:
    text: str
    tag: str
    linked: int
    dropped: bool
    root: int  # number of the article or main element, 0 outside


#: What _drops tells: a certain drop, a mark of comments or another mark that a page may
#: void, or none.
HIDDEN, REMARKED, MARKED, PLAIN = 3, 2, 1, 0


def _token_says(token: str) -> int:
    """What one class or id says. A class of marks and places only is sure about
    comments; else its last word counts, or its first if that is one to begin with."""
    parts = [x for x in re.split(r"[^a-z]+", _CAMEL.sub("-", token).lower()) if x]
    if not parts or not _MARKS.intersection(parts):
        return PLAIN
    if all(x in _MARKS or x in _PLACES for x in parts):
        return HIDDEN if _REMARKS.intersection(parts) else MARKED
    if _ABOUT.intersection(parts):
        return PLAIN
    ends = {parts[-1]} & (_MARKS - _FAINT) | {parts[0]} & _LEADS
    return REMARKED if ends & _REMARKS else MARKED if ends else PLAIN


def _drops(rest: str) -> int:
    """What an element's attributes say of it."""
    out = PLAIN
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES or name == "style" and _STYLE.search(value):
            return HIDDEN
        if name in ("class", "id"):
            out = max([out, *map(_token_says, value.split())])
    return out


_ENDS = frozenset("p li td th tr dt dd option h1 h2 h3 h4 h5 h6".split())
_BARRIERS = frozenset("ul ol table dl div section article".split())


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order, in time linear in the page.

    An element that a class or id marks for dropping is kept all the same if it holds
    more than half of the page's text outside links: then it is a wrapper. One marked as
    comments must hold an article or main element, too."""
    out: list[Block] = []
    inside: list[tuple[int, ...]] = []  # for each block, the marked elements around it
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, tuple[int, ...], int]] = []  # name, dropped, marked elements, root
    opened: Counter[str] = Counter()
    outside = ("", False, (), 0)
    link = roots = marks = 0
    remarks: set[int] = set()  # elements marked as comments; those that hold an article
    holders: set[int] = set()
    tag = "body"

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            _, dropped, marked, root = stack[-1] if stack else outside
            out.append(Block(text, tag, len(" ".join("".join(linked).split())), dropped, root))
            inside.append(marked)
        parts.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw:
            text = unescape(raw)
            parts.append(text)
            if link:
                linked.append(text)

    def cut(k: int) -> None:
        """Close the elements from the k-th on."""
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                parts.append(" ")
            continue
        if not m["done"]:  # a tag that the page's end cuts off
            continue
        name, closing, rest = name.lower(), bool(m["end"]), m["rest"] or ""
        block = name in _BLOCK
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            if name == "a":
                link = 0
            if opened[name] < 1:
                if block:
                    flush()
                continue
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            flush()
            cut(k)
            continue
        above = stack[-1] if stack else outside
        says = _drops(rest) if rest and name not in ("html", "body", "main") else PLAIN
        if name == "article":  # a comment may be one; no other mark tells of an article
            says = HIDDEN if says >= REMARKED else PLAIN
        hidden = name in _DROP or says == HIDDEN
        if name == "header" and above[3] and not above[1] and says == PLAIN:
            hidden = False  # an article's own header holds its title
        drop = hidden or says in (MARKED, REMARKED)
        if block or drop:
            flush()
            tag = name
            if name in _ENDS:
                # an open paragraph or heading ends here, as may an item of the same kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in (name, "p"):
                        if not (stack[k][0] == "p" and name in ("td", "th", "tr")):
                            cut(k)
                        break
                    if stack[k][0] in _BARRIERS:
                        break
            above = stack[-1] if stack else outside
        if name == "a":
            link = 1
        if name in _VOID or rest.endswith("/") and not block or not (block or drop):
            continue
        root = above[3]
        if name in ("article", "main") and not root and not hidden:
            roots += 1
            root = roots
            holders.update(above[2])
        marked = above[2]
        if not hidden and drop:
            marks += 1
            marked = (*marked, marks)
            if says == REMARKED:
                remarks.add(marks)
        opened[name] += 1
        stack.append((name, above[1] or hidden, marked, root))
    say(page[at:])
    flush()

    size = [0 if b.dropped else len(b.text) - b.linked for b in out]
    held: Counter[int] = Counter()
    for n, marked in zip(size, inside):
        for x in marked:
            held[x] += n
    wrappers = {x for x, n in held.items() if 2 * n > sum(size) and (x not in remarks or x in holders)}
    for b, marked in zip(out, inside):
        b.dropped = b.dropped or not wrappers.issuperset(marked)
    return out


def classify(found: list[Block], rules: BlockRules) -> list[bool]:
    """Which blocks belong to the main text."""
    label: list[bool | None] = []
    density: list[float] = []
    for b in found:
        words = _WORD.findall(b.text.lower())
        density.append(sum(w in rules.stop_words for w in words) / len(words) if words else 0.0)
    plain = [not b.dropped and b.linked <= rules.link_share * len(b.text) for b in found]
    long = [p and len(b.text) >= rules.short for b, p in zip(found, plain)]
    known = any(p and stops >= rules.stop_low for p, stops in zip(long, density))
    for b, stops in zip(found, density):
        n = len(b.text)
        if b.dropped:
            label.append(False)
        elif b.linked > rules.link_share * n:
            label.append(None if b.root and n - b.linked >= rules.short else False)
        elif n < rules.short:
            label.append(None)
        elif not known or stops >= rules.stop_high or stops >= rules.stop_low and n >= rules.long:
            label.append(True)
        elif stops >= rules.stop_low or b.root:
            label.append(None)
        else:
            label.append(False)
    out = []
    kin: dict[tuple[int, bool], list[int]] = {}
    for i, b in enumerate(found):
        if label[i] is not None and not b.dropped:
            kin.setdefault((b.root, False), []).append(i)
            if plain[i]:
                kin.setdefault((b.root, True), []).append(i)
    for i, b in enumerate(found):
        if label[i] is not None:
            out.append(bool(label[i]))
            continue
        near = kin.get((b.root, long[i]), ())
        k = bisect(near, i)
        back = near[k - 1] if k else None
        ahead = near[k] if k < len(near) else None
        if back is None and ahead is None:
            out.append(True)
        elif back is None or ahead is None:
            out.append(bool(label[ahead if back is None else back]))
        elif label[back] == label[ahead] or i - back != ahead - i:
            out.append(bool(label[back if i - back <= ahead - i else ahead]))
        else:  # as near to either: a heading goes with what follows
            out.append(bool(label[ahead]) if b.tag[:1] == "h" else bool(b.root) or False)
    return out


def main_text(page: str, rules: BlockRules) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, classify(found, rules)) if keep)


def extract(pages: DataFrame, rules: BlockRules | None = None, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` (underscores in front if that clashes).

    A null or empty page, and one without main text, gives an empty string. The
    whole page is read and no block is capped; rows are independent."""
    rules = rules or BlockRules()
    name = free_name(pages, "main_text")
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, html):
            texts = [main_text(x or "", rules) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return map_batches(pages, run, schema)


def page_texts(pages: DataFrame, rules: BlockRules | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""
    return extract(pages.select("page_id", "url", "html"), rules).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
