"""Main text of web pages by the maximum-scoring run of tokens.

A page is a line of tokens: words and tags.  A word scores by the element
that it stands in and a tag by its name; words score nothing or more, tags
less than nothing.  The weights are log odds counted on labelled pages.  One
linear scan finds the contiguous run of highest total score.  Inside it, words
of elements that hold no article text (menus, adverts, forms, comments and the
like) are left out, and the blocks are joined.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields
from .tables import table

_OUT = fields(page_id="long", url="string", text="string", n_chars="long")
#: The rest of a tag: quotes count after '=' only, and may hold '>'.  Possessive, so a tag that never ends costs one scan.
_REST = r"(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+"
#: Raw-text elements end at their own end tag only.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select)(?=[\s/>]){_REST}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<rest>{_REST})>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
#: Elements without article text, and words of class, id or role that say so.
ASIDE = frozenset("nav header footer aside form button menu dialog head label fieldset".split())
SAID = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs header footer "
    "sidebar aside widget related comment comments reply replies respond disqus cookie cookies consent notice notices alert popup modal "
    "share sharing social newsletter subscribe signup login search pagination pager toolbar complementary contentinfo".split()
)
#: Of these, what is text inside an article; what may wrap a whole page; what never is article text, however long;
#: and first parts of class names that only tell what the page has.
OWN = frozenset("header label dialog".split())
WRAPS = frozenset("form fieldset label dialog header".split())
NEVER = frozenset("ad ads advert adverts advertisement sponsored related comment comments reply replies respond disqus cookie cookies".split())
TELLS = frozenset("has with without no not is".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
REPEATS = frozenset("li dt dd tr td th option".split())
#: Elements that hold others: on these a part of a class name counts.
HOLDS = frozenset("div section ul ol dl table span figure blockquote header center".split())


def _said(name: str, rest: str, main: bool) -> int:
    """Whether a class, id or role says that the element holds no article text: 2 by a
    name that leaves no doubt, 1 by another one or by its first or last part, else 0.

    Parts count on elements that hold others only, and an article only goes by a whole name of NEVER.
    """
    if name in ("html", "body", "main"):
        return 0
    out = 0
    for a in _MARK.findall(rest):
        for token in "".join(a).lower().split():
            parts = _PART.findall(token)
            if not parts or parts[0] in TELLS:
                continue
            if len(parts) == 1 and parts[0] in NEVER:
                return 2
            ends = parts[:1] if len(parts) == 1 else (parts[0], parts[-1]) if name in HOLDS else ()
            if name != "article" and any(w in SAID and not (main and w in OWN) for w in ends):
                out = 1
    return out


class _Elements:
    """Where the elements of a page begin and end, by places in its tokens.

    An end tag ends its element and what is still open inside; a paragraph
    ends at the next block and a list item at the next one.  What has no end
    tag of its own ends with the element around it, or at an article.
    """

    def __init__(self, found: list[re.Match]):
        self.end: dict[int, int] = {}
        self.words = [0]
        stack: list[tuple[str, int]] = []
        open_: Counter[str] = Counter()
        starts: list[int] = []
        own: set[int] = set()
        for k, m in enumerate(found):
            self.words.append(self.words[-1] + (len(m["text"].split()) if m["text"] is not None else 0))
            if not m["name"]:
                continue
            name = m["name"].lower()
            if m["end"]:
                if open_[name]:
                    while True:
                        x, i = stack.pop()
                        open_[x] -= 1
                        self.end[i] = k
                        if x == name:
                            own.add(i)
                            break
                continue
            while stack and ((stack[-1][0] == "p" and name in BLOCK) or (stack[-1][0] == name and name in REPEATS)):
                x, i = stack.pop()
                open_[x] -= 1
                own.add(i)
                self.end[i] = k
            if name in MAIN:
                starts.append(k)
            if name not in VOID and not m["rest"].endswith("/"):
                stack.append((name, k))
                open_[name] += 1
        for _, i in stack:
            self.end[i] = len(found)
        self.main = {k: self.end[k] for k in starts if k in self.end}
        for k in self.end.keys() - own:
            if k not in self.main:
                i = bisect.bisect_right(starts, k)
                self.end[k] = min(self.end[k], starts[i] if i < len(starts) else len(found))

    def most(self, k: int) -> bool:
        """Whether an element holds most of the page's words."""
        return 2 * (self.words[self.end[k]] - self.words[k]) > self.words[-1]


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, aside): 'tag' with a name (a leading slash at an end), or
    'text' with its raw characters; aside inside an element without article text.

    An element that holds most of the words, inside an article or with all
    articles in it, isn't aside for its name: there the weights decide.
    """
    found = list(_TOKEN.finditer(page))
    at = _Elements(found)
    off = [0] * (len(found) + 1)
    articles = sorted(at.main)
    inside = 0
    mains: list[int] = []
    for k, m in enumerate(found):
        while mains and mains[-1] <= k:
            mains.pop()
        if not m["name"] or m["end"] or k not in at.end:
            continue
        name, end, main = m["name"].lower(), at.end[k], bool(mains)
        sure = _said(name, m["rest"], main)
        named = name in ASIDE and not (main and name in OWN)
        if named or sure:
            free = main or not articles or (k <= articles[0] and end >= max(at.main.values()))
            spared = sure < 2 and (not named or name in WRAPS) and free and at.most(k)
            if not spared:
                off[k] += 1
                off[end] -= 1
        if k in at.main:
            mains.append(end if not mains else min(end, mains[-1]))
    for k, m in enumerate(found):
        before, inside = inside, inside + off[k]
        if m["text"] is not None:
            yield "text", m["text"], inside > 0
        elif m["raw"]:
            yield "tag", m["raw"].lower(), inside > 0
        elif m["name"]:
            yield "tag", ("/" if m["end"] else "") + m["name"].lower(), before > 0 if m["end"] else inside > 0


def _kinds(page: str) -> Iterator[tuple[str, int, str]]:
    """(feature, words, raw text) of each token; a word's feature is its innermost element."""
    stack: list[str] = []
    open_: Counter[str] = Counter()
    for kind, value, aside in tokens(page):
        if kind == "text":
            yield ("aside" if aside else "in a" if open_["a"] else "word"), len(value.split()), value
        else:
            name = value.lstrip("/")
            if value[0] == "/":
                while open_[name]:
                    x = stack.pop()
                    open_[x] -= 1
                    if x == name:
                        break
            elif name not in VOID:
                stack.append(name)
                open_[name] += 1
            yield ("<aside" if aside else "<" + name), 0, value


def labelled_pages(n: int = 120) -> list[tuple[str, str, str]]:
    """Labelled pages as (before, content, after), made by rule: a lead-in of menus
    and adverts, an article with headings, lists, links and quotations, and what follows."""
    out = []
    for i in range(n):
        words = lambda k, i=i: " ".join(f"w{(i * 31 + j * 7) % 97}" for j in range(k))
        menu = "<nav><ul>" + "".join(f'<li><a href="/{j}">{words(1 + j % 2)}</a></li>' for j in range(4 + i % 6)) + "</ul></nav>"
        advert = f'<div class="ad">{words(5 + i % 9)}</div>'
        side = f'<aside><h2>{words(2)}</h2><ul><li><a href="/x">{words(3)}</a></li></ul></aside>'
        body = f"<h1>{words(3 + i % 5)}</h1>" + "".join(
            f"<p>{words(12 + (i + j) % 30)}</p>" if j % 4 else f'<p><b>{words(6)}</b> {words(20)} <a href="/r">{words(2)}</a> {words(9)}<br>{words(5)}</p>' for j in range(3 + i % 7)
        )
        if i % 3 == 0:
            body += f"<h2>{words(3)}</h2><ul><li>{words(8)}</li><li>{words(7)}</li></ul><blockquote><p>{words(14)}</p></blockquote>"
        if i % 5 == 0:
            body += f"<table><tr><td>{words(3)}</td><td>{words(2)}</td></tr></table><pre>{words(6)}</pre>"
        if i % 2:  # what articles hold without being part of the text
            body += f"<script>y({i})</script>{advert if i % 4 == 1 else '<form><input><button>' + words(1) + '</button></form>'}<p>{words(10)}</p>"
        talk = f'<section class="comments"><p>{words(9)}</p><p>{words(11)}</p></section>' if i % 2 else f"<form><label>{words(2)}</label><input><button>{words(1)}</button></form>"
        wrap = ("<article>", "</article>") if i % 4 else ("<main><div>", "</div></main>")
        head = f"<html><head><title>{words(4)}</title><script>x()</script></head><body>{'<header><div>' + words(3) + '</div></header>' if i % 3 else ''}{menu}{advert if i % 2 else ''}"
        out.append((head + wrap[0], body, f"{wrap[1]}{side if i % 3 else ''}{talk}<footer><div>{words(6)}</div><p>{words(4)}</p></footer></body></html>"))
    return out


@functools.cache
def weights() -> dict[str, float]:
    """Log odds of each feature inside and outside the labelled content.

    Words are cut at 0 from below and tags at a little under 0 from above.
    """
    inside, outside = Counter(), Counter()
    for before, body, after in labelled_pages():
        whole = before + body + after
        at = 0
        for feature, n, raw in _spans(whole):
            where = inside if len(before) <= at < len(before) + len(body) else outside
            where[feature] += n if feature[0] != "<" else 1
            at = raw
    out = {}
    for x in inside.keys() | outside.keys():
        odds = math.log((inside[x] + 0.5) / (outside[x] + 0.5))
        out[x] = max(odds, 0.0) if x[0] != "<" else min(odds, -0.05)
    return out


def _spans(page: str) -> Iterator[tuple[str, int, int]]:
    """(feature, words, place of the token's end)."""
    ends = (m.end() for m in _TOKEN.finditer(page) if m["text"] is not None or m["raw"] or m["name"])
    for (feature, n, _), end in zip(_kinds(page), ends, strict=True):
        yield feature, n, end


UNSEEN = -0.5


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest positive sum; the first of equal ones."""
    best, at, total, run = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, run = 0.0, i
        total += s
        if total > best:
            best, at = total, (run, i + 1)
    return at


def main_text(page: str | None) -> str:
    """Blocks of the best run, joined by line ends; empty if no word scores; of runs
    that score alike the first.  Time and memory are linear in the page."""
    if not page:
        return ""
    w = weights()
    found = list(_kinds(page))
    scores = [w.get(f, UNSEEN) if f[0] == "<" else n * w.get(f, 0.0) for f, n, _ in found]
    start, end = best_run(scores)
    blocks, now = [], []
    for feature, _, raw in found[start:end]:
        if feature[0] != "<":
            if feature != "aside":
                now.append(html.unescape(raw))
        elif raw.lstrip("/") in BLOCK:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    joined = (" ".join(x.split()) for x in blocks)
    return "\n".join(x for x in joined if x)


def _extract(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for batch in arriving:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for page, url, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = main_text(raw)
                    yield page, url, text, len(text)

    yield from batches(found(), _OUT)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row, from its whole html.

    Null and empty html gives an empty text; null ids and urls stay; repeated
    rows are returned each; other columns are not read.  One pass, no shuffle.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, ddl(_OUT))


def op5_html_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
