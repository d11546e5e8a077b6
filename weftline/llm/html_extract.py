"""Operator 7, main text of web pages by equivalence-class template deduction.

Pages of a host share a template. A page's tokens are its tags, with their classes, ids and role, and its blocks of
text outside of article and main. Tokens whose occurrence vectors over the host's pages are equal form an equivalence
class (Arasu and Garcia-Molina, 2003); a class is valid if it covers at least half of the pages and has two tokens or
more. Vectors are compared by order-free sums of digests of (page, count), so that a host of any number of pages is
only counted. The valid classes' tokens are the template; elements nest them, and what lies between them are slots.
A page's text is read from the slots of its main element (article or main, else the body). Blocks of text that are of
the template are not of the page: menus and notices go that way, whatever they are called; a page that has no other
text keeps them. Elements named as menus, headers, footers, sidebars, notices, adverts, forms or reader comments are
left out, an aside in an article too; a class or id that holds such a word among others (related-research, ad-free
story) counts only if the others say nothing or the element is of the template, and outside of a main element one
that holds most of the page's text stays, whatever its class, unless it is one of comments. End tags that HTML lets one leave out are implied.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed. Null
html counts as empty; empty html has empty text; a url without host is a host of its own; repeated rows get the same
answer; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, held

#: A valid class covers this share of a host's pages, on hosts of at least MIN_PAGES.
MIN_SHARE = 0.5
MIN_PAGES = 3

# Elements by their role.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "select", "option")
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "title")
MAIN = ("article", "main")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
ROLE_WORDS = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
)
#: Those that name reader comments, which may be longer than what they comment on.
COMMENT_WORDS = ("comment", "comments", "replies", "respond")
#: An element named by a role word stays if it holds more than this share of the page's text, outside of main elements.
MOST = 0.8
#: Those that name an article's own heading when inside of it.
HEADING_WORDS = ("banner", "header", "masthead")
# Words beside a role word that say nothing of what an element holds.
NEUTRAL_WORDS = (
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "group", "inner", "item", "items", "left", "links", "list",
    "outer", "panel", "posts", "right", "section", "site", "slot", "top", "unit", "wrap", "wrapper",
)

# Elements that end an open paragraph, as HTML lets its end tag be left out, and those that hide it from them.
ENDS_P = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dl", "div", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
)
HIDES_P = ("html", "table", "td", "th", "caption", "button", "object")
# For elements whose end tag may be left out, the open elements that their like ends, and where that stops.
ENDED = {
    "li": (("li",), ("ul", "ol", "menu", "table", "article", "main", "section", "body")), "dt": (("dt", "dd"), ("dl", "table", "body")), "dd": (("dt", "dd"), ("dl", "table", "body")),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
}

_piece = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_role = re.compile(r"""(?:\b(class|id|role)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_words = re.compile(r"[a-z]+")
_roles, _headings, _neutral, _comments = frozenset(ROLE_WORDS), frozenset(HEADING_WORDS), frozenset(NEUTRAL_WORDS), frozenset(COMMENT_WORDS)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, token): kind is open, close or text; a token is a tag with its classes, ids and role."""
    for m in _piece.finditer(page):
        if m["text"] is not None:
            yield "text", m["text"], ""
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                yield "close", name, "/" + name
            else:
                marks = _role.findall(m["attributes"]) if "=" in m["attributes"] else ()
                yield "open", name, " ".join([name, *(f"{k.lower()}={(a or b or c).lower()}" for k, a, b, c in marks)])


def _block(texts: list[str]) -> str:
    return " ".join(references.unescape("".join(texts)).split())


def _text_token(block: str) -> str:
    return "#" + hashlib.blake2b(block.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def token_counts(page: str | None) -> dict[str, int]:
    """How often each token occurs on a page: tags, and blocks of text outside of main elements."""
    found: dict[str, int] = {}
    texts: list[str] = []
    inside = 0

    def end_block() -> None:
        block = _block(texts)
        texts.clear()
        if block:
            token = _text_token(block)
            found[token] = found.get(token, 0) + 1

    for kind, name, token in _tokens(page or ""):
        if kind == "text":
            if not inside:
                texts.append(name)
            continue
        found[token] = found.get(token, 0) + 1
        if name == "br":
            texts.append(" ")
        elif name in BLOCKS:
            end_block()
        if name in MAIN:
            inside = max(0, inside + (1 if kind == "open" else -1))
    end_block()
    return found


def _unwanted(token: str, inside: bool, template: set[str] | None) -> str:
    """Why an element is a menu, header, footer, sidebar, notice, advert, form or reader comment: by what it is, by its
    names, or by the names of comments; empty if it is none.

    A class or id that holds such a word among others (related-research, ad-free story) counts only if the others say
    nothing, or the element is of the host's template.
    """
    name, *marks = token.split(" ")
    if name in BOILERPLATE:
        return "" if inside and name == "header" else "element"
    # the element that holds the whole page may be named after what surrounds the text
    if name in ("html", "body", *MAIN):
        return ""
    for mark in marks:
        words = set(_words.findall(mark.partition("=")[2]))
        named = words & ((_roles - _headings) if inside else _roles)
        if named and (words <= _roles | _neutral or (template is not None and token in template)):
            return "comments" if named & _comments else "name"
    return ""


def _left_open(name: str, stack: list) -> int:
    """How many open elements the opening of name ends, of those whose end tags were left out."""
    depth = 0
    if name in ENDS_P:
        depth = _to(stack, ("p",), HIDES_P)
    if name in ENDED:
        depth = max(depth, _to(stack, *ENDED[name]))
    return depth


def _to(stack: list, ended: tuple[str, ...], stops: tuple[str, ...]) -> int:
    """The number of open elements down to the outermost of ended that no stop hides; none: 0."""
    found = 0
    for depth, element in enumerate(reversed(stack), 1):
        if element[0] in stops:
            break
        if element[0] in ended:
            found = depth
    return found


def _held_text(page: str) -> tuple[list[int], int]:
    """Characters of text, white space aside, in each opened element in order, and on the page."""
    sizes: list[int] = []
    stack: list[tuple[str, int, int]] = []  # name, number, characters before it
    total = 0

    def end(n: int) -> None:
        for _ in range(n):
            _, number, before = stack.pop()
            sizes[number] = total - before

    for kind, name, _ in _tokens(page):
        if kind == "text":
            total += sum(map(len, name.split()))
        elif kind == "open":
            end(_left_open(name, stack))
            sizes.append(0)
            if name not in VOID:
                stack.append((name, len(sizes) - 1, total))
        elif any(e[0] == name for e in stack):
            end(next(i for i, e in enumerate(reversed(stack), 1) if e[0] == name))
    end(len(stack))
    return sizes, total


def extract(page: str | None, template: set[str] | None) -> str:
    """The text in the slots of a page's main element. template: the host's tokens in valid classes, None if not known."""
    page = page or ""
    stack: list[tuple[str, bool]] = []  # open elements, and whether text in them is not wanted
    slots: list[tuple[bool, list[str]]] = [(False, [])]  # blocks, and whether they are of the main element
    inside = dropped = 0
    found_main = False
    sizes: tuple[list[int], int] | None = None
    number = -1

    def end(n: int) -> None:
        nonlocal inside, dropped
        for _ in range(n):
            name, unwanted = stack.pop()
            dropped -= unwanted
            if name in MAIN and inside and not dropped:
                inside -= 1
            if name in BLOCKS:
                slots.append((inside > 0, []))

    for kind, name, token in _tokens(page):
        if kind == "text":
            if not dropped:
                slots[-1][1].append(name)
            continue
        if kind == "open":
            number += 1
            end(_left_open(name, stack))
        if name in BLOCKS:
            slots.append((inside > 0, []))
        if name in VOID:
            if name == "br" and not dropped:
                slots[-1][1].append(" ")
            continue
        if kind == "open":
            # every element is open, so that a closing tag ends the one that it belongs to
            why = "" if dropped else _unwanted(token, inside > 0, template)
            if why == "name" and not inside:
                sizes = sizes or _held_text(page)
                why = "" if sizes[0][number] > MOST * sizes[1] else why
            stack.append((name, bool(why)))
            dropped += bool(why)
            if name in MAIN and not dropped:
                inside += 1
                found_main = True
                slots[-1] = (True, [])
        elif any(n == name for n, _ in stack):
            end(next(i for i, (n, _) in enumerate(reversed(stack), 1) if n == name))
    blocks = [b for b in (_block(texts) for main, texts in slots if main or not found_main) if b]
    if template and not found_main:
        blocks = [b for b in blocks if _text_token(b) not in template] or blocks
    return "\n".join(blocks)


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens in valid equivalence classes of each host's pages. pages has host, key and html."""

    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in parts:
            yield pd.Series([[{"token": t, "n": n} for t, n in token_counts(h).items()] for h in htmls], dtype=object)

    counts = F.pandas_udf(counted, "array<struct<token:string,n:int>>")
    each = pages.select("host", "key", F.inline(F.concat(counts("html"), F.array(F.struct(F.lit("").alias("token"), F.lit(1).alias("n"))))))
    # the occurrence vector of a token, digested by two sums, in which a page that is listed twice counts twice
    seen = F.xxhash64("key", "n")
    digest = F.struct(F.sum(seen.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(seen, 32)).alias("high"))
    vectors = each.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), digest.alias("vector"))
    vectors = held(vectors)
    hosts = vectors.where("token = ''").select("host", F.col("pages").alias("of"))
    wide = vectors.where("token != ''").join(hosts, "host").where((F.col("of") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("of")))
    # tokens of a class occur on half of the pages or more, so a class is no longer than two pages
    classes = wide.groupBy("host", "vector", "pages", "total").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= 2)
    return classes.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("template"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.col("url"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.lower(host).alias("host"))
    templates = held(host_templates(rows.select("host", "html", F.xxhash64("page_id", "url").alias("key"))))
    size = templates.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    # a host may hold any share of the pages: the join splits it, or is a broadcast within the bound
    found = rows.join(F.broadcast(templates) if size <= BROADCAST_ROWS // 10 else templates, "host", "left")

    def extracted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, ...], set[str]] = {}
        for htmls, templates in parts:
            out = []
            for h, t in zip(htmls, templates):
                key = () if t is None else tuple(t)
                if key not in known:
                    if len(known) > 256:
                        known.clear()
                    known[key] = set(key)
                out.append(extract(h, known[key] if key else None))
            yield pd.Series(out, dtype=object)

    text = F.pandas_udf(extracted, "string")
    return found.select("page_id", "url", text("html", "template").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
