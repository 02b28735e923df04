"""Main text of web pages by two passes over blocks.

The first pass labels each block by itself, from its length, the density of
function words and the density of links; short blocks, and blocks with few
function words, stay undecided.  The second pass gives these the label of the
nearest decided neighbours.  Regions that state their purpose (menus, forms,
sidebars, notices, adverts, comments) are out before the first pass, and if a
page marks its article, blocks outside it are; the mark is evidence for those
inside, which the two passes then decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.llm.common import text_batches
from pricebench.llm.stop_words import STOP_WORDS

SHORT_WORDS = 12
DENSE, SPARSE = 0.2, 0.1  # share of function words of text, and below which it rather isn't text
LINKS = 0.33

# Element names of HTML.
_RAW = "script|style|noscript|template|iframe|textarea|svg|math|object|title|select|canvas|audio|video"
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form menu dialog button fieldset head".split())
_ARTICLE = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

#: Parts of class and id names that state a purpose; the first ones as beginnings of a part.
_OUT_STEMS = ("advert", "sponsor", "promo", "nav", "menu", "breadcrumb", "sidebar", "comment", "cookie", "consent", "newsletter", "subscri", "signup",
              "popup", "modal", "overlay", "banner", "masthead", "pagination", "disqus", "gdpr", "footer", "recommend", "respond", "teaser", "widget", "toolbar")
_OUT_PARTS = frozenset("ad ads adbox adslot adsense notice notices alert aside pager share sharing social related login search hidden skip disclaimer copyright replies reply".split())
_IN_PARTS = frozenset("article content post entry story main body text".split())

# Attributes up to the end of a tag.  A quoted value may hold ">"; one whose quote never closes takes the rest of the page.
_REST = r"""(?:[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{_RAW})(?=[\s/>]|\Z){_REST}(?:(?<=/)>|>.*?(?:</(?P=raw)(?:>|[\s/][^>]*+(?:>|\Z))|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*+)(?:\s*+=\s*+("[^"]*+"?+|'[^']*+'?+|[^\s>]*+))?+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    link_chars: int
    heading: bool
    paragraph: bool
    in_article: bool
    out: bool  # inside a region that is not main text


def _states_other_purpose(name: str, rest: str) -> bool:
    if name in _OUT:
        return True
    if name in ("html", "body") or name in _ARTICLE and "comment" not in rest.lower():
        return False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _OUT_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id"):
            parts = [p.lower() for p in _PART.findall(value)]
            if any(p in _OUT_PARTS or p.startswith(_OUT_STEMS) for p in parts):
                return True
            if "header" in parts and not _IN_PARTS & set(parts):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order: runs of text between block-level tags."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, out, in an article, in a page header
    names: Counter[str] = Counter()  # of the stack
    text: list[str] = []
    links = link_chars = at = 0

    def flush() -> None:
        nonlocal link_chars
        if text and (joined := " ".join(html.unescape("".join(text)).split())):
            _, is_out, article, header = stack[-1] if stack else ("", False, False, False)
            heading = any(s[0] in _HEADINGS for s in stack[-2:])
            out.append(Block(joined, link_chars, heading, bool(stack) and stack[-1][0] == "p", article, is_out or header and not (article and heading)))
        text.clear()
        link_chars = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                link_chars += len(piece.strip())
        at = m.end()
        name = m["name"] and m["name"].lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if m["end"] else 1))
        elif name in _BLOCKS or name == "button":
            flush()
            links = 0
            if m["end"]:
                closed = None if names[name] else name  # nothing to close: the tag is passed over
                while closed != name:
                    closed = stack.pop()[0]
                    names[closed] -= 1
            elif name not in _VOID:
                if stack and stack[-1][0] == "p":
                    names[stack.pop()[0]] -= 1  # a paragraph ends where the next block begins
                _, is_out, article, header = stack[-1] if stack else ("", False, False, False)
                stack.append((name, is_out or _states_other_purpose(name, m["rest"]), article or name in _ARTICLE, header or name == "header"))
                names[name] += 1
    text.append(page[at:])
    flush()
    return out


def first_pass(b: Block) -> bool | None:
    """Whether a block by itself is main text; None if that can't be told."""
    words = b.text.split()
    if b.link_chars > LINKS * len(b.text):
        return False
    if len(words) < SHORT_WORDS:
        return False if b.link_chars and not b.in_article else None
    known = sum(w.strip(".,;:!?\"'()#*$%&|").lower() in STOP_WORDS for w in words) / len(words)
    if known >= DENSE:
        return True
    # A paragraph or heading without links, or a block of the marked article, may be text of a language or kind that the list doesn't know.
    return None if known >= SPARSE or b.in_article or (b.paragraph or b.heading) and not b.link_chars else False


def second_pass(labels: list[bool | None], blocks: list[Block]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block; at equal distance main text wins in articles and for headings and paragraphs."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if labels[i] is not None else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    out = []
    for i, (label, b) in enumerate(zip(labels, blocks)):
        if label is None:
            left, right = before[i], after[i]
            lean = b.in_article or b.heading or b.paragraph
            if left is None and right is None:
                label = True  # nothing on the page speaks against it
            elif left is None or right is None:
                label = labels[right if left is None else left]
            elif labels[left] == labels[right] or i - left != right - i:
                label = labels[left if i - left <= right - i else right]
            else:
                label = lean
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    blocks = [b for b in blocks_of(page or "") if not b.out]
    if any(b.in_article for b in blocks):
        blocks = [b for b in blocks if b.in_article]
    kept = second_pass([first_pass(b) for b in blocks], blocks)
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole ``column``; a null or empty page, or one without main text, gives "".

    Markup may be broken or cut off anywhere; as in browsers, a tag that never ends
    (also one with an open quote) takes the rest of the page.  Rows are independent: repeated
    rows repeat, an empty table stays empty, other columns pass through (one
    named like ``out`` is replaced).
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html_pages in batches:
            yield pd.Series([main_text(p) for p in html_pages], dtype=object)

    return text_batches(pages).withColumn(out, run(F.col(column)))


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: What the pages of the given tables show as their article, whose text is in h1 and p; a page of another make has no such statement.
ORACLE = """
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's') t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(replace(t, '<br>', ' '), '</?b>', '', 'g'), '<[^>]*$', ''), '</?(p|h1)>'),
  lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') x FROM a)
SELECT page_id, url, array_to_string(x, chr(10)) AS text, length(array_to_string(x, chr(10)))::BIGINT n_chars FROM b
"""
