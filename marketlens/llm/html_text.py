"""Operator 9: main text of web pages from shallow block features and a decision tree.

A page is read once, tag by tag, into flat text blocks (split at block-level tags).  A block
has its number of words and link density and those of the blocks before and after it, and what its
surroundings say: whether an enclosing element is marked as something else than the
article, whether one hints at it, whether the block is inside an article element, and whether the page
has one.  A decision tree, trained on the small labelled table below, says which blocks are
main text; these are joined in page order.  Where a page has no article element, the words and the
links of a block and its neighbours decide.

Marks.  What HTML itself calls something else than the article (navigation, footers, asides, hidden
elements, site headers) is never text.  A whole word of class or id, or a role, marks an element; a part
of such a word (``related-posts``) is a hint only, none at all on a paragraph or heading or as a layout flag
(``no-sidebar``).  An element that holds the page's article, or most of its words, is its
wrapper, whatever its class says.

Scale: pages are independent, so this is one scan without a shuffle, a page at a time, in time
proportional to the page's length: the places of open elements are kept by name, so a stray end tag costs
nothing, and a tag is read as browsers do (a lone quote does not hide its end).

Defined results: null, empty or blank html gives an empty text; a null url or page_id is
passed on; repeated rows give repeated results; unclosed comments and scripts run to the end
of the page, other unclosed elements to the end of what holds them; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices

# HTML element names by the role that they play here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead"
    " tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Never text of the page.
HARD_TAGS = frozenset("aside button dialog footer head menu nav search".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose whole content is skipped, to the end of the page or only if they are closed.
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
RAW_IF_CLOSED = frozenset("template select svg object math canvas video audio".split())
#: An element ends where the next one of its kind begins within the same holder.
ITEMS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "option": ("option", "select"),
}
ITEMS = {tag: (ends.split(), holders.split()) for tag, (ends, holders) in ITEMS.items()}

#: Words of class and id that mark an element, alone or, as a hint, as a part of a longer word.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr login"
    " menu menubar modal nav navbar navigation newsletter pagination pager popup promo promoted promotion promotions recommended related search"
    " share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar widget widgets teaser teasers outbrain taboola"
    " paywall".split()
)
#: The same, but no hint as parts.
WHOLE_MARKS = frozenset("alert announcement hidden notice notices reactions discussion replies reply respond warning complementary contentinfo dialog".split())
#: The page's head, unless inside the article.
HEADER_MARKS = frozenset("header masthead".split())
#: Reader comments, alone or as a part.
COMMENT_MARKS = frozenset("comment comments commentlist disqus respond".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: First parts that say what a layout has or lacks.
FLAGS = frozenset("has is no not with without".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attributes2>[^>]*+)>"
    r"|<[!?/][^>]*+>|<[a-z!?/][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Blocks of so many words are prose.
PROSE = 20

#: The labelled table: words, link density, words and link density of the block before and of
#: the block after, marked (an enclosing element is marked), hint (an enclosing one hints at it), inside
#: an article element, the page has an article element, heading; then 1 for main text.
COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "marked", "hint", "inside", "has_article", "heading")
LABELLED = """
60 0.0 50 0.0 55 0.0 0 0 0 0 0 1
25 0.1 40 0.0 30 0.0 0 0 0 0 0 1
45 0.0 70 0.0 3 0.0 0 0 0 0 0 1
60 0.0 2 1.0 3 1.0 0 0 0 0 0 1
80 0.0 3 0.0 4 0.0 0 0 0 0 0 1
60 0.2 3 1.0 30 0.0 0 0 0 0 0 1
45 0.1 4 1.0 2 0.0 0 0 0 0 0 1
18 0.0 60 0.0 40 0.0 0 0 0 0 0 1
12 0.0 60 0.0 50 0.0 0 0 0 0 0 1
3 0.0 60 0.0 50 0.0 0 0 0 0 0 1
2 0.0 40 0.0 60 0.0 0 0 0 0 0 1
4 0.0 30 0.0 25 0.0 0 0 0 0 0 1
9 0.0 22 0.0 0 0.0 0 0 0 0 0 1
12 0.0 30 0.0 0 0.0 0 0 0 0 0 1
14 0.0 12 0.0 16 0.0 0 0 0 0 0 1
11 0.0 9 0.0 14 0.0 0 0 0 0 0 1
17 0.0 0 0.0 30 0.0 0 0 0 0 0 1
7 0.0 0 0.0 40 0.0 0 0 0 0 0 1
22 0.0 0 0.0 0 0.0 0 0 0 0 0 1
24 0.0 2 1.0 30 0.0 0 0 0 0 0 1
19 0.0 1 1.0 26 0.1 0 0 0 0 0 1
18 0.0 40 0.0 2 1.0 0 0 0 0 0 1
26 0.0 30 0.0 4 1.0 0 0 0 0 0 1
5 0.0 2 1.0 70 0.0 0 0 0 0 1 1
8 0.0 3 1.0 50 0.0 0 0 0 0 1 1
4 0.0 1 1.0 12 0.0 0 0 0 0 1 1
6 0.0 70 0.0 60 0.0 0 0 0 0 1 1
4 0.0 25 0.0 9 0.0 0 0 0 0 1 1
3 0.0 0 0.0 9 0.0 0 0 0 0 1 1
2 1.0 2 1.0 2 1.0 0 0 0 0 0 0
3 1.0 0 0.0 2 1.0 0 0 0 0 0 0
4 0.7 2 1.0 60 0.0 0 0 0 0 0 0
6 0.6 80 0.0 3 1.0 0 0 0 0 0 0
60 0.6 2 1.0 3 1.0 0 0 0 0 0 0
20 0.9 5 1.0 5 1.0 0 0 0 0 0 0
40 0.8 60 0.0 50 0.0 0 0 0 0 0 0
7 1.0 60 0.0 40 0.0 0 0 0 0 0 0
12 0.0 3 1.0 5 1.0 0 0 0 0 0 0
14 0.0 8 1.0 10 1.0 0 0 0 0 0 0
18 0.0 6 1.0 5 1.0 0 0 0 0 0 0
10 0.0 2 1.0 3 0.0 0 0 0 0 0 0
22 0.0 5 1.0 6 1.0 0 0 0 0 0 0
28 0.1 7 1.0 4 1.0 0 0 0 0 0 0
3 0.0 2 1.0 3 0.0 0 0 0 0 0 0
3 0.0 4 0.0 2 1.0 0 0 0 0 0 0
5 0.0 3 0.0 0 0.0 0 0 0 0 0 0
4 0.0 0 0.0 2 1.0 0 0 0 0 0 0
3 0.0 80 0.0 0 0.0 0 0 0 0 0 0
4 0.0 60 0.0 3 1.0 0 0 0 0 0 0
2 0.0 3 0.0 2 0.0 0 0 0 0 0 0
4 0.0 3 0.0 5 1.0 0 0 0 0 0 0
3 0.0 2 1.0 2 1.0 0 0 0 0 1 0
2 0.0 40 0.0 3 1.0 0 0 0 0 1 0
2 0.0 3 1.0 4 1.0 0 0 0 0 1 0
9 0.0 8 0.0 60 0.0 0 0 1 1 1 1
9 0.0 0 0.0 2 1.0 0 0 1 1 1 1
2 0.0 40 0.0 3 1.0 0 0 1 1 1 1
60 0.0 9 0.0 80 0.0 0 0 1 1 0 1
60 0.0 9 0.0 3 0.0 0 0 1 1 0 1
1 0.0 60 0.0 40 0.0 0 0 1 1 0 1
2 0.0 1 0.0 3 0.0 0 0 1 1 0 1
1 0.0 2 0.0 9 0.0 0 0 1 1 0 1
120 0.1 40 0.0 1 0.0 0 0 1 1 0 1
5 1.0 60 0.0 30 0.0 0 0 1 1 0 1
3 1.0 4 1.0 5 1.0 0 0 1 1 0 1
4 0.0 4 0.0 0 0.0 0 0 1 1 0 1
80 0.0 90 0.0 5 0.0 0 0 1 1 0 1
7 0.6 20 0.0 4 0.0 0 0 1 1 0 1
30 0.0 2 1.0 30 0.0 0 0 0 1 0 0
90 0.0 3 0.0 20 0.0 0 0 0 1 0 0
60 0.0 40 0.0 70 0.0 0 0 0 1 0 0
7 0.0 50 0.0 2 0.0 0 0 0 1 0 0
9 0.0 3 1.0 80 0.0 0 0 0 1 0 0
5 0.0 2 1.0 2 1.0 0 0 0 1 1 0
6 0.0 30 0.0 60 0.0 0 0 0 1 1 0
2 1.0 2 1.0 2 1.0 0 0 0 1 0 0
40 0.2 60 0.0 50 0.0 0 0 0 1 0 0
1 1.0 0 0.0 1 1.0 1 0 0 1 0 0
8 0.0 1 1.0 60 0.0 1 0 0 1 0 0
60 0.0 80 0.0 70 0.0 1 0 0 1 0 0
5 0.0 70 0.0 80 0.0 1 0 0 1 1 0
30 0.0 1 1.0 9 0.0 1 0 0 0 0 0
80 0.0 60 0.0 70 0.0 1 0 0 0 0 0
50 0.0 40 0.0 90 0.0 1 0 0 0 0 0
14 0.0 40 0.0 30 0.0 1 0 0 0 0 0
9 0.0 40 0.0 60 0.0 1 0 0 0 1 0
14 0.0 40 0.0 30 0.0 1 0 1 1 0 0
35 0.0 50 0.0 35 0.0 1 0 1 1 0 0
70 0.0 60 0.0 90 0.0 1 0 1 1 0 0
3 0.0 50 0.0 0 0.0 1 0 1 1 1 0
20 0.3 3 0.0 40 0.0 1 0 1 1 0 0
6 0.0 40 0.0 60 0.0 1 0 1 1 0 0
8 0.0 60 0.0 3 1.0 0 1 1 1 0 0
4 0.0 50 0.0 60 0.0 0 1 1 1 0 0
6 1.0 50 0.0 5 1.0 0 1 1 1 0 0
12 0.2 60 0.0 0 0.0 0 1 1 1 0 0
30 0.8 60 0.0 30 0.8 0 1 1 1 0 0
5 0.0 3 0.0 60 0.0 0 1 1 1 1 1
9 0.0 0 0.0 40 0.0 0 1 1 1 1 1
3 0.0 60 0.0 4 1.0 0 1 1 1 1 0
2 0.0 40 0.0 7 0.0 0 1 1 1 1 0
45 0.0 60 0.0 50 0.0 0 1 1 1 0 1
60 0.1 5 0.0 40 0.0 0 1 1 1 0 1
30 0.0 40 0.0 3 0.0 0 1 1 1 0 1
40 0.0 50 0.0 60 0.0 0 1 0 1 0 0
8 0.0 50 0.0 60 0.0 0 1 0 1 0 0
12 0.0 60 0.0 50 0.0 0 1 0 0 0 0
30 0.0 60 0.0 50 0.0 0 1 0 0 0 0
4 0.0 60 0.0 50 0.0 0 1 0 0 0 0
6 0.0 60 0.0 20 0.0 0 1 0 0 1 0
60 0.0 2 1.0 3 1.0 0 1 0 0 0 0
58 0.0 0 0.0 15 0.0 0 0 1 1 0 1
1 0.0 38 0.1 73 0.1 0 0 1 1 1 1
122 0.0 16 0.0 118 0.1 0 0 1 1 0 1
63 0.4 0 0.0 43 0.0 0 0 1 1 0 1
54 0.1 0 0.0 47 0.0 0 0 1 1 1 1
119 0.0 10 0.0 0 0.0 0 0 1 1 0 1
55 0.0 4 1.0 4 1.0 0 0 1 1 0 1
50 0.0 0 0.0 46 0.1 0 0 1 1 1 1
145 0.0 24 0.0 2 1.0 0 0 1 1 0 1
3 0.0 1 0.0 0 0.0 0 0 1 1 0 1
14 0.0 58 0.1 82 0.1 0 0 1 1 0 1
16 1.0 0 0.0 25 0.0 0 0 1 1 0 1
1 0.0 1 0.0 110 0.1 0 0 1 1 0 1
50 0.0 13 0.0 0 0.0 0 0 1 1 0 1
124 0.1 26 0.0 48 0.0 0 0 1 1 0 1
114 0.1 9 0.0 19 0.0 0 0 1 1 0 1
5 1.0 100 0.0 1 1.0 0 0 1 1 1 1
12 0.4 100 0.0 4 0.0 0 0 1 1 0 1
15 1.0 41 0.0 10 0.0 0 0 1 1 0 1
57 0.0 107 0.0 51 0.0 0 0 1 1 0 1
17 0.1 11 0.0 8 1.0 0 0 1 1 0 1
3 1.0 55 0.1 18 0.1 0 0 1 1 0 1
2 0.0 0 0.0 0 0.0 0 0 1 1 0 1
21 0.0 8 1.0 1 1.0 0 0 1 1 0 1
26 0.0 80 0.1 36 0.0 0 0 1 1 0 1
132 0.0 1 1.0 10 0.0 0 0 1 1 0 1
13 0.0 98 0.1 0 0.0 0 0 1 1 0 1
20 0.0 60 0.1 0 0.0 0 0 1 1 0 1
5 0.0 0 0.0 82 0.0 0 0 0 1 0 0
6 0.0 15 0.0 67 0.0 0 0 0 1 0 0
46 1.0 76 0.1 4 1.0 0 0 0 1 0 0
4 0.0 5 1.0 6 1.0 0 0 0 1 0 0
2 0.1 128 0.0 0 0.0 0 0 0 1 0 0
19 0.0 94 0.1 45 0.1 0 0 0 1 0 0
35 0.0 129 0.0 0 0.0 0 0 0 1 0 0
73 0.0 85 0.1 0 0.0 0 0 0 1 0 0
21 0.1 13 0.0 4 1.0 0 0 0 1 1 0
1 1.0 4 1.0 3 1.0 0 0 0 1 1 0
6 1.0 0 0.0 7 0.0 0 0 0 1 1 0
42 0.0 0 0.0 7 1.0 0 0 0 1 0 0
14 0.0 57 0.0 106 0.1 0 0 0 1 1 0
47 0.1 0 0.0 36 0.0 0 0 0 1 0 0
49 1.0 12 0.0 6 1.0 0 0 0 1 0 0
21 0.0 101 0.0 7 1.0 0 0 0 1 0 0
49 1.0 113 0.0 18 0.0 0 0 0 1 0 0
72 1.0 98 0.0 0 0.0 0 0 0 1 0 0
83 0.3 0 0.0 113 0.0 1 0 1 1 0 0
8 0.0 9 0.0 5 0.0 1 0 1 1 0 0
33 0.3 90 0.0 68 0.1 1 1 1 1 1 0
135 0.0 8 1.0 4 1.0 1 1 0 1 0 0
143 0.0 2 0.0 1 1.0 1 0 0 1 1 0
24 0.0 7 1.0 12 0.0 1 0 1 1 0 0
7 0.0 6 1.0 4 1.0 1 1 0 1 0 0
10 0.3 1 1.0 29 0.0 1 0 0 1 1 0
5 0.3 8 0.0 6 0.0 1 0 0 1 0 0
3 0.0 65 0.0 11 0.0 1 1 0 1 0 0
8 0.0 2 1.0 3 0.0 0 0 0 0 0 0
9 0.0 3 1.0 2 0.0 0 0 0 0 0 0
15 0.0 4 1.0 2 0.0 0 0 0 0 0 0
14 0.0 2 1.0 0 0.0 0 0 0 0 0 0
13 0.0 25 0.0 2 0.0 0 0 0 0 0 1
10 0.0 40 0.0 3 0.0 0 0 0 0 0 1
16 0.0 18 0.0 0 0.0 0 0 0 0 0 1
8 0.0 12 0.0 3 0.0 0 1 1 1 0 0
5 0.0 2 1.0 9 0.0 0 1 1 1 0 0
3 1.0 2 1.0 2 1.0 0 1 1 1 0 0
12 0.0 4 0.0 60 0.0 0 1 1 1 0 0
20 0.0 5 0.0 3 0.0 0 1 1 1 0 0
2 0.5 0 0.0 80 0.0 0 1 1 1 0 0
30 0.9 5 0.0 40 0.0 0 1 1 1 0 0
7 0.0 90 0.0 80 0.0 0 1 1 1 1 1
28 0.0 8 0.0 2 1.0 0 1 1 1 0 1
35 0.1 3 1.0 9 0.0 0 1 1 1 0 1
40 0.9 60 0.0 30 0.0 0 1 1 1 0 0
50 0.7 4 1.0 9 0.0 0 1 1 1 0 0
40 0.9 5 0.0 2 0.0 0 0 0 0 0 0
3 0.0 4 0.0 6 0.0 0 0 0 0 0 0
5 0.0 3 1.0 6 0.0 0 0 0 0 0 0
10 0.0 2 1.0 8 0.0 0 0 0 0 0 0
6 0.0 2 1.0 12 0.0 0 0 0 0 0 0
5 0.0 0 0.0 6 0.0 0 0 0 0 0 0
70 0.0 5 0.0 2 0.0 0 0 0 0 0 1
35 0.1 4 0.0 6 0.0 0 0 0 0 0 1
40 1.0 30 0.0 55 1.0 0 0 0 0 0 0
30 0.8 70 0.0 40 0.9 0 0 0 0 0 0
"""


def labelled_table() -> list[tuple[tuple[float, ...], int]]:
    rows = [tuple(map(float, line.split())) for line in LABELLED.split("\n") if line]
    return [(r[:-1], int(r[-1])) for r in rows]


@dataclass
class Node:
    """A leaf (``column`` < 0) says ``value``; otherwise rows with column < limit go left."""

    value: int
    column: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 12) -> Node:
    """A decision tree by lowest Gini impurity; the first column wins ties."""
    ones = sum(y for _, y in rows)
    node = Node(int(2 * ones > len(rows)))
    if depth == 0 or ones in (0, len(rows)):
        return node
    best = None
    for column in range(len(rows[0][0])):
        values = sorted({x[column] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            limit = (a + b) / 2
            impurity = 0.0
            for side in ([y for x, y in rows if x[column] < limit], [y for x, y in rows if x[column] >= limit]):
                p = sum(side) / len(side)
                impurity += len(side) * p * (1 - p)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, limit)
    if best is None:
        return node
    _, node.column, node.limit = best
    node.left = grow([r for r in rows if r[0][node.column] < node.limit], depth - 1)
    node.right = grow([r for r in rows if r[0][node.column] >= node.limit], depth - 1)
    return node


def decide(node: Node, x: tuple[float, ...]) -> int:
    while node.column >= 0:
        node = node.left if x[node.column] < node.limit else node.right
    return node.value


@lru_cache(maxsize=4096)
def word_marks(value: str) -> frozenset[str]:
    """What the words of a class or id say: marked, header, comment, hint (of a comment or other)."""
    said = set()
    for word in value.split():
        parts = [p.lower() for p in re.split(r"[-_]+", CAMEL.sub("-", word)) if p]
        if not parts or parts[0] in FLAGS:
            continue
        whole = word.lower()
        if whole in COMMENT_MARKS:
            said.add("comment")
        elif whole in MARKS or whole in WHOLE_MARKS:
            said.add("marked")
        elif whole in HEADER_MARKS:
            said.add("header")
        elif len(parts) > 1:
            if COMMENT_MARKS & set(parts):
                said.add("comment-hint")
            elif MARKS & set(parts):
                said.add("hint")
    return frozenset(said)


def marks(tag: str, attributes: str) -> tuple[bool, str]:
    """Of an element: is it hidden, and its mark ("" for none, else marked, site, form, comment or hint)."""
    said = {"form": "form", "header": "site"}.get(tag, "")
    if not attributes or tag in ("body", "html"):
        return False, said
    container = tag != "p" and tag not in HEADINGS and tag not in ("li", "td", "blockquote", "main")
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, said
        if name == "role" and value.lower() in ROLES and tag != "main":
            said = "marked"
        elif name in ("class", "id") and value and tag != "main":
            found = word_marks(value)
            if "comment" in found or ("comment-hint" in found and container):
                said = "comment"
            elif "marked" in found and said != "comment":
                said = "marked"
            elif "header" in found and not said:
                said = "site"
            elif "hint" in found and container and not said:
                said = "hint"
    return False, said


@dataclass
class Block:
    text: str
    words: int
    links: float
    hard: bool
    heading: bool


@dataclass
class Element:
    """An article element, or one that is marked: its blocks, and the last element inside it."""

    kind: str
    within: bool
    start: int
    end: int = 0
    last: int = 0


class Reader:
    """Blocks and noted elements of a page, in order."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, hidden, place among the elements or -1
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
        self.hard = self.articles = 0
        self.link = self.through = self.body = False
        self.read(page)
        self.close(0)

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split())
        if text:
            words = text.count(" ") + 1
            in_links = len(html.unescape(" ".join(self.linked)).split()) if self.linked else 0
            heading = bool(self.open) and self.open[-1][0] in HEADINGS
            self.blocks.append(Block(text, words, min(1.0, in_links / words), self.hard > 0, heading))
        self.pieces.clear()
        self.linked.clear()

    def close(self, n: int) -> None:
        """Close the open elements from place n on."""
        self.flush()
        for tag, hidden, place in reversed(self.open[n:]):
            self.places[tag].pop()
            self.hard -= hidden
            self.articles -= tag in ARTICLE_TAGS
            if place >= 0:
                self.elements[place].end = len(self.blocks)
                self.elements[place].last = len(self.elements) - 1
        del self.open[n:]

    def begin(self, tag: str, attributes: str) -> None:
        """Open an element."""
        self.flush()
        hidden, said = marks(tag, attributes)
        hidden = hidden or tag in HARD_TAGS
        if said == "site" and self.articles:
            said = ""
        place = -1
        if said or tag in ARTICLE_TAGS:
            place = len(self.elements)
            self.elements.append(Element(("article " if tag in ARTICLE_TAGS else "") + said, self.articles > 0, len(self.blocks)))
        self.places[tag].append(len(self.open))
        self.open.append((tag, hidden, place))
        self.hard += hidden
        self.articles += tag in ARTICLE_TAGS

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        if self.link:
            self.linked.append(piece)

    def read(self, page: str) -> None:
        at, unclosed = 0, set()
        while m := TOKEN.search(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, end, attributes = tag.lower(), m["end"] or m["end2"], m["attributes"] or m["attributes2"] or ""
            if tag in RAW_TAGS or tag in RAW_IF_CLOSED:
                if not end and tag not in unclosed:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if close:
                        at = close.end()
                    elif tag in RAW_TAGS:
                        at = len(page)
                    else:
                        unclosed.add(tag)
            elif tag == "br":
                self.pieces.append(" ")
            elif tag == "a":
                self.link = not end and "href" in attributes.lower()
                if self.link:  # without an end of its own, a link ends with its block
                    close = NEXT_LINK.search(page, at)
                    self.through = bool(close and close[1])
            elif tag in BLOCK_TAGS:
                self.block(tag, end, attributes)
                self.link = self.link and self.through
            elif end:
                if self.places[tag]:
                    self.close(self.places[tag][-1])
            elif tag in HARD_TAGS or (attributes and tag in ("span", "ins", "center", "font", "section") and any(marks(tag, attributes))):
                self.begin(tag, attributes)
        self.text(page[at:])

    def block(self, tag: str, end: str, attributes: str) -> None:
        if end:
            if self.places[tag]:
                self.close(self.places[tag][-1])
            else:
                self.flush()
            return
        if tag in ("body", "html"):  # the body ends the head; a second one says nothing
            if tag == "body" and not self.body:
                self.close(0)
            self.flush()
            self.body = self.body or tag == "body"
            return
        # a paragraph or heading ends where the next block begins, an item where the next one begins
        if self.open and (self.open[-1][0] == "p" or self.open[-1][0] in HEADINGS):
            self.close(len(self.open) - 1)
        if tag in ITEMS:
            ends, holders = ITEMS[tag]
            floor = max((self.places[h][-1] for h in holders if self.places[h]), default=-1)
            inner = [i for e in ends for i in self.places[e][-1:] if i > floor]
            if inner:
                self.close(min(inner))
        if tag in VOID_TAGS:
            self.flush()
        else:
            self.begin(tag, attributes)


def covered(n: int, spans: list[tuple[int, int]]) -> list[bool]:
    """For n blocks: does one of the spans hold it?"""
    edges = [0] * (n + 1)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    return [c > 0 for c in accumulate(edges[:n])]


def features(page: str) -> tuple[list[Block], list[tuple[float, ...]]]:
    """The page's blocks and their columns of the labelled table."""
    read = Reader(page)
    found, elements = read.blocks, read.elements
    n = len(found)
    upto = [0, *accumulate(0 if b.hard else b.words for b in found)]
    words = lambda e: upto[e.end] - upto[e.start]

    own = [i for i, e in enumerate(elements) if e.kind.startswith("article")]
    said = {i: e.kind.removeprefix("article").strip() for i, e in enumerate(elements)}
    strict = [0, *accumulate(covered(n, [(e.start, e.end) for i, e in enumerate(elements) if said[i] in ("marked", "comment")]))]
    clear = lambda e: strict[e.end] - strict[e.start] < e.end - e.start
    # the articles: those that nothing marks; else the one with the most words, but no comment
    articles = [i for i in own if words(elements[i]) and not said[i] and clear(elements[i])]
    if not articles:
        rest = [i for i in own if words(elements[i]) and said[i] != "comment"]
        articles = [max(rest, key=lambda i: words(elements[i]))] if rest else []

    def live(articles: list[int]) -> dict[int, str]:
        """Marked elements that wrap neither an article nor most of the page."""
        out, chosen = {}, set(articles)
        for i, e in enumerate(elements):
            at = bisect_right(articles, i)
            wraps = at < len(articles) and articles[at] <= e.last
            most = (not articles or said[i] == "form") and said[i] not in ("comment", "") and 2 * words(e) > upto[n]
            if said[i] and not wraps and not most and i not in chosen:
                out[i] = said[i]
        return out

    marked = live(articles)
    is_marked = covered(n, [(elements[i].start, elements[i].end) for i, s in marked.items() if s != "hint"])
    inside = covered(n, [(elements[i].start, elements[i].end) for i in articles])
    prose = [b.words if b.words >= PROSE and b.links < 0.33 and not b.hard and not m else 0 for b, m in zip(found, is_marked)]
    outside = sum(p for p, i in zip(prose, inside) if not i)
    teasers: list[int] = []
    if articles and outside > 3 * sum(b.words for b, i, m in zip(found, inside, is_marked) if i and not m and not b.hard):
        teasers, articles = articles, []  # the article elements are not the page's text
        marked = live(articles)
        is_marked = covered(n, [(elements[i].start, elements[i].end) for i, s in marked.items() if s != "hint"])
        inside = [False] * n
    hinted = covered(n, [(elements[i].start, elements[i].end) for i in [*teasers, *(i for i, s in marked.items() if s == "hint")]])
    has_article = float(any(inside))
    none = Block("", 0, 0.0, False, False)
    rows = []
    for k, (before, b, after) in enumerate(zip([none, *found], found, [*found[1:], none])):
        near = (b.words, b.links, before.words, before.links, after.words, after.links)
        rows.append((*near, float(is_marked[k]), float(hinted[k]), float(inside[k]), has_article, float(b.heading)))
    return found, rows


def main_text(page: str, tree: Node) -> str:
    found, rows = features(page)
    kept = [b.text for b, x in zip(found, rows) if not b.hard and decide(tree, x)]
    if not kept:  # a page of a few words: what is neither marked nor a link
        at = COLUMNS.index("marked")
        kept = [b.text for b, x in zip(found, rows) if not b.hard and not any(x[at : at + 2]) and b.links < 0.5]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    tree = grow(labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, tree) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
