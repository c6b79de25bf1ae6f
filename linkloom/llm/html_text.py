"""HTML extraction: the maximum-scoring run of words and tags.

A word scores what a word is worth, plus a weight for each thing that surrounds it: the kinds of its blocks (paragraph, list
item, link and the like), the names of its containers (tags such as ``nav``, words of class, id and role). Tags
score zero or less. A linear scan finds the best contiguous run. All weights are log odds of standing
inside or outside the article of pages that mark it with ``<article>`` or ``<main>`` (the labelled pages, a
bounded sample); names that usually hold no content start with ``PRIOR`` words seen outside, which labelled
pages can outweigh. On a page with a marked element, its tags and its containers of negative names cost nothing, and words
outside it pay a fixed cost per stretch. Inside the run, text whose containers' names sum to less than zero is left out where content goes on behind it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import map_arrow, table

SAMPLE_PAGES = 500
#: Score of a tag that no labelled page has, and of a word without labelled pages.
UNSEEN_TAG, PLAIN_WORD = -0.25, 1.0
#: Cost, in words, of a stretch of words outside the marked element of a page that has one.
BORDER = 20
#: Words outside the article that a listed name is taken to have been seen with.
PRIOR = 20
#: Bounds of the weights of kinds of blocks, of names, and of tags: kinds are shared by content and menus.
KIND, NAME, TAG = 0.6, 4.0, 3.0
#: Tags whose text is never read.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Tags, and last words of names, that usually hold no content.
OUTSIDE = frozenset("nav header footer aside form button menu dialog noscript template svg select".split())
MARK = re.compile(
    r"ads?|advert\w*|banner|sponsor(?:ed|s)?|promos?|promotions?|nav|navbar|navigation|menu|breadcrumbs?|header|footer|sidebar|widget|"
    r"cookies?|consent|notice|popup|modal|comments?|replies|reply|disqus|share|sharing|social|related|recommend(?:ed|ations?)|newsletter|subscribe|"
    r"login|search|copyright|toolbar|pagination|pager|contentinfo|complementary",
)
#: Words behind such a word that tell of the layout.
LAYOUT = frozenset("bar list links link box boxes wrap wrapper container inner outer left right top bottom slot unit area block section item items buttons button icons form body main".split())
#: First words of a name that tells of the page's layout, not of the element.
FLAGS = frozenset("has no not with without is js".split())
#: Tags that stay within a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags of blocks that articles and menus share.
SHARED = frozenset(
    "div section p ul ol li dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption center "
    "details summary address hgroup fieldset legend head a".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_BODY = frozenset(("article", "main"))
#: Tags whose end tag may be left out before the next of their kind, and links.
SIBLINGS = frozenset("p li a td th tr dt dd".split())
_PAGE = frozenset(("html", "body"))


@cache
def listed(key: str) -> bool:
    """Whether a name is one that usually holds no content: a tag, or a name by its last word but for words of layout."""
    if key[0] == "@":
        return key[1:] in OUTSIDE
    words = [w for w in re.split(r"[-_]+", key[1:]) if w]
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return key[0] == "." and bool(words) and words[0] not in FLAGS and MARK.fullmatch(words[-1]) is not None


def element_keys(name: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the words in it: its kind or tag, and the words of class, id and role without digits."""
    if name in _PAGE:
        return ()
    keys = [] if name in _BODY else [("~" if name in SHARED else "@") + name]
    for attribute, value in _ATTR.findall(attributes):
        if attribute.lower() in ("class", "id", "role"):
            keys += ["." + w for token in value.strip("\"'").lower().split() if (w := re.sub(r"\d+", "", token).strip("-_"))]
    return tuple(keys)


def tokens(page: str):
    """(kind, name or text, keys, body): kinds are text, open and close, in page order; keys are those of all open elements.

    An end tag closes all elements opened since its start tag; a paragraph, item, cell or link closes the one before. A listed container
    whose name has fewer end tags than start tags on the page ends where an article begins as well. ``body`` is true within
    ``<article>``, or ``<main>`` on a page without one, that is in no listed container; None on a page without either.
    """
    found = list(_TOKEN.finditer(page))
    starts, ends = Counter(), Counter()
    for m in found:
        if m[3]:
            (ends if m[2] else starts)[m[3].lower()] += 1
    own = "article" if starts["article"] else "main"
    marks = bool(starts[own])
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = []  # open elements: name, keys so far, in a listed one, in the body
    opened: Counter = Counter()  # names in the stack
    at = 0

    def body() -> bool | None:
        return (bool(stack) and stack[-1][3]) if marks else None

    def keys() -> tuple[str, ...]:
        return stack[-1][1] if stack else ()

    def close(i: int) -> None:
        opened.subtract(s[0] for s in stack[i:])
        del stack[i:]

    for m in found:
        if m.start() > at:
            yield "text", page[at : m.start()], keys(), body()
        at = m.end()
        if m[1] or not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            yield "close", name, keys(), body()
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _BODY:
            i = next((i for i, s in enumerate(stack) if s[2] and ends[s[0]] < starts[s[0]]), None)
            if i is not None:
                close(i)
        if name in SIBLINGS and opened[name] > 0:
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or (stack[i][0] not in INLINE and stack[i][0] != "p"))
            if stack[i][0] == name:
                close(i)
        if name not in VOID and (name == "a" or name not in INLINE):
            more = element_keys(name, m[4])
            aside = (bool(stack) and stack[-1][2]) or any(map(listed, more))
            stack.append((name, tuple(dict.fromkeys((*keys(), *more))), aside, (bool(stack) and stack[-1][3]) or (name == own and not aside)))
            opened[name] += 1
        yield "open", name, keys(), body()
    if at < len(page):
        yield "text", page[at:], keys(), body()


def count_page(page: str) -> Counter:
    """Words, keys of words and tags inside and outside the article of one page; empty if it marks none.

    Text of listed containers within the article counts for neither side.
    """
    out: Counter = Counter()
    for kind, text, keys, body in tokens(page):
        if body is None:
            return Counter()
        if body and any(map(listed, keys)):
            continue
        if kind != "text":
            out[f"<{text}", body] += text not in _BODY and text not in _PAGE
            out["#tags", body] += 1
        elif n := len(text.split()):
            out["#words", body] += n
            for key in keys:
                out[key, body] += n
    return out


def learn_weights(pages: DataFrame, max_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights of words, kinds, names and tags, from at most about ``max_pages`` labelled pages, chosen by a hash of the html.

    A word is worth 0.2 to 1: the log odds of a token being a word inside and outside the article. Tags are never above 0.
    Without labelled pages there are no weights: a word is worth 1, and only listed names weigh.
    """
    labelled = pages.where(F.lower("html").rlike("<(article|main)\\b")).select("html")
    n = labelled.count()
    if n > max_pages:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(17), "html"), F.lit(1 << 20)) < int(max_pages / n * (1 << 20)))

    def count(batch: pa.RecordBatch) -> dict:
        total: Counter = Counter()
        for page in batch.column(0).to_pylist():
            total += count_page(page)
        return {"token": [k for k, _ in total], "inside": [i for _, i in total], "n": list(total.values())}

    got = map_arrow(labelled, count, "token string, inside boolean, n long").groupBy("token", "inside").agg(F.sum("n").alias("n"))
    seen: dict[str, list[int]] = {}
    for r in got.collect():  # names of the sample
        seen.setdefault(r["token"], [0, 0])[r["inside"]] = r["n"]
    return weights_of(seen) if seen else {}


def weights_of(seen: dict[str, list[int]]) -> dict[str, float]:
    """Weights from counts (outside, inside) of tokens."""
    words, tags = seen.get("#words", [0, 0]), seen.get("#tags", [0, 0])

    def odds(n: list[int], total: list[int], prior: int = 0) -> float:
        return math.log((n[1] + 0.5) / (total[1] + 1)) - math.log((n[0] + prior + 0.5) / (total[0] + prior + 1))

    every = [words[i] + tags[i] for i in (0, 1)]
    out = {"#word": min(1.0, max(0.2, odds(words, every)))}
    for key, n in seen.items():
        if key[0] == "<":
            out[key] = max(-TAG, min(0.0, odds(n, tags)))
        elif key[0] != "#":
            bound = KIND if key[0] == "~" else NAME
            out[key] = max(-bound, min(bound if key[0] == "~" else bound / 4, odds(n, words, PRIOR * listed(key))))
    return out


def _weight(key: str, weights: dict[str, float]) -> float:
    return weights.get(key, -NAME if listed(key) else 0.0)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; the first and shortest of equals."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page: blocks joined by a line break."""
    seen = list(tokens(page or ""))
    word = weights.get("#word", PLAIN_WORD)
    worth: dict[tuple[str, ...], tuple[float, float]] = {}  # of the keys around a word: its score, and the sum of the names
    scores, names, beyond = [], [], False  # beyond: words outside the marked element since the last ones in it
    for kind, text, keys, body in seen:
        if keys not in worth:
            each = [(key[0] != "~", _weight(key, weights)) for key in keys]
            worth[keys] = word + sum(w for _, w in each), sum(w for name, w in each if name)
        score, name = worth[keys]
        n = len(text.split()) if kind == "text" else 0
        names.append(name if n else 0.0)
        if body and (name < 0 or kind != "text"):
            scores.append(0.0)  # passed over: the marked element goes on behind it
        elif kind != "text":
            scores.append(weights.get(f"<{text}", UNSEEN_TAG) if text not in _BODY else 0.0)
        else:
            scores.append(score * n - (BORDER * word if n and body is False and not beyond and score > 0 else 0.0))
            beyond = body is False if n and score > 0 else beyond
    a, b = best_run(scores)
    content = [i for i in range(a, b) if seen[i][0] == "text" and names[i] >= 0 and seen[i][1].strip()]
    blocks, now = [], []
    for i in range(a, b):
        kind, text, _, _ = seen[i]
        if kind == "text":
            if names[i] >= 0 or not content or not content[0] < i < content[-1]:
                now.append(text)
        elif text not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (" ".join(entities.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in clean if x)


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url and text of every row.

    A null or empty page, or one without words, has an empty text. Unclosed tags, cut pages and
    broken references are read as far as they go; pages of any length are read whole. Of runs with equal
    scores the first and shortest counts. Repeated rows give repeated results, an empty table none; other
    columns are ignored, those named like a result too.
    """

    def run(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column(0), "url": batch.column(1), "text": [extract(p, weights) for p in batch.column(2).to_pylist()]}

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn_weights(pages)).withColumn("n_chars", F.length("text").cast("long"))
