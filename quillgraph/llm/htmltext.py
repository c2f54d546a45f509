"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block element. A line's weight is the length of its text without white space and
without link text. Weights are summed over a sliding window of lines; the text surges where a window's sum rises over a threshold and
dives where it falls again, and what lies between is the main text. Markup never decides by itself which lines are text; it takes whole containers out and changes weights:

* a line in a container that cannot be main text (navigation, footers, asides, forms, page headers, and elements whose class, id or role names
  an advert, notice, menu, sidebar or reader comments) has no weight and no place. Inside an article fewer names count, as parts of a class, so that
  text is not lost to common words: ``STRONG`` ones, whole names in ``NARROW``, and whole ids in ``IDS`` (other ids are made from titles);
* a line in an article or main element counts with all its text, links included, and with a ``LIFT`` part of the threshold more. One such line is below the threshold
  unless it is long; three short ones in a row are above it. So short paragraphs stand as long as a window of them is text, and a stray one is not;
* where such lines have at least half of the page's text (a marked page), all others keep a ``FAINT`` part of their weight, and the text dives as soon as no
  window that covers a line is over the threshold: beside an article only a block that is long for itself is text. On other pages it dives where a window is empty.

Between surge and dive a line without weight is left out if others like it stand beside it (a list of links); one alone between lines of text stays.

Each page is one row's work: a task's memory is bounded by its longest page.

Defined results: null or empty html gives an empty text; a page without any text likewise; text inside unclosed
or wrongly nested markup belongs to the block that is open; markup that is cut off at the page's end is dropped; repeated rows
give repeated results; an empty table gives an empty table; columns besides those named are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

WINDOW = 3
SURGE = 86
#: What is left of the weight of lines beside an article, and what a line inside has more, as a part of the threshold.
FAINT, LIFT = 0.05, 0.4

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset(["br", "td", "th", "wbr"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text, whatever it looks like.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Of these, what ends with the line's block if it is never closed; an unclosed script or style reaches to the page's end.
SHORT = frozenset("textarea title iframe noembed noframes xmp".split())
#: Containers that hold no main text.
ASIDE = frozenset("nav footer aside form menu dialog button select noscript template svg math object audio video canvas datalist search".split())
MAIN = frozenset(["article", "main"])
#: Names in class, id or role that mark what is not main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip "
    "header masthead topbar footer bottom copyright contentinfo colophon "
    "sidebar aside rail widget widgets related recommended recommendations share sharing social complementary "
    "comment comments commentlist respond reply replies disqus discussion responses "
    "form login search searchform".split()
)

#: Whole classes or roles that mark a container inside an article as something else.
NARROW = frozenset(
    "ad ads advert advertisement adsbygoogle ad-slot ad-container ad-box ad-unit ad-wrapper ad-block sponsored promo promoted cookie-notice cookie-banner cookie-consent newsletter-signup "
    "share-buttons social-share sharing-buttons related-posts related-articles recommended-articles breadcrumb breadcrumbs pagination "
    "comments comment-list comments-area comment-form disqus_thread navigation complementary".split()
)
#: What marks such a container as the first or last part of a class or role.
STRONG = frozenset("comments comment replies cookie cookies consent gdpr sidebar banner advert adverts advertisement advertising sponsored newsletter".split())
#: Whole ids that mark one; other ids come from titles.
IDS = frozenset("comments comment-list disqus_thread respond sidebar newsletter cookie-banner cookie-notice cookie-bar related-posts".split())
#: Where the narrow names are looked for inside an article.
CONTAINERS = frozenset("div section aside ul ol dl table".split())
#: Never containers: outside of an article the narrow names alone mark them.
TEXTS = frozenset("p span b i em strong code q cite small mark time blockquote pre".split())
#: Made from titles, their ids say nothing about what they are.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?]|/[^a-zA-Z]))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_MARKS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Parts of the names of wrappers, which tell what else is on the page.
_SPARED = frozenset(["has", "with", "without", "no", "layout"])

#: A header named after one of these is the text's own.
_CONTENT = frozenset("content article entry post story".split())


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    main: bool


#: Of these, what marks even an article or main element as something else.
NOT_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies response responses related recommended teaser".split())


def _is_marked(attributes: str, names: frozenset[str] = NAMES, ids: bool = True) -> bool:
    """Whether a name is one of the classes, ids or roles, or such a one's first or last part."""
    for kind, *found in _MARKS.findall(attributes):
        if kind.lower() == "id" and not ids:
            continue
        for word in _CAMEL.sub("-", "".join(found)).lower().split():
            parts = _NAME.findall(word)
            if parts and parts[-1] == "header" and not _CONTENT.isdisjoint(parts):
                continue
            if parts and _SPARED.isdisjoint(parts) and not names.isdisjoint([parts[0], parts[-1], "".join(parts)]):
                return True
    return False


def _is_narrow(attributes: str) -> bool:
    return any(word in NARROW for kind, *found in _MARKS.findall(attributes) if kind.lower() != "id" for word in "".join(found).lower().split())


def _has_id(attributes: str) -> bool:
    return any(kind.lower() == "id" and "".join(found).strip().lower() in IDS for kind, *found in _MARKS.findall(attributes))


def _left_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element that may hold main text by its name is marked as something else."""
    if name in HEADINGS or name in ("html", "body"):
        return False
    if inside:
        return name in CONTAINERS and (_is_narrow(attributes) or _is_marked(attributes, STRONG, ids=False) or _has_id(attributes))
    if name in TEXTS:
        return _is_narrow(attributes)
    return _is_marked(attributes, ids=name != "section")  # a section's id is made from its title


def lines(page: str) -> list[Line]:
    """The page's non-empty lines of text, without containers that hold no main text."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    in_link = in_main = 0
    seen_main = False
    skipping, skipped = "", 0  # the element that is being left out, and how many of its name are open

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, linked, in_main > 0))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not skipping:
            parts.append(text)
            if in_link:
                linked += len("".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            take(page[at:])
            break
        take(page[at : tag.start()])
        if tag[3]:
            stop = page.find("-->", tag.end())
            at = end if stop < 0 else stop + 3
            continue
        rest = _REST.match(page, tag.end())
        stop = rest.end() if rest else page.find(">", tag.end()) + 1
        if not stop:
            break  # cut off inside a tag
        at = stop
        if tag[4]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        attributes = page[tag.end() : stop - 1]
        if name in RAW and not closing:
            close = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
            if close is None and name not in SHORT:
                break
            if close is not None:
                at = page.find(">", close.end()) + 1 or end
            continue
        if skipping:
            if name in MAIN and not closing and not seen_main or name == "body" and closing:
                skipping = ""  # what was left open before the article does not swallow it
            elif name == skipping and (closing or name in ("p", "li")):
                skipped -= 1
                if skipped <= 0:
                    skipping = ""
                if closing:
                    continue
            elif name == skipping:
                skipped += not attributes.endswith("/")
                continue
            else:
                continue
        if name in BLOCKS:
            end_line()
        elif name in SPACES and parts:
            parts.append(" ")
        if name in MAIN and not closing and _is_marked(attributes, NOT_ARTICLE, ids=False):
            skipping, skipped = name, 1
        elif name in MAIN:
            in_main = max(0, in_main - 1) if closing else in_main + 1
            seen_main = True
        elif name == "a":
            in_link = int(not closing)
        elif not closing and name not in VOID and (name in ASIDE or name == "header" and not in_main or _left_out(name, attributes, in_main > 0)):
            if not attributes.endswith("/") or name not in ("svg", "math"):
                skipping, skipped = name, 1
    end_line()
    return out


def weighed(found: list[Line], surge: float = SURGE) -> tuple[list[float], bool]:
    """The lines' weights, and whether the page's text lies in marked elements."""
    full = [len("".join(x.text.split())) for x in found]
    own = [max(0, n - x.linked) for x, n in zip(found, full, strict=True)]
    inside = sum(w for x, w in zip(found, own, strict=True) if x.main)
    marked = any(x.main for x in found) and 2 * inside >= sum(own)
    return [LIFT * surge + n if x.main else w * (FAINT if marked else 1) for x, n, w in zip(found, full, own, strict=True)], marked


def spans(weights: list[float], window: int = WINDOW, surge: float = SURGE, marked: bool = False) -> list[tuple[int, int]]:
    """Half-open spans of lines between surge and dive points of the windowed sums."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    threshold = min(surge, max(sums, default=0) / 2)
    found, at = [], 0
    while at < len(sums):
        if (marked or weights[at] > 0) and sums[at] > threshold:
            start = at
            while at < len(sums) and sums[at] > (threshold if marked else 0):
                at += 1
            # the last window that is over the threshold is text to its end
            found.append((start, min(len(sums), at + window - 1) if marked else at))
        else:
            at += 1
    return found


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    found = lines(page or "")
    weights, marked = weighed(found, surge)
    kept: dict[int, str] = {}
    for first, stop in spans(weights, window, surge, marked):
        for i in range(first, stop):
            around = [weights[j] > 0 for j in (i - 1, i + 1) if first <= j < stop]
            if found[i].main or weights[i] > (surge if marked else 0) or not marked and not weights[i] and around == [True, True]:
                kept[i] = found[i].text
    return "\n\n".join(kept.values())


def extract(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` of the page in column ``html``."""
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    schema = df.select(*columns).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = df.select(*columns, F.col(html)).mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
