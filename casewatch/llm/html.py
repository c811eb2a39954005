"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element. Lines inside menus, footers,
forms, adverts and the like keep their place but no text, so they are the valleys of
the distribution. The lengths of ``span`` successive lines are summed. Text surges
where a sum rises above the threshold and dives where the sums fall to zero; what
lies between is kept, in page order. A line inside an article element weighs as much
as a surge at least. What surges outside is dropped only where all of it is no more
than what the article elements weigh together.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import common

SPAN, SURGE = 3, 90

# Elements by what becomes of them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("nav footer aside form menu dialog select button".split())
TRUSTED = set("article main".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be left out: the opening tags that end them, and the elements inside which such a tag ends nothing outside.
CELLS, GROUPS = {"td", "th"}, {"tbody", "tfoot", "thead"}
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    **dict.fromkeys(CELLS, CELLS | {"tr"} | GROUPS), "tr": {"tr"} | GROUPS, **dict.fromkeys(GROUPS, GROUPS),
}
SCOPES = dict.fromkeys(ENDED_BY, {"table"}) | {"p": set()} | dict.fromkeys(("li", "dt", "dd"), BLOCKS - VOID - {"address", "div", "p"})
#: Class and identifier names of noise; a compound name is noise if each of its parts is here or among the places.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget widgets".split())
PLACES = set(
    "area article bar block body bottom box button buttons center column container entry fixed global group header icons inner item items left "
    "level list main mobile outer page pane panel post primary reader right row secondary section site sticky thread top user wrap wrapper".split())
#: Names that make noise of an article element too.
REPLIES = set("ad ads advert adverts advertisement advertising comment comments disqus promo promoted related respond sponsored".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu".split())
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|head|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
# A quoted value may hold angle brackets; one with brackets is looked for in the next 4000 characters, so a lost quote costs no more.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"<>]*+"|'[^'<>]*+'|"[^"]{0,4000}+"(?=[\s/>])|'[^']{0,4000}+'(?=[\s/>]))*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")


def is_noise(name: str, attributes: str) -> bool:
    """Whether an element is a part of the page that is no article text."""
    if name in DROPPED:
        return True
    if not attributes or name in ("body", "html"):
        return False
    names = REPLIES if name in TRUSTED else NAMES
    for key, *quoted in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(quoted).lower()
        if key in ("class", "id"):
            found = any(is_named(x, names) for x in value.split())
        elif name in TRUSTED:
            found = False
        elif key == "role":
            found = not ROLES.isdisjoint(value.split()[:1])
        else:
            found = key == "hidden" and value != "until-found" or key == "aria-hidden" and value.strip() == "true"
        if found:
            return True
    return False


def is_named(word: str, names: set[str]) -> bool:
    """A whole name, or one made of such names and of places: ``site-nav``, but not ``with-nav``."""
    parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
    return not names.isdisjoint(parts) and all(x in names or x in PLACES for x in parts)


def closed_tags(tags: list[re.Match]) -> set[int]:
    """Numbers of the opening tags that have an end tag of their own."""
    waiting: dict[str, list[int]] = {}
    closed = set()
    for i, tag in enumerate(tags):
        name = (tag[2] or tag[5] or "").lower()
        if not name or name in VOID:
            continue
        if not (tag[1] or tag[4]):
            waiting.setdefault(name, []).append(i)
        elif waiting.get(name):
            closed.add(waiting[name].pop())
    return closed


def lines_of(page: str) -> tuple[list[str], list[bool]]:
    """Text of every line, and whether it stands inside an article element.

    A dropped element ends where as many of its name were closed as opened, whatever
    stands in it; one that is never closed ends at the next article element. One whose
    end tag may be left out ends at its next sibling or with its parent too.
    """
    lines, trusted, held = [], [], []
    inside, noise, depth, at = 0, "", 0, 0
    opened, inner, within = Counter(), [], Counter()  # block elements that are open: outside noise, in it in order, and in it by name

    def end_line() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        lines.append(text)
        trusted.append(inside > 0)

    page = RAW.sub(" ", page)
    tags = list(TAG.finditer(page))
    closed = closed_tags(tags)
    ends = False  # whether the noise has an end tag
    for i, tag in enumerate(tags):
        if not noise:
            held.append(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        closing = bool(tag[1] or tag[4])
        if noise:
            if name in TRUSTED and not closing and not ends:
                noise = ""
            elif noise in ENDED_BY:
                if closing and within[name]:
                    while (gone := inner.pop()) != name:
                        within[gone] -= 1
                    within[name] -= 1
                elif closing and name == noise:
                    noise = ""
                    end_line()
                    continue
                elif closing and name != "p" and opened[name] or not closing and name in ENDED_BY[noise] and not any(within[x] for x in SCOPES[noise]):
                    noise = ""
                elif not closing and name in BLOCKS and name not in VOID:
                    inner.append(name)
                    within[name] += 1
                if noise:
                    if name in BLOCKS:
                        end_line()
                    continue
            elif name == noise:
                depth += -1 if closing else 1
                if depth == 0:
                    noise = ""
                    end_line()
                continue
            else:
                if name in BLOCKS:
                    end_line()
                continue
        attributes = tag[3] or tag[6] or ""
        if not closing and name not in VOID and not attributes.endswith("/") and (is_noise(name, attributes) or name == "header" and not inside):
            end_line()
            noise, depth, ends = name, 1, i in closed
            inner.clear()
            within.clear()
        elif name in BLOCKS:
            end_line()
            if name not in VOID:
                opened[name] = max(0, opened[name] + (-1 if closing else 1))
            if name in TRUSTED:
                inside = max(0, inside + (-1 if closing else 1))
        elif name in ("br", "img", "input"):
            held.append(" ")
    if not noise:
        held.append(page[at:])
    end_line()
    return lines, trusted


def extract(page: str, span: int = SPAN, surge: int = SURGE) -> tuple[str, int, int]:
    """Main text, and the first and last line of it (-1 without any)."""
    lines, trusted = lines_of(page)
    inside = np.array(trusted)
    sizes = np.array([len(x) for x in lines])
    weights = np.where(inside & (sizes > 0), np.maximum(sizes, surge), sizes)
    ahead = np.convolve(weights, np.ones(span, np.int64))[span - 1:]  # each line and the next ones
    # A run of lines between two valleys: no text in the line and in those after it.
    live = (ahead > 0) & ~((sizes == 0) & (np.r_[0, sizes[:-1]] == 0))
    edges = np.flatnonzero(np.diff(np.r_[0, live.astype(np.int8), 0]))
    kept = np.zeros(len(lines), bool)
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        if ahead[start:end].max() >= surge:
            kept[start:end] = True
    kept &= sizes > 0
    if sizes[kept & ~inside].sum() <= weights[inside].sum():
        kept &= inside
    places = np.flatnonzero(kept)
    if not len(places):
        return "", -1, -1
    return "\n\n".join(lines[i] for i in places), int(places[0]), int(places[-1])


def main_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html", span: int = SPAN, surge: int = SURGE) -> DataFrame:
    """One row per page: its keys, text, number of code points, surge and dive line.

    A null or empty page has an empty text; so has one without article text. Rows that
    repeat a page are extracted each; an empty table gives no rows; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x, span, surge) for x in batch[batch.num_columns - 1].to_pylist()]
            texts, first, last = zip(*found, strict=True) if found else ((), (), ())
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keys, "text", "n_chars", "surge_line", "dive_line"])

    narrow = pages.select(*keys, F.coalesce(F.col(page), F.lit("")).alias("__page"))
    fields = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(run, f"{fields}, text string, n_chars long, surge_line long, dive_line long")


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(common.read(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_main_text": op5_main_text}
