"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass classifies a
block by its place (menus, footers, forms and the like are never text), its
link density, its length and its share of stop words.  The second pass gives
each ambiguous block the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Tags whose content is never text; tags of page furniture; tags that end a block.
SILENT = "script style noscript template iframe object svg canvas math title select textarea button audio video".split()
FURNITURE = "nav footer aside form menu dialog".split()
BLOCKS = "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta source track wbr p li dt dd option tr td th".split()
# Words of class and id that mark page furniture.
MARKS = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related respond sharing share sidebar signup skip social sponsor sponsored subscribe subscription topbar widget widgets".split()
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you we will would can all there been if more when who "
    "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous plus sont "
    "aber als am an auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von war wie wir zu zum zur "
    "al como con del desde donde el ella ellos en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también te un una y ya"
).split()

# Marks that within an article are its own, such as the header of an entry.
OWN_MARKS = "header masthead banner".split()

#: Blocks with at least this share of their letters in links are furniture.
LINK_DENSITY = 0.33
#: Blocks of fewer characters are ambiguous.
SHORT = 70
#: From this share of stop words on, a block that is not short is text.
STOP_DENSITY = 0.08

_SILENT, _FURNITURE, _BLOCKS, _VOID, _MARKS, _OWN, _STOP = map(frozenset, (SILENT, FURNITURE, BLOCKS, VOID, MARKS, OWN_MARKS, STOP_WORDS))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(SILENT) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
#: For the rest of a page after a tag that never closes its quotes: tags end at the first ">", so each is looked at once.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>" + "|".join(SILENT) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>[^>]*)>|(?P<text>[^<]+|<)", re.I | re.S)
_TAG = re.compile(r"/?[a-zA-Z]|[!?]")
_REST = re.compile(r"(?P<text>.+)|(?P<name>\Z)(?P<close>)(?P<rest>)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^a-z]+")
GOOD, BAD, OPEN = 1, -1, 0


def _marked(rest: str, inside: bool) -> bool:
    marks = _MARKS - _OWN if inside else _MARKS
    return any(part in marks for m in _NAMES.finditer(rest) for part in _PARTS.split((m[1] or m[2] or m[3] or "").lower()))


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags and texts of a page, in time proportional to its length."""
    last = page.rfind(">")
    for m in _TOKEN.finditer(page):
        if m["text"] == "<" and _TAG.match(page, m.end()):  # a tag without an end
            if m.end() < last:
                yield from _PLAIN.finditer(page[: last + 1], m.start())
            yield from _REST.finditer(page, max(last + 1, m.start()))
            return
        yield m


def _classify(text: str, linked: int, furniture: bool, inside: bool) -> int:
    if furniture or linked >= LINK_DENSITY * len(text):
        return BAD
    if len(text) < SHORT:
        return OPEN
    words = _WORD.findall(text.lower())
    if words and sum(w in _STOP for w in words) >= STOP_DENSITY * len(words):
        return GOOD
    return OPEN if inside else BAD


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, label of the first pass, container) of the blocks of a page; container 0 is outside articles."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    linked = links = articles = 0
    # open elements: name, whether furniture, container
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    still: Counter[str] = Counter()

    def end() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                _, furniture, container = stack[-1]
                out.append((text, _classify(text, linked, furniture, container > 0), container))
            held.clear()
        linked = 0

    for m in _tokens(page):
        if (text := m["text"]) is not None:
            held.append(text)
            if links:
                linked += len(text)
        elif (name := m["name"]) is not None:
            name = name.lower()
            if name == "a":
                links = 0 if m["close"] else 1
            if name not in _BLOCKS:
                continue
            if name == "br":
                held.append(" ")
                continue
            end()
            links = 0
            if name in _VOID:
                continue
            if not m["close"]:
                _, furniture, container = stack[-1]
                if name in ("article", "main") and not container:
                    articles += 1
                    container = articles
                page_header = name == "header" and not container
                stack.append((name, furniture or name in _FURNITURE or page_header or (name not in ("body", "html") and _marked(m["rest"], container > 0)), container))
                still[name] += 1
            elif still[name]:
                while (gone := stack.pop()[0]) != name:
                    still[gone] -= 1
                still[name] -= 1
    end()
    return out


def main_text(page: str | None) -> str:
    """The text of the blocks that are main text, joined by one space; empty if there are none."""
    found = blocks(page or "")
    labels = [x[1] for x in found]
    # nearest decided block of the same container on each side: (distance, label), by one sweep each way
    near: list[list[tuple[int, int]]] = [[] for _ in found]
    for places in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in places:
            _, label, container = found[i]
            if label != OPEN:
                last[container] = i
            elif container in last:
                near[i].append((abs(i - last[container]), -found[last[container]][1]))
    for i, (_, label, container) in enumerate(found):
        if label == OPEN:  # equally near: text wins
            labels[i] = -min(near[i])[1] if near[i] else (GOOD if container else BAD)
    return " ".join(x[0] for x, label in zip(found, labels, strict=True) if label == GOOD)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without main text, give empty text.  Null
    ids and repeated rows are kept; other columns are dropped.  One pass, no
    shuffle; a page is held in memory whole, with its blocks.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
