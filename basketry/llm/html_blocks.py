"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; those that markup sets apart (menus,
footers, forms, adverts, comments) are never part of the text.  The first pass judges
each other block alone, by length, link density and the share of stop words: full of
links is bad, long with many stop words is good.  Short blocks and long ones of middling
density stay undecided.  The second pass gives them the labels of the nearest decided
neighbours, the long ones first.  Where none of the listed languages fits the page as a
whole, length and links decide without stop words.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import utf8

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_kept int"

# HTML's elements by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol"
    " option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER_TAGS = frozenset(
    "article aside blockquote button center details dialog div dl fieldset figure footer form header"
    " main menu nav ol search section select table ul".split()
)
MAIN_TAGS = frozenset(["article", "main"])
ASIDE_TAGS = frozenset("aside button dialog footer form menu nav search select".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Parts of class, id and role names that mark what is not the article.
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising alert banner breadcrumb breadcrumbs"
    " complementary contentinfo cookie cookies footer form gdpr login masthead menu modal"
    " nav navbar navigation newsletter notice notices popup promo promotion related"
    " search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
# Frequent function words of the languages that stop-word density knows.
STOP_WORDS = {
    "en": frozenset(
        "a an and are as at be been but by for from had has have he her his i in is it its not of on or"
        " she that the their they this to was we were which will with you".split()
    ),
    "fr": frozenset(
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou"
        " par pas pour qu que qui sa se ses son sont sur un une vous".split()
    ),
    "de": frozenset(
        "als am an auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in"
        " ist mit nach nicht sich sie sind so um und von war wie wir zu zum zur".split()
    ),
    "es": frozenset(
        "a al como con de del el ella en es está este ha la las lo los más no o para pero por que se ser"
        " si sin su sus un una y ya yo".split()
    ),
}

# A comment, an element whose content is not text, or a tag; quoted values may hold ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.IGNORECASE)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds: lengths in characters, densities as shares."""

    max_link_density: float = 0.4
    short: int = 70
    long: int = 120
    low_density: float = 0.15
    high_density: float = 0.25


@dataclass
class Block:
    text: str
    link_chars: int
    place: str  # "main", "aside" or "" where the markup says nothing
    heading: bool


def place_of(tag: str, rest: str) -> str:
    """What an element's own tag and names say about its content: "main", "aside", "named" (aside by a name), "header"."""
    if tag in ("html", "body"):
        return ""
    names = {part for value in NAMES.findall(rest) for part in NAME_PARTS.findall("".join(value).lower())} if rest else ()
    if tag in ASIDE_TAGS or not COMMENT_NAMES.isdisjoint(names) or (rest and HIDDEN.search(rest)):
        return "aside"
    if tag in MAIN_TAGS:
        return "main"
    if not ASIDE_NAMES.isdisjoint(names):
        return "named"
    return "header" if tag == "header" or "header" in names else ""


def blocks(page: str) -> Iterator[Block]:
    """The non-empty blocks in page order."""
    open_tags: list[tuple[str, str]] = []
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = heading = False
    place = ""

    def flush() -> Iterator[Block]:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(html.unescape("".join(link_parts)).split()))
            yield Block(text, links, place, heading)
        parts.clear()
        link_parts.clear()

    def now() -> str:
        places = [p for _, p in open_tags]
        if "aside" in places:
            return "aside"
        if "main" in places:
            # A header inside the article is part of it; a page may be wrapped in "with-sidebar".
            return "aside" if "named" in places[places.index("main") :] else "main"
        return "aside" if "named" in places or "header" in places else ""

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                link_parts.append(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag, closing = m["tag"].lower(), bool(m["end"])
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not closing
        if tag in BLOCK_TAGS:
            yield from flush()
            heading = tag in HEADINGS and not closing
            in_link = in_link and tag in ("li", "p", "div")
        if tag in VOID_TAGS:
            continue
        if closing:
            depth = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag), None)
            if depth is not None:
                if place and any(p for _, p in open_tags[depth:]):
                    yield from flush()
                del open_tags[depth:]
                place = now()
        elif said := place_of(tag, m["rest"]):
            if said != "main":
                yield from flush()  # an inline advert is a block of its own
            open_tags.append((tag, said))
            place = now()
        elif tag in CONTAINER_TAGS:
            open_tags.append((tag, ""))
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            link_parts.append(page[at:])
    yield from flush()


def stop_word_density(text: str) -> float:
    """Share of stop words, for the language that fits best."""
    words = LETTERS.findall(text.lower())
    if not words:
        return 0.0
    return max(sum(w in listed for w in words) for listed in STOP_WORDS.values()) / len(words)


def first_pass(block: Block, rules: Rules, known_language: bool = True) -> str:
    """"good", "bad", or undecided: "near" (long) or "short"."""
    links = block.link_chars / len(block.text)
    if block.place == "aside" or links > rules.max_link_density:
        return "bad"
    if len(block.text) < rules.short:
        return "bad" if links or "©" in block.text else "short"
    prose = not known_language or stop_word_density(block.text) >= rules.high_density
    return "good" if prose and len(block.text) > rules.long else "near"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones before and after them.

    Blocks that markup sets apart are nobody's neighbours.  Where both neighbours agree, or there is one, it decides;
    without any, what is there is the text.  Else long blocks are good, headings go with what follows, and other short
    blocks with the nearer neighbour, the good one if both are as near.
    """
    labels = list(labels)
    open_ = [i for i, block in enumerate(found) if block.place != "aside"]
    for kind in ("near", "short"):
        decided = [k for k, i in enumerate(open_) if labels[i] in ("good", "bad")]
        inherited, after = {}, 0
        for k, i in enumerate(open_):
            while after < len(decided) and decided[after] < k:
                after += 1
            if labels[i] != kind:
                continue
            left = labels[open_[decided[after - 1]]] if after else None
            right = labels[open_[decided[after]]] if after < len(decided) else None
            if left is None or right is None or left == right:
                inherited[i] = left or right or "good"
            elif kind == "near":
                inherited[i] = "good"
            elif found[i].heading:
                inherited[i] = right
            else:
                steps = k - decided[after - 1], decided[after] - k
                inherited[i] = left if steps[0] < steps[1] else right if steps[1] < steps[0] else "good"
        for i, label in inherited.items():
            labels[i] = label
    return [block.place != "aside" and label == "good" for block, label in zip(found, labels, strict=True)]


def main_text(page: str, rules: Rules = Rules()) -> tuple[str, int, int]:
    """(text, number of blocks, number kept)."""
    found = list(blocks(page))
    whole = " ".join(b.text for b in found if b.place != "aside")
    known_language = stop_word_density(whole) >= rules.low_density
    kept = second_pass(found, [first_pass(b, rules, known_language) for b in found])
    text = "\n".join(b.text for b, good in zip(found, kept, strict=True) if good)
    return text, len(found), sum(kept)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per page with its main text; needs ``page_id``, ``url`` and ``html``.

    Null or empty html, and pages without any good block, give an empty text.
    Markup cut off in the middle is read as far as it goes.  Repeated rows give
    repeated results, an empty table none; other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(page.decode("utf-8", "replace"), rules) for page in utf8(batch, "html")]
            texts = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([x[1] for x in out], pa.int32()),
                    pa.array([x[2] for x in out], pa.int32()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(read, EXTRACTED)
