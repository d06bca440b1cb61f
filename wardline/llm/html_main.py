"""Main text of web pages by consensus host paths.

Every page is cut into blocks of text, each with the path of containers it stands in (tag and classes, numbers generalised).
A page votes for the article or main that holds its running text, else for the deepest container that holds all its long blocks
and headings; votes are counted per host and path in Spark. Each page is then extracted again: the blocks under its host's
winning path, or under its own best path where that contains the host's or the host's holds less than half of its running text. Menus, page
headers, footers, sidebars, notices, adverts, forms, comments and what is no text are left out wherever they stand, by tag or by
a whole class, id or role; a form or hinted container (other than menus, footers and comments) with most of the text is kept.

Votes are partial before the shuffle and one row per host is joined back (its size is known when joined, so the planner
broadcasts it only while small). A null page is empty and has no text; a null url is a host of its own. Unclosed and
stray tags are borne, in time that grows with the page; containers more than `DEPTH` deep count as part of the last one. Repeated pages vote and are extracted each for itself. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import stage

# Elements whose content is no text of the page.
SILENT = {
    t: re.compile(rf"</{t}\s*>", re.I)
    for t in "script style noscript template svg math title textarea select button iframe object canvas audio video".split()
}
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_END = re.compile(r"[\"'>]")
CONTAINERS = frozenset("html body main article section div nav header footer aside form fieldset ul ol dl table tbody thead tfoot tr td details dialog".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd th blockquote pre figure figcaption caption hr address summary head".split())
EMPTY = frozenset("br img hr input meta link area base col embed source track wbr".split())
LEFT_OUT = frozenset("nav footer aside dialog menu".split())
FORMS = frozenset("form fieldset".split())
NEVER = frozenset("html body main article".split())
HINT = re.compile(
    r"nav|navbar|navigation|menu|footer|sidebar|side|ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|"
    r"popup|modal|overlay|alert|newsletter|subscribe|signup|login|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|share|sharing|social|"
    r"related|recommend\w*|breadcrumbs?|pag(?:er|ination)|widget|masthead|topbar|toolbar|skip", re.I)
# Hints at parts that may well be longer than the article.
FIRM = re.compile(r"nav|navbar|navigation|menu|footer|cookies?|consent|gdpr|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion", re.I)
# Words that may stand with a hint in a class without changing what it says.
BESIDE = frozenset(
    "site page main global primary secondary top bottom left right box bar list area block section wrap wrapper inner container item items "
    "link links header post entry article form mobile desktop sticky fixed".split())
NAMED = re.compile(r"/(?:article|main)(?:[./]|$)")
PARTS = re.compile(r"[-_\d]+")
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"[\s ]+")
SHARE = 0.7
MOST = 0.5
KEPT = 0.5  # of the running text under a page's own path, so much at least must lie under its host's for that to be used
DEPTH = 128  # containers below lie in the last one
LONG = 60  # characters of a block that counts by itself as running text


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def hinted(token: str) -> bool | None:
    """Whether a class, id or role, taken whole, names a part left out, and firmly so; None if it does not."""
    parts = [x for x in PARTS.split(token.lower()) if x]
    hints = [x for x in parts if HINT.fullmatch(x)]
    if not hints or not all(x in BESIDE or HINT.fullmatch(x) for x in parts):
        return None
    return any(FIRM.fullmatch(x) for x in hints)


def general_name(tag: str, attributes: str) -> tuple[str, bool | None]:
    """Tag and classes with numbers generalised, and whether it is one of the parts left out: firmly, only if the page has most
    of its text elsewhere (False), or not at all (None)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in CLASS.finditer(attributes)} if attributes.strip() else {}
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()})
    name = ".".join([tag, *classes])
    if tag in NEVER:
        return name, None
    said = [hinted(x) for k in ("class", "id", "role") for x in found.get(k, "").split()] + [True if tag in LEFT_OUT else False if tag in FORMS else None]
    return name, max((x for x in said if x is not None), default=None)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it ends, attributes) of tags, comments and whole silent elements (these two without a tag).

    Every search goes on from the last place. A quote that is never closed, and a page without a further '>', end that kind of search
    for the rest of the page, so that time grows with the page however it is broken. What is no tag is text."""
    at, quoted = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        m = NAME.match(page, start + 1)
        if not m and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        end = m.end() if m else start + 2
        if m and quoted:
            stop = TAG_END.search(page, end)
            while stop and stop[0] != ">":
                close = page.find(stop[0], stop.end())
                stop = TAG_END.search(page, close + 1) if close >= 0 else None
            quoted = stop is not None
        if not m or not quoted:
            stop = TAG_END.search(page, page.find(">", end)) if page.find(">", end) >= 0 else None
        if stop is None:  # no tag can end any more
            end = page.find("<!--", start)
            if end >= 0:
                yield end, len(page), "", False, ""
            return
        at = stop.end()
        tag, ending = (m[2].lower(), bool(m[1])) if m else ("", False)
        if tag in SILENT and not ending:
            close = SILENT[tag].search(page, at)
            at = close.end() if close else len(page)
            yield start, at, "", False, ""
        else:
            yield start, at, tag, ending, page[end : at - 1]


def blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """(path, text, characters in links, whether a heading) of every block that is not left out, in page order."""
    out, stack, paths = [], [], [""]
    bad: list[tuple[int, ...]] = [()]  # by open container: numbers of those around it that are to be left out
    firm: list[bool] = []
    opened: Counter[str] = Counter()
    known: dict[tuple[str, str], str] = {}
    parts: list[str] = []
    linked, link_at, heading = 0, None, False

    def close() -> None:
        nonlocal linked, link_at
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            here = linked + (sum(map(len, parts[link_at:])) if link_at is not None else 0)
            out.append((bad[-1], (paths[-1], text, min(here, len(text)), heading)))
        parts.clear()
        linked, link_at = 0, None if link_at is None else 0

    at = 0
    for start, end, tag, ending, attributes in tokens(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if tag == "a":
            if not ending:
                link_at = len(parts)
            elif link_at is not None:
                linked += sum(map(len, parts[link_at:]))
                link_at = None
        elif tag == "br":
            parts.append(" ")
        elif tag in BREAKS:
            close()
            heading = tag in ("h1", "h2", "h3") and not ending
            if tag not in CONTAINERS:
                continue
            if not ending:
                name, left_out = general_name(tag, attributes)
                if tag == "header" and not opened["article"] + opened["main"]:
                    left_out = True
                above = paths[-1]
                paths.append(known.setdefault((above, name), f"{above}/{name}") if len(stack) < DEPTH else above)
                stack.append(tag)
                opened[tag] += 1
                if left_out is None or len(bad[-1]) >= DEPTH:
                    bad.append(bad[-1])
                else:
                    bad.append((*bad[-1], len(firm)))
                    firm.append(left_out)
            elif opened[tag]:
                while True:
                    paths.pop()
                    bad.pop()
                    last = stack.pop()
                    opened[last] -= 1
                    if last == tag:
                        break
    if at < len(page):
        parts.append(page[at:])
    close()
    taken_back = most_of_the_page(out, firm)
    return [x for around, x in out if taken_back.issuperset(around)]


def most_of_the_page(found: list[tuple[tuple[int, ...], tuple]], firm: list[bool]) -> set[int]:
    """Containers that are left out by a hint or as a form but hold most of the running text that is in no firmly left out
    part, and those around them: they are the page itself. None if an article or main outside of them has text."""
    if not firm or any(not around and weight_of(x) > 0 and NAMED.search(x[0]) for around, x in found):
        return set()
    held: dict[tuple[int, ...], int] = {}
    for around, block in found:
        if not any(firm[c] for c in around):
            held[around] = held.get(around, 0) + weight_of(block)
    total = sum(held.values())
    return {c for around, n in held.items() if n > MOST * total for c in around}


def weight_of(block: tuple[str, str, int, bool]) -> int:
    return len(block[1]) - block[2]


def best_path(found: list[tuple[str, str, int, bool]]) -> tuple[str, float]:
    """The container of the running text, and how much it holds: the shallowest article or main that holds SHARE of it, else
    the deepest container of all long blocks and headings (of all blocks if there are none)."""
    totals: dict[str, float] = {}
    at_path: Counter[str] = Counter()
    for block in found:
        at_path[block[0]] += weight_of(block)
    for path, weight in at_path.items():
        while True:
            totals[path] = totals.get(path, 0.0) + weight
            if not path:
                break
            path = path.rpartition("/")[0]
    whole = totals.get("", 0.0)
    if whole <= 0:
        return "", whole
    named = [p for p, w in totals.items() if NAMED.search(p) and w >= SHARE * whole]
    if named:
        best = min(named, key=lambda p: (p.count("/"), p))
        return best, totals[best]
    running = [b for b in found if weight_of(b) > 0]
    high = [b for b in running if weight_of(b) >= LONG and 2 * b[2] <= len(b[1])]
    high = high + [b for b in running if b[3]] if high else running
    common = high[0][0].split("/")
    for path in {b[0] for b in high}:
        steps = path.split("/")
        n = next((i for i, (x, y) in enumerate(zip(common, steps)) if x != y), min(len(common), len(steps)))  # noqa: B905
        common = common[:n]
    best = "/".join(common)
    return best, totals[best]


def under(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def text_under(found: list[tuple[str, str, int, bool]], root: str | None) -> str:
    """Blocks under the host's path, or under the page's own best one if its own goes beyond the host's or the host's holds less
    than KEPT of the running text of its own (none, where the page has no such container)."""
    chosen = [b for b in found if root is not None and under(b[0], root)]
    own, weight = best_path(found)
    if sum(map(weight_of, chosen)) < KEPT * weight or not chosen or (own != root and under(root, own)):
        chosen = [b for b in found if under(b[0], own)]
    return "\n".join(b[1] for b in chosen)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host, then most text, then first by name."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_path(blocks(h)) if h else ("", 0.0) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([p for p, _ in best], pa.string()), pa.array([w for _, w in best], pa.float64())],
                names=["host", "path", "weight"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(job, "host string, path string, weight double")
    counted = cast.filter("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "weight", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, path (the host's winning path)."""
    winners = stage(votes(pages)).withColumnRenamed("host", "_host")
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = keyed.join(winners, F.col("host").eqNullSafe(F.col("_host")), "left").select("page_id", "url", "html", "path")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, path = batch.column("html").to_pylist(), batch.column("path")
            text = [text_under(blocks(h), p) if h else "" for h, p in zip(html, path.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), path], names=["page_id", "url", "text", "path"])

    return joined.select(F.col("page_id").cast("long"), "url", "html", "path").mapInArrow(job, "page_id long, url string, text string, path string")
