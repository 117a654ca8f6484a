"""Main text of web pages by consensus of the pages of each host.

1. Each page is read into blocks.  Every container (element that holds blocks) is scored by its text, less what lies in links
   and in regions that are never main text, and votes for its generalised path: tags with classes, digits taken out, ids left
   out, repeated siblings alike.
2. Votes are summed for each host and path in Spark; for each host the path with the most wins.  The path is then widened:
   from the winner, which may hold only the sections or wrapped paragraphs of a text, out to the container that also has the
   title, the lead and the other parts (see ``widened``).
3. Pages are read again with the path that their host has chosen.  A page without that path uses its own best container.

Never main text: navigation, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, comments
of readers and markup (by tag, role, or a class or id that says nothing else; an article only if it is named as a comment).  A
form that holds an article, a main element or a first heading is one around the text.  If nothing is left of a page, forms and
names of PLACES do not count against its text.

A path is a 64-bit number made step by step, so a page's paths take as much room as its elements, however deep they are.

Defined cases: a null or empty page has an empty text; a page without a host extracts by itself; broken, cut and unclosed
markup is read as far as it goes, very long and deep pages in time that grows with them; paths that tie for a host are told
apart by their numbers, so that every run chooses the same; repeated rows and null ids are read like any other; an empty table
gives no rows.

Limits: parts of a text in sibling containers of different paths are taken together only below an article or main element or
a container named for its text, or beside text that lies directly in their parent; the body itself is taken only if it
directly holds a heading and at least half of what it adds.  A path is widened over AROUND containers at most.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import written

# fixed values: elements of HTML by their role here
RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea select title head".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form button dialog menu annotation annotation-xml".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div body td center".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES_P = BLOCK - {"html", "body"}
CLOSES_SELF = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Parts of names (classes, ids) of what is never main text, and parts that such names have beside them.  A name of these alone
#: is dropped anywhere; one that has them beside other parts (section-header) gets no votes, but stays within the chosen path.
BAD_WORDS = frozenset("nav navbar navigation menu header masthead topbar footer sidebar aside widget ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login form search share sharing social breadcrumb breadcrumbs pagination pager related recommended comment comments respond reply replies disqus toolbar skip copyright legal".split())
BESIDE = frozenset("site page global main top bottom left right box wrap wrapper container area slot block bar list inner outer links buttons posts".split())
#: A name of a part of readers' comments has one of the first, and nothing beside it but these.
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus".split())
OF_COMMENTS = COMMENT_WORDS | BESIDE | frozenset("body content text meta author avatar form section thread threads item items title header heading footer metadata entry depth even odd user byuser bypostauthor nested children".split())
#: Words that say where something stands rather than what it is.
PLACES = frozenset("banner header masthead form widget promo".split())
#: What runs together with a bad word in one name (commentlist, navbar).
ENDINGS = frozenset("list bar box area wrap block form body links menu".split())
TEXT_WORDS = frozenset("content article post entry main story".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

#: Quotes hold an attribute's value only where they begin it.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DIGITS = re.compile(r"[\d/]+")
WORDS = re.compile(r"[a-z]+")
#: What a form around the page's text holds, and one to fill in does not.
WITHIN = re.compile(r"<(?:h1|article|main)\b", re.I)
FORM_END = re.compile(r"</form\b", re.I)
#: So many containers around one are looked at when its path is widened.
AROUND = 32
GOOD, DOUBTFUL, BAD = range(3)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def named(tag: str, found: dict[str, str]) -> str:
    """A step of a generalised path."""
    classes = sorted({DIGITS.sub("", c) for c in found.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


def extended(path: int, step: str) -> int:
    """The 64-bit number of a path, made from that of the path around it."""
    return xxhash.xxh3_64_intdigest(step.encode("utf-8", "replace"), path & (1 << 64) - 1) - (1 << 63)


def parts_of(name: str) -> set[str]:
    """The words of a class or id, and the two of a bad word and an ending that run together."""
    out: set[str] = set()
    for word in WORDS.findall(name):
        split = next((k for k in range(2, len(word)) if word[:k] in BAD_WORDS and word[k:] in ENDINGS), 0) if word not in BAD_WORDS else 0
        out |= {word[:split], word[split:]} if split else {word}
    return out


def verdict(tag: str, found: dict[str, str], inside: bool, loose: bool = False) -> int:
    """GOOD, DOUBTFUL or BAD.  inside: within an article or main element, where a header belongs to the text.  loose: forms and
    names of PLACES say nothing."""
    if loose and tag == "form":
        return GOOD
    if tag in NEVER or (tag == "header" and not inside):
        return BAD
    if not found:
        return GOOD
    if found.get("role", "").lower() in BAD_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return BAD
    if tag in ("html", "body", "main"):
        return GOOD
    worst, bad = GOOD, BAD_WORDS - PLACES if loose else BAD_WORDS
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = parts_of(name)
        if parts & COMMENT_WORDS and not parts - OF_COMMENTS:
            return BAD
        if tag == "article":
            continue
        if parts & bad and not parts - bad - BESIDE:
            return BAD
        if parts & bad and not (parts & TEXT_WORDS):
            worst = DOUBTFUL
    return worst


@dataclass
class Page:
    """Blocks of text in page order, and the containers around them; a container comes after those around it."""

    texts: list[str] = field(default_factory=list)
    #: Of each block: its innermost container or -1, characters in links, whether it is a heading, whether it is doubtful.
    blocks: list[tuple[int, int, bool, bool]] = field(default_factory=list)
    #: Of each container: the number of its path, the container around it or -1, and its kind.
    containers: list[tuple[int, int, int]] = field(default_factory=list)

    def around(self, k: int, most: int) -> list[int]:
        """A container and those around it, from the inside."""
        out: list[int] = []
        while k >= 0 and len(out) < most:
            out.append(k)
            k = self.containers[k][1]
        return out

    def below(self, path: int | None) -> list[bool]:
        """Of each container, whether it is one of path or in one."""
        out: list[bool] = []
        for own, outer, _ in self.containers:
            out.append(own == path or (outer >= 0 and out[outer]))
        return out


def kind(tag: str, found: dict[str, str]) -> int:
    """2 for article and main, 1 for a container whose class says that it holds the text, 0 for others, -1 for the body."""
    if tag in ("article", "main"):
        return 2
    return -1 if tag == "body" else int(bool(TEXT_WORDS.intersection(WORDS.findall(found.get("class", "").lower()))))


class Open(NamedTuple):
    """An open element: what it is, and what holds for all that is in it."""

    tag: str
    path: int
    container: int
    verdict: int
    heading: bool
    inside: bool


OUTSIDE = Open("", 0, -1, GOOD, False, False)


def read(page: str) -> Page:
    """A page of which nothing would be left is read without forms and names of PLACES, if that finds main text."""
    out = blocks_of(page, False)
    if out.texts or not page:
        return out
    again = blocks_of(page, True)
    return again if any(worth(text, links) for text, (_, links, *_) in zip(again.texts, again.blocks, strict=True)) else out


def blocks_of(page: str, loose: bool) -> Page:
    """Time and memory grow with the page, however deep its elements are."""
    out, stack, held = Page(), [], []
    within, form_end = [-1], [-1]  # the next places of what they are named for
    open_tags: defaultdict[str, int] = defaultdict(int)
    state = {"links": 0}
    # of each tag with its attributes, the path around it, whether that is an article, and whether it is a form around text: its path, verdict and kind
    seen: dict[tuple[str, str, int, bool, bool], tuple[int, int, int]] = {}

    def top() -> Open:
        return stack[-1] if stack else OUTSIDE

    def close_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.texts.append(text)
                out.blocks.append((top().container, state["links"], top().heading, top().verdict == DOUBTFUL))
            held.clear()
        state["links"] = 0

    def pop_to(k: int) -> None:
        while len(stack) > k:
            open_tags[stack.pop().tag] -= 1

    def last(tags: tuple[str, ...], until: tuple[str, ...] = ()) -> int:
        for tag in tags:
            if open_tags[tag]:
                break
        else:
            return -1
        for k in range(len(stack) - 1, -1, -1):
            tag = stack[k].tag
            if tag in tags:
                return k
            if tag in until:
                break
        return -1

    def said(text: str) -> None:
        if text and top().verdict != BAD:
            held.append(text)
            state["links"] += len(text) * (open_tags["a"] > 0)

    def following(held_at: list[int], what: re.Pattern) -> int:
        """The next place of what; each part of the page is searched once."""
        if held_at[0] < at:
            m = what.search(page, at)
            held_at[0] = m.start() if m else n
        return held_at[0]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = last((tag,), ("table",) if tag not in ("table", "html", "body") else ())
            if k >= 0:
                if tag in BLOCK or (k < len(stack) - 1 and any(x.tag in BLOCK for x in stack[k:])):
                    close_block()
                pop_to(k)
            elif tag in BLOCK:
                close_block()
            continue
        if tag == "br" or tag == "wbr":
            said(" " if tag == "br" else "")
            continue
        if tag == "body" and (k := last(("head",))) >= 0:
            pop_to(k)
        if tag in BLOCK:
            close_block()
            if tag in CLOSES_P and (k := last(("p",), ("table", "td", "th", "article", "div", "section", "li", "blockquote", "body"))) >= 0:
                pop_to(k)
            if tag in CLOSES_SELF and (k := last(tuple(CLOSES_SELF[tag][0].split()), CLOSES_SELF[tag][1])) >= 0:
                pop_to(k)
        if tag in VOID:
            continue
        over = top()
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        wraps = tag == "form" and following(within, WITHIN) < following(form_end, FORM_END)
        key = tag, m[3], over.path, over.inside, wraps
        if key not in seen:
            found = attributes(m[3]) if m[3].strip(" /\n\t\r") else {}
            seen[key] = extended(over.path, named(tag, found)) if tag in BLOCK else over.path, verdict(tag, found, over.inside, loose or wraps), kind(tag, found)
        path, own, of = seen[key]
        judged, number = max(over.verdict, own), over.container
        if tag in CONTAINER and judged == GOOD:
            out.containers.append((path, number, of))
            number = len(out.containers) - 1
        open_tags[tag] += 1
        stack.append(Open(tag, path, number, judged, over.heading or tag in HEADINGS, over.inside or tag in ("article", "main")))
    close_block()
    return out


def worth(text: str, links: int) -> int:
    """Characters of main text: none of a short label, and less what lies in links."""
    return max(0, len(text) - 2 * links) if len(text) > 25 or text.endswith((".", "!", "?", ":")) else 0


def scores(page: Page) -> dict[int, float]:
    """Points of each path.  A block counts for the container that holds it directly, less for those further out, and not at
    all as far as it is links; so the body around everything does not win.  A paragraph's wrapper or a section may win over
    its article; ``widened`` goes from there to the article."""
    points: dict[int, float] = {}
    for text, (own, links, _, doubtful) in zip(page.texts, page.blocks, strict=True):
        for k, share in zip(page.around(own, 3) if not doubtful else (), (1.0, 0.6, 0.3)):
            path, _, of = page.containers[k]
            points[path] = points.get(path, 0.0) + worth(text, links) * share * (1.2 if of == 2 else 1.0)
    return points


Sums = tuple[int, float, float, float, float]


def totals(page: Page) -> dict[int, list[int]]:
    """For each path its kind, characters of the text under it, of that in links, of main text and headings directly in it, and
    of headings directly in it."""
    each = [[of, 0, 0, 0, 0] for _, _, of in page.containers]
    for text, (own, links, heading, doubtful) in zip(page.texts, page.blocks, strict=True):
        if own >= 0 and not doubtful:
            good = max(0, len(text) - 2 * links) if heading else worth(text, links)
            for c, x in enumerate((len(text), min(links, len(text)), good, good * heading), 1):
                each[own][c] += x
    out: dict[int, list[int]] = {}
    for k in range(len(each) - 1, -1, -1):
        path, outer, _ = page.containers[k]
        if outer >= 0:
            each[outer][1] += each[k][1]
            each[outer][2] += each[k][2]
        if each[k][1]:
            sums = out.setdefault(path, [each[k][0], 0, 0, 0, 0])
            sums[1:] = [a + b for a, b in zip(sums[1:], each[k][1:], strict=True)]
    return out


def widened(chain: list[tuple[int, Sums]]) -> int:
    """chain: (path, sums) of a path and of those of the containers around it, from the inside.  Gives the path, or the
    outermost container around it whose further text is still mainly main text.

    A container of a higher kind than those within it is taken if at most half of what it adds is links.  Another is taken if
    main text and headings directly in it are at least half of what it adds; one of a lower kind must
    directly hold a heading, too; from an article or main element only another such element is taken, and the body only if
    nothing below it is of kind 1 or 2.
    """
    now, (best, chars, in_links, *_) = chain[0]
    for outer, (is_of, all_chars, all_links, direct, headings) in chain[1:]:
        more, links = all_chars - chars, all_links - in_links
        if more <= 0 or (best == 2 and is_of < 2) or (is_of < 0 < best) or (is_of < best and not headings):
            continue
        if 2 * direct >= more or (is_of > best and is_of > 0 and 2 * links <= more):
            now, best, chars, in_links = outer, max(best, is_of), all_chars, all_links
    return now


def best_path(points: dict[int, float], sums: dict[int, Sums], around: dict[int, list[int]]) -> int | None:
    """The path with the most points, widened."""
    if not any(x > 0 for x in points.values()):
        return None
    best = max(sorted(points), key=points.__getitem__)
    return widened([(p, sums[p]) for p in around[best]])


def surroundings(page: Page) -> dict[int, list[int]]:
    """Of each path with text directly in it or near, itself and the paths around it."""
    out: dict[int, list[int]] = {}
    for own, *_ in page.blocks:
        for k in page.around(own, 3):
            if page.containers[k][0] not in out:
                out[page.containers[k][0]] = [page.containers[j][0] for j in page.around(k, AROUND)]
    return out


def extracted(text: str | None, path: int | None) -> str:
    """The text under path, or under the page's own best container, widened, if it has none there."""
    page = read(text or "")
    below = page.below(path)
    if not any(own >= 0 and below[own] for own, *_ in page.blocks):
        path = best_path(scores(page), totals(page), surroundings(page))
        below = page.below(path)
    if path is None:
        sure = [x for x, (*_, doubtful) in zip(page.texts, page.blocks, strict=True) if not doubtful]
        return "\n".join(sure or page.texts)
    return "\n".join(x for x, (own, *_) in zip(page.texts, page.blocks, strict=True) if own >= 0 and below[own])


HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


SUMS = ("points", "chars", "links", "direct", "headings")
VOTES = "host string, path long, around array<long>, kind int, " + ", ".join(f"{c} double" for c in SUMS)


def votes(pages: DataFrame) -> DataFrame:
    """VOTES: every page gives each of its containers' paths its share of 1 point, and its totals as shares of the page's
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = read(text)
                points, around = scores(page), surroundings(page)
                total, chars = sum(points.values()), sum(map(len, page.texts))
                if total > 0:
                    out += [(host, p, around.get(p, []), sums[0], points.get(p, 0.0) / total, *[x / chars for x in sums[1:]]) for p, sums in totals(page).items()]
            columns = list(zip(*out, strict=True)) or [()] * (4 + len(SUMS))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), *[pa.float64()] * len(SUMS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "around", "kind", *SUMS])

    # a sum of rounded shares does not depend on the order of its rows
    shares = [F.sum(F.round(F.col(c) * 1e6).cast("long")).alias(c) for c in SUMS]
    given = pages.select("host", "html").where(F.col("host").isNotNull() & F.col("html").isNotNull())
    return given.mapInArrow(run, VOTES).groupBy("host", "path").agg(F.max("around").alias("around"), F.max("kind").alias("kind"), *shares)


def winners(tally: DataFrame) -> DataFrame:
    """(host, path): of each host the path with the most points, widened over the paths around it."""
    most = tally.where("points > 0").groupBy("host").agg(F.max(F.struct("points", "path", "around")).alias("best"))
    chain = most.select("host", F.posexplode("best.around").alias("at", "path"))
    held = chain.join(tally.drop("around"), ["host", "path"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "path", "kind", F.array(*SUMS[1:]).alias("sums")))).alias("chain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [widened([(x["path"], (x["kind"], *x["sums"])) for x in chain]) for chain in batch.column("chain").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.int64())], names=["host", "path"])

    return held.mapInArrow(run, "host string, path long")


def main_text(pages: DataFrame, page: str = "html", url: str = "url", keep: list[str] | None = None, max_broadcast: int = 50_000, salts: int = 32) -> DataFrame:
    """The kept columns with text and n_chars of every page; kept columns of these names give way to them.

    The winners, one short row for each host, are broadcast up to max_broadcast hosts; beyond that pages meet them in a
    salted shuffle join, so a host that has a third of all pages is dealt over many tasks.
    """
    names = [c for c in keep or pages.columns if c not in ("text", "n_chars")]
    host = F.regexp_extract(F.lower(F.col(f"`{url}`")), HOST, 1)
    rows = pages.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{page}`").alias("html"), F.when(host != "", host).alias("host"))
    won = written(winners(written(votes(rows), "votes")), "paths")
    if won.count() <= max_broadcast:
        met = rows.join(F.broadcast(won), "host", "left")
    else:
        dealt = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extracted(p, path) for p, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    ready = met.select("row", "html", "path")
    out = ready.mapInArrow(run, f"row {ready.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "text", "n_chars")
