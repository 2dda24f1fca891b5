"""Main text of web pages by templates deduced from pages of the same host.

1. Each page becomes tokens: its elements by their path (with class names), and its pieces of text by their path and
   content.  A token's occurrence vector over the pages of its host, and over the host's pages of the same layout, is
   summarised by sums of hashes of (page, count), which add up in any order, so vectors are never gathered.
2. Tokens of equal vectors are an equivalence class.  A class is valid if it has more than one token and spans at least
   three pages and nine tenths of the pages in question.  Valid classes nest: the element around a member (for a text,
   around its block) must be of a valid class itself, or be the page.  What is left is the template.
3. A page's slots are what its template leaves open.  Menus, headers, footers, sidebars, notices, adverts, forms and
   comments go by their element, role or name; a name that only hints at them goes if the template has the element.
   Where a page marks an article, the rest of it is the page's own.  Where it marks a main part, boxes in it go that
   hold nothing but template text; a repeated sentence among the page's own stays.  Where it marks neither, the template
   element that is found once on each page and holds the most open text takes its place, and all template text goes.
   A page without any open text keeps its own.

Character references are decoded; white space within a block becomes one blank, and blocks follow in page order.

Defined cases.  Null and empty pages have empty text.  A null address is a host of its own.  Rows of equal address and
markup count as one page, so repeats change no template.  Hosts of one or two pages have no template and rely on their
markup.  Broken markup is read as a browser does: an unended comment, tag or script takes the rest of the page.  An
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblode.session import materialize

#: A token is fixed if it is on this share of at least so many pages of its host or layout.
FIXED_SHARE = 0.9
FIXED_PAGES = 3
#: Elements nested deeper count as part of the last one that is not, as in browsers.
DEPTH = 256

#: Element names by what they do to text.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
DROPPED = frozenset(
    "head nav header footer aside form menu dialog select button fieldset option datalist svg canvas object audio video "
    "map".split()
)
#: An article is the page's own from end to end; a main part may hold boxes that are not.
MAIN, ARTICLE = 1, 2
CONTAINERS = {"main": MAIN, "article": ARTICLE}
#: Words in class, id or role that mark such parts.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside complementary contentinfo "
    "notice notices alert cookie cookies consent gdpr modal popup overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended "
    "toolbar pagination pager search form widget hidden".split()
)
#: Those of them that mean nothing else as the first word of a class or as a whole id.
PLAIN_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promoted nav navbar navigation breadcrumb "
    "breadcrumbs cookie cookies consent gdpr newsletter subscribe comments commentlist comment disqus respond sidebar "
    "pagination pager social".split()
)
#: Roles of such parts.
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements that are text, and those that hold boxes of it.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote figcaption caption".split())
_UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
_BOXES = frozenset("div section ul ol dl table figure center details".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table article main section aside nav header footer form body blockquote".split())

_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)|["'](?!.)))*+)>""", re.S
)
_MARKED = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW}
_ROLE = re.compile(r"(?i)role\s*=\s*[\"']?(main|article)\b")
_WORD_CUT = re.compile(r"[^a-z0-9]+")


class Piece:
    """One block of text: where it lies and what it says; ``hint`` is the path of a part that a name may mark."""

    __slots__ = ("dropped", "container", "path", "text", "hint")

    def __init__(self, dropped: bool, container: int, path: str, text: str, hint: str = ""):
        self.dropped, self.container, self.path, self.text, self.hint = dropped, container, path, text, hint


def _marks_of(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """Class names for the path, whether the element is a part to drop, and whether its class hints at one.

    Roles and whole class names decide.  Inside a marked article a name of several words decides only if two of them
    mark such parts or the first one means nothing else, and no id decides for a heading or section; outside, one word
    does, except for elements that are text themselves.
    """
    if "=" not in attributes:
        return "", False, False
    shown, dropped, hinted = "", False, False
    for kind, value in _MARKED.findall(attributes):
        value, kind = value.strip("\"'").lower(), kind.lower()
        names = value.split()
        if kind == "role":
            dropped = dropped or not ROLES.isdisjoint(names)
            continue
        if kind == "class":
            shown = "." + ".".join(names)
        for whole in names:
            # Names are compared by word, so "ad-slot" is an advert and "shadow" is not.
            words = [w for w in _WORD_CUT.split(whole) if w]
            found = sum(w in MARKS for w in words)
            if not found or name in _UNNAMED and (kind == "id" or name != "section"):
                continue
            if kind == "class":
                sure = len(words) == 1 or found > 1 or words[0] in PLAIN_MARKS
            else:
                sure = len(words) == 1 and words[0] in PLAIN_MARKS
            if sure or not inside and name not in _TEXTUAL:
                dropped = True
            elif kind == "class" and name not in _TEXTUAL:
                hinted = True
    return shown, dropped, hinted


def parse(page: str) -> tuple[list[Piece], Counter]:
    """The blocks of a page in order, and its elements by path with their counts."""
    return blocks_of(page)[:2]


def blocks_of(page: str) -> tuple[list[Piece], Counter, list[list]]:
    """The blocks of a page in order, its elements by path with their counts, and the boxes inside its main part.

    A box is the range of blocks it holds: ``[first, behind the last]``.
    """
    # name, dropped, container, path, hint, box
    stack: list[tuple[str, bool, int, str, str, list | None]] = [("", False, 0, "", "", None)]
    boxes: list[list] = []
    pieces: list[Piece] = []
    elements: Counter = Counter()
    beyond: Counter = Counter()
    held: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = next((s for s in reversed(stack) if s[0] not in INLINE), stack[0])
                pieces.append(Piece(top[1], top[2], top[3], text, top[4]))

    def end_boxes(k: int) -> None:
        for entry in stack[k:]:
            if entry[5] is not None:
                entry[5][1] = len(pieces)

    def close(names: tuple[str, ...] | frozenset, scopes: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                end_boxes(k)
                del stack[k:]
                return
            if stack[k][0] in scopes:
                return

    while at < end:
        cut = page.find("<", at)
        if cut < 0:
            cut = end
        if cut > at:
            held.append(entities.unescape(page[at:cut]))
            at = cut
            if at == end:
                break
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 2)
            at = stop + 3 if stop >= 0 else end
            continue
        following = page[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not page[at + 2 : at + 3].isalpha()):
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        tag = _TAG.match(page, at)
        if tag is None:
            if not following.isascii() or not (following.isalpha() or following == "/"):
                held.append("<")  # not a tag: a sign in the text
                at += 1
                continue
            break  # an unended tag takes the rest
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if beyond[name]:
                beyond[name] -= 1
                if name not in INLINE:
                    flush()
            elif name in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            elif name == "p" and not any(s[0] == "p" for s in stack):
                flush()
            else:
                close((name,), frozenset() if name in _SCOPES else _SCOPES - {name})
            continue
        if name == "br":
            held.append(" ")
            continue
        shown, dropped, hinted = _marks_of(name, tag[3], stack[-1][2])
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            if stop is None:
                break
            past = page.find(">", stop.end())
            at = past + 1 if past >= 0 else end
            continue
        if name not in INLINE:
            flush()
            if name in _ENDS_P:
                close(("p",), _SCOPES)
            if name in _CLOSES:
                close(_CLOSES[name], _SCOPES)
            while stack[-1][0] in INLINE:
                stack.pop()
        parent = stack[-1]
        if name in VOID:
            continue
        if len(stack) > DEPTH:
            beyond[name] += 1
            continue
        if dropped and not (name in INLINE or name in CONTAINERS or name in ("html", "body")):
            flush()
        path = parent[3] if name in INLINE else f"{parent[3]}/{name}{shown}"
        lost = parent[1] or name in DROPPED or (dropped and name not in CONTAINERS and name not in ("html", "body"))
        role = _ROLE.search(tag[3])
        inside = max(parent[2], CONTAINERS.get(name, 0), CONTAINERS[role[1].lower()] if role else 0)
        if name in INLINE and dropped:
            # A marked inline part is its own piece.
            flush()
            stack.append((name + "!", lost, inside, path, parent[4], None))
            continue
        hint = parent[4] or (path if hinted and name not in INLINE else "")
        box = None
        if name not in INLINE:
            elements[path] += 1
            if parent[2] == inside == MAIN and name in _BOXES:
                box = [len(pieces), None]
                boxes.append(box)
        stack.append((name, lost, inside, path, hint, box))
    flush()
    end_boxes(0)
    return pieces, elements, boxes


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def piece_token(piece: Piece) -> int:
    return _hash(f"{piece.path}\n{piece.text}")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_FRAME = r"""(?i)<(?:div|section|main|article|aside|nav|header|footer|form|body)(?=[\s>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_NAMES = r"""(?is)^<([a-z]+)(?:.*?\sclass\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?.*$"""


def layout_of(html: Column) -> Column:
    """Pages framed by the same kinds of elements have the same layout: a hash of their names and classes, less digits."""
    frame = F.regexp_extract_all(html, F.lit(_FRAME), F.lit(0))
    kinds = F.transform(frame, lambda tag: F.regexp_replace(F.lower(F.regexp_replace(tag, _NAMES, "$1 $2")), "[0-9\"']", ""))
    return F.coalesce(F.xxhash64(F.array_sort(F.array_distinct(kinds))), F.lit(0))


def _tokens(pages: DataFrame) -> DataFrame:
    """``host, layout, page, token, parent, n, open`` per page and token.

    ``parent`` is the token of the element around it, for a text of the one around its block.  ``open`` is how many
    characters of undropped text an element holds directly, for choosing a container.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, layout, page, text in zip(batch["host"], batch["layout"], batch["page"], batch["html"], strict=True):
                pieces, elements = parse(text or "")
                opened: Counter = Counter()
                for p in pieces:
                    if not p.dropped:
                        opened[p.path.rpartition("/")[0]] += len(p.text)
                        opened[p.path] += len(p.text)
                for path, n in elements.items():
                    rows.append((host, layout, page, _hash(path), _hash(path.rpartition("/")[0]), n, opened[path]))
                for token, (n, around) in _counted(pieces).items():
                    rows.append((host, layout, page, token, _hash(around), n, 0))
            yield pd.DataFrame(rows, columns=["host", "layout", "page", "token", "parent", "n", "open"])

    return pages.mapInPandas(run, "host string, layout bigint, page bigint, token bigint, parent bigint, n int, open bigint")


def _counted(pieces: list[Piece]) -> dict[int, tuple[int, str]]:
    out: dict[int, tuple[int, str]] = {}
    for p in pieces:
        token = piece_token(p)
        out[token] = (out.get(token, (0, ""))[0] + 1, p.path.rpartition("/")[0])
    return out


def _once(pages: DataFrame) -> DataFrame:
    """Pages without repeats.  Only those that repeat are moved."""
    repeated = materialize(pages.groupBy("page").count().filter("count > 1").select("page"), "template-repeats")
    one = pages.join(repeated, "page", "left_semi").dropDuplicates(["page"])
    return pages.join(repeated, "page", "left_anti").unionByName(one)


def templates(pages: DataFrame, fixed_share: float = FIXED_SHARE, fixed_pages: int = FIXED_PAGES) -> DataFrame:
    """``host, layout, fixed, slot`` per layout of a host that has a template.

    ``fixed`` are the tokens of the template, those of all the host's pages included; ``slot`` is the once-per-page
    element with most open text.  ``pages``: host, page, html.
    """
    pages = pages.select("host", "page", "html", layout_of(F.col("html")).alias("layout"))
    # A page counts among all of its host (level 0) and among those of its layout (level 1).
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), v.alias("within")) for k, v in enumerate((F.lit(0), F.col("layout")))]))
    tokens = _tokens(_once(pages)).select("*", levels.alias("l")).select("*", "l.level", "l.within")
    group = ["host", "level", "within"]
    vector = F.xxhash64("page", "n")
    seen = tokens.groupBy(*group, "token").agg(
        F.min("parent").alias("parent"),
        F.count("*").alias("pages"),
        F.max("n").alias("most"),
        F.sum("open").alias("open"),
        F.sum(F.pmod(vector, F.lit(2_147_483_647))).alias("v1"),
        F.bit_xor(vector).alias("v2"),
    )
    kinds = materialize(pages.select("host", "layout", "page").distinct().groupBy("host", "layout").agg(F.count("*").alias("of")), "template-layouts")
    of = kinds.groupBy("host").agg(F.sum("of").alias("of")).select("host", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("within"), "of")
    of = of.unionByName(kinds.select("host", F.lit(1).alias("level"), F.col("layout").alias("within"), "of"))
    # Only tokens on enough of a group's pages can be of a valid class; few are, so the rest is narrow.
    common = seen.filter(F.col("pages") >= fixed_pages).join(of, group)
    common = materialize(common.filter(F.col("pages") >= fixed_share * F.col("of")), "template-tokens")
    vectors = [*group, "pages", "v1", "v2"]
    classes = common.groupBy(*vectors).agg(F.count("*").alias("members")).filter("members > 1")
    valid = common.join(classes, vectors, "left_semi").select(*group, "token", "parent", "most", "open")
    # Nesting: what surrounds a member must itself be of a valid class, or be the page.
    around = valid.select(*group, F.col("token").alias("parent"))
    root = F.col("parent") == _hash("")
    nested = valid.filter(root).unionByName(valid.filter(~root).join(around, [*group, "parent"], "left_semi"))
    # A template is at most as long as the pages that hold nine tenths of it.
    found = nested.groupBy(*group).agg(
        F.collect_set("token").alias("fixed"),
        F.max_by("token", F.when((F.col("most") == 1) & (F.col("open") > 0), F.col("open"))).alias("slot"),
    )
    found = materialize(found, "templates")
    whole = found.filter("level = 0").select("host", F.col("fixed").alias("fixed0"), F.col("slot").alias("slot0"))
    own = found.filter("level = 1").select("host", F.col("within").alias("layout"), F.col("fixed").alias("fixed1"), F.col("slot").alias("slot1"))
    none = F.array().cast("array<bigint>")
    return (
        kinds.join(whole, "host", "left")
        .join(own, ["host", "layout"], "left")
        .select(
            "host",
            "layout",
            F.array_union(F.coalesce("fixed0", none), F.coalesce("fixed1", none)).alias("fixed"),
            F.coalesce("slot1", "slot0").alias("slot"),
        )
        .filter("size(fixed) > 0")
    )


def main_text(page: str | None, fixed: frozenset, slot: int | None) -> str:
    """The article of one page: open slots of its container in order."""
    pieces, elements, boxes = blocks_of(page or "")
    held = [not fixed or piece_token(p) not in fixed for p in pieces]
    lost = [p.dropped or bool(p.hint) and _hash(p.hint) in fixed for p in pieces]
    marked = [i for i, p in enumerate(pieces) if p.container and not lost[i]]
    if marked:
        gone: set[int] = set()
        last = -1
        # Boxes open in page order, so one inside another that went is passed over.
        for first, behind in boxes if any(held[i] for i in marked) else ():
            inside = range(max(first, last), behind)
            if behind > last and not any(held[i] and not lost[i] for i in inside):
                gone.update(inside)
                last = behind
        kept = [i for i in marked if i not in gone]
    else:
        kept = [i for i in range(len(pieces)) if not lost[i]]
        chosen = None if slot is None else next((path for path in elements if _hash(path) == slot), None)
        if chosen is not None:
            inside = [i for i in kept if pieces[i].path == chosen or pieces[i].path.startswith(chosen + "/")]
            kept = inside or kept
        # A page all of whose text is fixed is one of several copies.
        kept = [i for i in kept if held[i]] or (kept if chosen is not None else [])
    return "\n".join(pieces[i].text for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    given = pages.select(
        "page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("page"),
        layout_of(F.col("html")).alias("layout"),
    )
    found = materialize(templates(given.select("host", "page", "html")), "page-templates")
    joined = given.join(found, ["host", "layout"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "host", "layout", "fixed", F.col("slot").cast("string").alias("slot")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sets = [], {}
            for page, fixed, slot, *name in zip(*(batch[c] for c in ("html", "fixed", "slot", "host", "layout")), strict=True):
                known = None if slot is None else int(slot)
                if tuple(name) not in sets:
                    sets[tuple(name)] = frozenset() if fixed is None else frozenset(map(int, fixed))
                texts.append(main_text(page, sets[tuple(name)], known))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    out = joined.mapInPandas(run, "page_id string, url string, text string")
    kind = dict(pages.dtypes)["page_id"]
    return out.select(
        F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
