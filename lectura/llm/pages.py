"""Main text of web pages, by templates deduced from equivalence classes of tokens.

Tokens of a page are its elements, by path, and its text blocks, by path and wording. Tokens of a host that occur
equally often on each of its pages share an occurrence vector and form a class. Classes that cover nearly all pages
are the host's template: their elements nest into a tree of containers, their texts are the fixed wording, and what is
left between them are slots. The slots that hold an article are extracted; menus, adverts and the like are told by the
names of the elements around them.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import ship, stored

from .common import map_rows

LEAST_PAGES = 8  # different pages of a host before its wording can be called fixed
SUPPORT = 0.9  # of a host's different pages that hold a template class
LEAST_TOKENS = 2  # in a class

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {  # elements that end an open element of these names
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
SCOPES = frozenset("ul ol dl select table article section div nav aside body form main header footer td th".split())
# Names of parts that are not the article. The first are elements, the second words of class, id and role.
NOT_TEXT = frozenset("head nav footer aside form button select option menu dialog object canvas audio video svg math label input textarea".split())
NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs footer contentinfo complementary comment comments commentlist disqus reply replies respond cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "pagination pager widget masthead toolbar search skip hidden".split())
HEADERS = frozenset({"header"})
MAIN = frozenset({"article", "main"})

DEEPEST = 64  # levels of a path; what lies deeper has the path of its ancestor at that level
LONGEST_LABEL = 80  # characters of one level; longer ones end in a hash
LONGEST_KEPT = 400  # characters of attributes whose facts are remembered
FAILED_QUOTES = 32  # tags with an unclosed quote, after which a page's quotes hold no more brackets

# A tag as nearly all are, without other brackets or single quotes, or else just the place where one may begin.
TAG_START = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/<>]*)([^<>"']*(?:"[^"<>]*"[^<>"']*)*)>|(?=/?[a-zA-Z]|[!?]))""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"""[>"']""")
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CLASS = re.compile(r"""(?:^|[\s"'])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INVISIBLE = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SAYS_OF_OTHERS = re.compile(r"(?:has|no|with|without|is)[-_]", re.I)  # a wrapper's name that speaks of another part
TEXT_ELEMENTS = frozenset("h1 h2 h3 h4 h5 h6 p".split())  # of which an id names a section
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Open:
    name: str
    path: str
    dropped: bool
    main: bool
    by_name: bool = False  # dropped for a name only, here or further out
    depth: int = 0


@dataclass(slots=True)
class Block:
    path: str
    text: str
    main: bool


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)  # of all text that is not in a dropped part
    paths: Counter = field(default_factory=Counter)


def _names(attributes: str, name: str, inside: bool) -> set[str]:
    """The words of class, id and role that tell what an element is. Inside an article an id tells it only as a whole."""
    found: set[str] = set()
    for m in NAMED.finditer(attributes):
        for one in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in NAME_WORDS.findall(one)}
            is_id = m[1].lower() == "id"
            if SAYS_OF_OTHERS.match(one) or is_id and (name in TEXT_ELEMENTS or inside and not words <= NOT_TEXT_NAMES):
                continue
            found |= words
    return found


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of each tag in order; the name is empty for comments and declarations.

    A bracket in quotes ends no tag; a tag with an unclosed quote ends at its first bracket; without a bracket behind it
    `<` is text. Time is linear: no part is searched again once it is known to hold no bracket, and quotes that are
    never closed are only tried FAILED_QUOTES times.
    """
    at, failed = 0, 0
    while (m := TAG_START.search(source, at)) is not None:
        begin = m.start()
        if m[2]:
            at = m.end()
            yield begin, at, m[2].lower(), bool(m[1]), m[3]
            continue
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = len(source) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        first = source.find(">", begin)
        if first < 0:
            return
        if source[begin + 1] in "!?":
            at = first + 1
            yield begin, at, "", False, ""
            continue
        closing = source[begin + 1] == "/"
        named = TAG_NAME.match(source, begin + 1 + closing)
        end = named.end()
        while failed < FAILED_QUOTES:
            q = QUOTE_OR_END.search(source, end)
            if q is None or (end := q.start() if q[0] == ">" else source.find(q[0], q.end())) < 0:
                failed, end = failed + 1, first
                break
            if q[0] == ">":
                break
            end += 1
        else:
            end = first
        at = end + 1
        yield begin, at, named[0].lower(), closing, source[named.end():end]


@lru_cache(4096)
def _facts(name: str, attributes: str, inside: bool) -> tuple[str, frozenset[str], bool]:
    """Label, names, and whether the element is hidden; the same few are met again and again."""
    if not attributes:
        return _label(name, None), frozenset(), False
    return _label(name, CLASS.search(attributes)), frozenset(_names(attributes, name, inside)), bool(INVISIBLE.search(attributes))


def _label(name: str, first: re.Match | None) -> str:
    label = name + (f".{(first[1] or first[2] or first[3] or '').strip().split(' ')[0]}" if first else "")
    return label if len(label) <= LONGEST_LABEL else f"{label[:LONGEST_LABEL - 17]}~{key(label) & (1 << 64) - 1:016x}"


def parse(source: str) -> Page:
    """Blocks and element paths of a page. Never fails: what is not markup is text, what is not closed ends with its parent."""
    page, stack, text, open_names = Page(), [Open("", "", False, False)], [], {}

    def flush() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            if words and not stack[-1].dropped:
                page.blocks.append(Block(stack[-1].path, " ".join(words), stack[-1].main))
            text.clear()

    def close(names: tuple[str, ...], scope: frozenset[str] = frozenset()) -> None:
        for n in names:
            if open_names.get(n):
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                if any(o.name in BLOCKS for o in stack[k:]):
                    flush()
                for o in stack[k:]:
                    open_names[o.name] -= 1
                del stack[k:]
                return
            if stack[k].name in scope:
                return

    at, seen_main = 0, False
    for begin, end, name, closing, attributes in tags(source):
        if begin < at:  # inside of what a raw element holds
            continue
        if begin > at:
            text.append(source[at:begin])
        at = end
        if not name:
            continue
        if closing:
            close((name,))
            continue
        if name in BLOCKS:
            flush()
            close(("p",), SCOPES)
        if name in CLOSES:
            close(CLOSES[name], SCOPES - {"td", "th"} if name == "tr" else SCOPES)
        if name == "br":
            text.append("\n")
        top = stack[-1]
        facts = _facts if len(attributes) < LONGEST_KEPT else _facts.__wrapped__
        label, names, hidden = facts(name, attributes, top.main)
        label = f"{top.path}/{label}" if top.depth < DEEPEST else top.path
        page.paths[label] += 1
        if name in RAW:
            at = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(source, at).end()
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        by_kind = name in NOT_TEXT or name in HEADERS and not top.main
        by_name = bool(names & NOT_TEXT_NAMES) or bool(names & HEADERS) and not top.main
        dropped = (top.dropped or by_kind or by_name) and name not in ("html", "body") or hidden
        named_only = not by_kind and not hidden and (top.by_name if top.dropped else by_name)
        if name in MAIN and not seen_main and not hidden:
            # A page's first article stands, whatever the names of the wrappers around it.
            dropped, seen_main = dropped and not (top.by_name and not by_name), seen_main or not top.dropped or top.by_name
        stack.append(Open(name, label, dropped, not dropped and (top.main or name in MAIN or "main" in names), dropped and named_only, top.depth + 1))
        open_names[name] = open_names.get(name, 0) + 1
    text.append(source[at:])
    flush()
    return page


def key(*parts: str) -> int:
    """64 bits of some strings, signed."""
    data = "\n".join(parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def main_text(page: Page, fixed: frozenset[int], main_path: str) -> str:
    """The article's blocks, joined: those of the page's own article, else of the host's main slot, else all slots."""
    blocks = [b for b in page.blocks if not fixed or key(b.path, b.text) not in fixed]
    chosen = [b for b in blocks if b.main]
    if not any(b.main for b in page.blocks):
        chosen = [b for b in blocks if main_path and (b.path + "/").startswith(main_path + "/")] or blocks
    return "\n\n".join(b.text for b in chosen)


def host_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, path, words, n) of every different page: its element paths, its text blocks, and itself.

    `page` is a hash of the page's source, so that copies of a page count once. `path` is null for text blocks; `words`
    are those that stand directly in the elements of that path.
    """
    def tokens(sources: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in ("at", "token", "path", "words", "n")}
        for k, source in enumerate(sources):
            page = parse(source)
            words = Counter()
            for b in page.blocks:
                words[b.path] += b.text.count(" ") + 1
            rows = [(0, "", 0, 1)] + [(key(p), p, words[p], n) for p, n in page.paths.items()]
            rows += [(t, None, 0, n) for t, n in Counter(key(b.path, b.text) for b in page.blocks).items()]
            out["at"] += [k] * len(rows)
            for name, values in zip(("token", "path", "words", "n"), zip(*rows)):
                out[name] += values
        return out

    return map_rows(pages, tokens, "token long, path string, words long, n int", ["html"], ["host", "page"]).distinct()


def templates(tokens: DataFrame) -> DataFrame:
    """(host, fixed, main_path): hashes of the fixed wording, and the path of the main slot (empty if there is none).

    The occurrence vector of a token is summed up as a hash over its (page, count) pairs, so that no vector is ever
    held; tokens with the same hash form a class. A class is valid if it has LEAST_TOKENS tokens and stands on SUPPORT
    of at least LEAST_PAGES different pages.
    """
    vectors = tokens.groupBy("host", "token").agg(
        F.first("path").alias("path"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("words").alias("words"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
    ).where("pages > 1 or token = 0")
    hosts = vectors.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    spread = vectors.join(hosts, "host").withColumn(
        "frequent", (F.col("pages") >= SUPPORT * F.col("host_pages")) & (F.col("host_pages") >= LEAST_PAGES))
    classes = spread.where("frequent").groupBy("host", "vector").agg(F.count("*").alias("tokens"))
    valid = F.col("frequent") & (F.coalesce("tokens", F.lit(0)) >= LEAST_TOKENS)
    members = spread.join(classes, ["host", "vector"], "left").withColumn("valid", valid).where("path is not null or valid")

    def deduce(rows: pd.DataFrame) -> pd.DataFrame:
        wording = rows["path"].isna()
        words = dict(zip(rows["path"][~wording], rows["words"][~wording].astype(int)))
        once = rows["path"][~wording & rows["valid"] & (rows["most"] == 1)]
        slots = nest(list(once), words)
        fixed = rows["token"][wording].tolist()
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "fixed": [fixed], "main_path": [max(slots, key=lambda p: (slots[p], p), default="")]})

    return members.groupBy("host").applyInPandas(deduce, "host string, fixed array<long>, main_path string")


def nest(containers: list[str], words: dict[str, int]) -> dict[str, float]:
    """Words that stand inside each container that every page has once; a deeper container counts a little less.

    Paths nest: what lies below a container's path is its slots. The document's own elements are left out, as
    everything is in them.
    """
    inner = [p for p in containers if p.count("/") > 2]
    return {p: sum(n for q, n in words.items() if q == p or q.startswith(p + "/")) / (1 + 0.1 * p.count("/")) for p in inner}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Null html counts as empty, and gives an empty text. A null url is a host of its own; hosts with few different pages
    have no template and are judged page by page. Repeated rows each have a row; an empty table gives none; further
    columns are ignored. The table of hosts has one row each, with as many fixed texts as fit on one page; it is joined
    by host, on which adaptive execution splits a host that has very many pages.
    """
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select("page_id", "url", source.alias("html"), host.alias("host"), F.xxhash64(source).alias("page"))
    known = stored(templates(host_tokens(named)), "page-templates")
    joined = named.join(known, "host", "left")
    held: dict[tuple, frozenset] = {}  # of the host seen last

    def texts(sources: list[str], fixed: list[list[int] | None], paths: list[str | None]) -> dict:
        made = []
        for one, words, path in zip(sources, fixed, paths):
            mark = tuple(words or ())
            if mark not in held:
                held.clear()
                held[mark] = frozenset(mark)
            made.append(main_text(parse(one), held[mark], path or ""))
        return {"text": made, "n_chars": list(map(len, made))}

    return map_rows(joined, texts, "text string, n_chars long", ["html", "fixed", "main_path"], ["page_id", "url"])
