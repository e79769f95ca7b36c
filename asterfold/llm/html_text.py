"""Main text of HTML pages by template deduction from equivalence classes.

Pages of one host come from templates. A role is a tag, or a whole text block, together with the elements it
stands in. Its occurrence vector says how often each page of the host has it; roles of equal vectors form an
equivalence class. So each layout of the host has a class of its own, whatever other pages there are: what every
page of the layout has once. A class is valid if enough pages have it, and if it holds a tag; it nests in the
class that the elements around it belong to, and is split where they belong to several. The nested classes are
the host's template; text blocks in the class of an element around them are what the template itself says.

What is left are slots: the template's elements, with the text in them that varies. The main slot of a page is
the deepest of the page's slots that holds most of it, and a heading, or an article by name. Its text, without what the
template says, is the page's main text. Pages whose host has no template are read by element names alone.

Vectors are never built: a role's hash sum over (page, count) stands for its vector, so that a host of any
number of pages is aggregated with partial sums. Only roles on a tenth of the host's pages come together in a
task, and those are at most ten times as many as a page has.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.llm.shared import made, remove, write_table

# HTML's elements by what they mean here.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("head nav header footer aside menu button dialog fieldset title".split())
MAIN = ("article", "main")
HOLDS = ("h1", "article", "main")
HEADINGS = ("h1", "h2", "h3")
#: What an opening tag ends if it is open.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
#: Whole class names and ids that say what an element of these kinds is.
NAMED_KINDS = frozenset("div section ul ol table".split())
NAMES = frozenset("ad ads adsense advert advertisement alert banner breadcrumb breadcrumbs comment comments comment-form comment-list consent cookie cookie-banner cookie-consent cookie-notice cookies disqus_thread footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo recommended related related-posts replies respond share sharing sidebar signup site-footer site-header site-nav social sponsor sponsored subscribe toolbar topbar trending widget widgets".split())

TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({"|".join(RAW)})\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|</?[a-zA-Z][^<>]*\Z""", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: Pages, and share of the host's pages, that a class needs to be valid.
LEAST_PAGES, SUPPORT = 3, 0.1
#: Share of the varying text of a page that a slot must hold to be the main slot, if no element is an article by
#: name, and share of what the largest article holds that other articles must.
MOST, ARTICLE = 0.7, 0.5
#: Template entries (16 bytes each) that are sent to all tasks; more are joined by host.
SENT = 2_000_000

Path = tuple[str, ...]


def host(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


class Walk:
    """The tags of a page as (path with the tag itself, aside), and its text blocks as (path, aside, text), in
    page order.

    A path names the open block elements, with their classes; inline elements don't count, a line break is white
    space. Missing end tags are implied, stray ones ignored. What stands in a navigation, a form or the like is
    aside. An element that is so by its class name alone, or a form, isn't aside if it holds half of the page's
    text and an article or main heading (a form: half of the text).
    """

    def __init__(self, page: str):
        self.elements: list[tuple[Path, int, str]] = [((), -1, "")]  # path, parent, why aside
        self.holds, self.chars = [False], [0]
        found: list[tuple[int, str]] = []
        names: list[str] = []
        stack = [0]
        held: list[str] = []

        def flush() -> None:
            if held:
                if text := " ".join(entities.unescape("".join(held)).split()):
                    found.append((stack[-1], text))
                held.clear()

        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                held.append(page[at : m.start()])
            at = m.end()
            name = (m[3] or "").lower()
            if name == "br":
                held.append(" ")
            if name not in BLOCK and name != "button":
                continue
            flush()
            if m[2]:
                if name in names:
                    while names.pop() != name:
                        stack.pop()
                    stack.pop()
                continue
            while names and (names[-1] in ENDS.get(name, ("p",)) or names[-1] == "head" and name == "body"):
                names.pop()
                stack.pop()
            here = self._open(name, m[4], stack[-1], any(n in MAIN for n in names))
            if name not in VOID:
                names.append(name)
                stack.append(here)
        if at < len(page):
            held.append(page[at:])
        flush()
        aside = self._aside(found)
        self.tags = [(path, aside[i]) for i, (path, _, _) in enumerate(self.elements)][1:]
        self.blocks = [(self.elements[i][0], aside[i], text) for i, text in found]

    def _open(self, name: str, attributes: str, parent: int, in_article: bool) -> int:
        marks = [v.strip("\"'") for _, v in NAMED.findall(attributes)] if attributes else []
        key = f"{name}.{re.sub('[0-9]+', '#', ' '.join(marks))}" if marks else name
        why = ""
        if name in LEFT_OUT and not (name == "header" and in_article):
            why = "element"
        elif name == "form":
            why = "form"
        elif name in NAMED_KINDS and not NAMES.isdisjoint(" ".join(marks).lower().split()):
            why = "name"
        self.elements.append(((*self.elements[parent][0], key), parent, why))
        self.holds.append(name in HOLDS)
        self.chars.append(0)
        return len(self.elements) - 1

    def _aside(self, found: list[tuple[int, str]]) -> list[bool]:
        left_out = [False] * len(self.elements)
        for i, (_, parent, why) in enumerate(self.elements):
            left_out[i] = why == "element" or i > 0 and left_out[parent]
        for i, text in found:
            if not left_out[i]:
                self.chars[i] += len(text)
        for i in range(len(self.elements) - 1, 0, -1):
            parent = self.elements[i][1]
            self.chars[parent] += self.chars[i]
            self.holds[parent] |= self.holds[i]
        for i, (_, parent, why) in enumerate(self.elements):
            if i:
                cleared = 2 * self.chars[i] >= self.chars[0] and (why == "form" or self.holds[i])
                left_out[i] = left_out[parent] or why == "element" or bool(why) and not cleared
        return left_out


def role(path: Path, text: str = "") -> int:
    return xxhash.xxh64_intdigest("\x00".join(path) + "\x01" + text) >> 1


class Role(NamedTuple):
    """What is known of a role over all pages of a host. parent: the role of the element around it; chars: its
    text that isn't aside; free: pages on which it isn't aside; heads: of these, pages on which it holds a heading;
    named: an article by name; depth: 0 for text."""

    role: int
    parent: int
    a: int
    b: int
    pages: int
    times: int
    chars: int
    free: int
    heads: int
    named: int
    depth: int


SUMS, SAME = ("a", "b", "pages", "times", "chars", "free", "heads"), ("named", "depth")


def roles_of(page: str, number: int) -> list[Role]:
    """The roles of one page; number: of the page, for the vectors. Role -1 is the page itself."""
    walk = Walk(page)
    known: dict[Path, int] = {(): -1}
    own: dict[int, list[int]] = {-1: [0, 1, 0, 1, 0, 0, 0]}  # parent, times, chars, free, heads, named, depth
    for path, aside in walk.tags:
        if path not in known:
            known[path] = role(path)
            own[known[path]] = [known.get(path[:-1], -1), 0, 0, int(not aside), 0, int(path[-1].split(".")[0] in MAIN), len(path)]
        own[known[path]][1] += 1
        if not aside and path[-1].split(".")[0] in HEADINGS:
            for k in range(1, len(path) + 1):
                own[known[path[:k]]][4] = 1
    for path, aside, text in walk.blocks:
        own.setdefault(role(path, text), [known[path], 0, 0 if aside else len(text), 0, 0, 0, 0])[1] += 1
        if not aside:
            for k in range(1, len(path) + 1):
                own[known[path[:k]]][2] += len(text)
    out = []
    for r, (parent, times, chars, free, heads, named, depth) in own.items():
        h = xxhash.xxh64_intdigest(b"%d:%d" % (number, times))
        out.append(Role(r, parent, h >> 32, h & 0xFFFFFFFF, 1, times, chars, free, heads, named, depth))
    return out


def _roles(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host and Role of every role. Pages without text or tags don't count."""
    names = ["host", *Role._fields]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                seen: dict[tuple, list[int]] = {}
                for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    row += 1
                    if not page:
                        continue
                    site = host(url)
                    for r in roles_of(page, row):
                        total = seen.setdefault((site, r.role, r.parent, r.named, r.depth), [0] * len(SUMS))
                        for i, x in enumerate(r[2 : 2 + len(SUMS)]):
                            total[i] += x
                keys = [dict(zip(("host", "role", "parent", "named", "depth"), k, strict=True)) | dict(zip(SUMS, v, strict=True)) for k, v in seen.items()]
                yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in keys], pa.string() if n == "host" else pa.int64()) for n in names], names)

    found = df.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "host string, " + ", ".join(f"{n} long" for n in Role._fields))
    return found.groupBy("host", "role", "parent", *SAME).agg(*(F.sum(c).alias(c) for c in SUMS)).select(*names)


class Slot(NamedTuple):
    role: int
    chars: float
    heads: int
    named: int
    depth: int


def classes(roles: Iterable[Role]) -> list[list[Role]]:
    """The valid classes: roles of equal vectors, each once on its pages, with a tag among them, that stand in
    elements of one class. A class whose outermost roles stand in several is split by them."""
    by_vector: dict[tuple, list[Role]] = defaultdict(list)
    for r in roles:
        if r.times == r.pages:
            by_vector[r.a, r.b, r.pages].append(r)
    of = {r.role: key for key, members in by_vector.items() for r in members}
    parent = {r.role: r.parent for members in by_vector.values() for r in members}
    out = []
    for key, members in by_vector.items():
        parts: dict[tuple | None, list[Role]] = defaultdict(list)
        for r in members:
            up = r.parent
            while of.get(up) == key:
                up = parent[up]
            parts[of.get(up)].append(r)
        out += [part for part in parts.values() if any(r.depth for r in part)]
    return out


def deduce(roles: list[Role]) -> tuple[list[Slot], list[int]]:
    """(slots, roles of the template's own text) of a host."""
    parent = {r.role: r.parent for r in roles}
    slots: list[Role] = []
    said: list[Role] = []
    fixed: dict[int, int] = defaultdict(int)
    for members in classes(roles):
        tags = {r.role for r in members if r.depth}
        slots += [r for r in members if r.depth and 2 * r.free > r.pages]
        for r in members:
            around, up = [], r.parent
            while up in parent and up not in around:
                around.append(up)
                up = parent[up]
            if not r.depth and not tags.isdisjoint(around):
                said.append(r)
                for up in around:
                    fixed[up] += r.chars
    return [Slot(r.role, max(0, r.chars - fixed[r.role]) / r.pages, int(2 * r.heads > r.pages), r.named, r.depth) for r in slots], [r.role for r in said]


def templates(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, slots, said (see deduce)."""
    roles, _ = write_table(_roles(df, url_col, html_col), "roles")
    pages = roles.where("role = -1").select("host", F.col("pages").alias("n"))
    # Pages are as many as hosts at most, and may be many: joined at every size by shuffle.
    valid = roles.where(f"role <> -1 and pages >= {LEAST_PAGES}").join(pages.hint("shuffle_merge"), "host").where(F.col("pages") >= SUPPORT * F.col("n")).drop("n")

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(n).to_pylist() for n in Role._fields]
        slots, said = deduce(sorted(Role(*r) for r in zip(*columns, strict=True)))
        shape = pa.list_(pa.struct([("role", pa.int64()), ("chars", pa.float64()), ("heads", pa.int64()), ("named", pa.int64()), ("depth", pa.int64())]))
        return pa.table({"host": [table.column("host")[0].as_py()], "slots": pa.array([[s._asdict() for s in slots]], shape), "said": pa.array([said], pa.list_(pa.int64()))})

    return valid.groupBy("host").applyInArrow(run, "host string, slots array<struct<role: long, chars: double, heads: long, named: long, depth: long>>, said array<long>")


def main_slot(tags: Iterable[Path], slots: dict[int, Slot]) -> Path | None:
    """The path of the page's main slot."""
    here = [(slots[r], path) for path in dict.fromkeys(tags) if (r := role(path)) in slots]
    named = [x for x in here if x[0].named]
    most = max((s.chars for s, _ in named or here), default=0.0)
    fit = [x for x in named or here if most and x[0].chars >= (ARTICLE if named else MOST) * most]
    if not named:  # an article has its heading in it, if one of them has
        fit = [x for x in fit if x[0].heads] or fit
    return max(fit, key=lambda x: (x[0].depth, x[0].chars))[1] if fit else None


def content(page: str | None, slots: Iterable[Slot] = (), said: frozenset[int] = frozenset()) -> str:
    """The main text of a page: blocks joined by blank lines."""
    walk = Walk(page or "")
    blocks = [b for b in walk.blocks if not b[1]]
    by_role = {s.role: s for s in slots}
    main = main_slot((p for p, aside in walk.tags if not aside), by_role) if by_role else None
    inside = [b for b in blocks if b[0][: len(main)] == main] if main else []
    if not inside:
        inside = [b for b in blocks if any(k.split(".")[0] in MAIN for k in b[0])] or blocks
    out = [text for path, _, text in inside if role(path, text) not in said] if said else [b[2] for b in inside]
    # Where all is the template's own, as on a host of copies, it is the text.
    return "\n\n".join(out or [b[2] for b in inside])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url, text, n_chars for every page.

    Pass one aggregates roles by host; pass two reads the pages again with their host's template. A null or
    empty html gives an empty text and doesn't count for its host's template; null urls are a host of their own;
    pages of hosts too small for a template, or that don't follow it, are read by element names alone. A page of
    any length is read whole, in one pass. Repeated rows stay, and count as pages; an empty table gives no rows;
    other columns are ignored, whatever their names. Of slots that hold equally much the deepest is the main one.
    """
    before = len(made)
    found, path = write_table(templates(df, url_col, html_col), "templates")
    remove(df.sparkSession, *(p for p in made[before:] if p != path))
    size = found.agg(F.coalesce(F.sum(F.lit(1) + 2 * F.size("slots") + F.size("said")), F.lit(0))).head()[0]
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    pages = pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", HOST.pattern, 1)), F.lit("")))
    joined = pages.join(F.broadcast(found) if size <= SENT else found.hint("shuffle_merge"), "host", "left")
    id_type, url_type = (df.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                known: dict[str, tuple] = {}
                texts = []
                for i, (page, site) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if site not in known:
                        slots, said = part.column(4)[i].as_py(), part.column(5)[i].as_py()
                        known[site] = [Slot(**s) for s in slots or ()], frozenset(said or ())
                    texts.append(content(page, *known[site]))
                sizes = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(sizes)], ["id", "url", "text", "n_chars"])

    out = joined.select("id", "url", "html", "host", "slots", "said").mapInArrow(run, f"id {id_type}, url {url_type}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
