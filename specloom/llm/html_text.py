"""Operator 6, HTML extraction by inferred union-free wrappers.

Each page becomes a stream of structural tokens: block tags with their id or class, and text slots. Names that only few pages of a
host have (ids by page) count as the bare tag. Repeated groups in a stream are folded, ``( p # )+``. The distinct streams of a host,
few however many pages it has, are aligned one after the other; what only one side has becomes an optional group, ``( aside # /aside
)?``, so the host's wrapper is a union-free regular expression of all its pages. Each page's stream is then matched against its host's
wrapper, which gives every text block a slot, and slots are judged over all the host's pages: one whose text is the same on all
pages that have it, half of the host's different pages and FIXED_PAGES at least, is a fixed block. The main container is chosen for
each page, as pages of a host differ in layout: an article, else a main element, else of the page's containers the one whose blocks
hold most text outside links over all the host's pages. Of it, blocks under menus, footers, side bars, notices, adverts, forms and
comments and blocks in fixed slots are left out; fixed ones stay where nothing else is left. Pages without a host are judged alone.

Defined results: null and empty html and pages without main text give an empty text; character references are decoded; white space
becomes one space; the host of a null or odd url is ''; repeated rows have equal results.
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_PERIOD = 12  # tokens of a group that is folded
WRAPPER_BYTES = 8 << 20  # wrappers are broadcast up to this size, measured; beyond it they are joined by shuffling
FIXED_PAGES = 3  # different pages on which a slot of equal text is a fixed block
RARE = 0.05  # share of a host's pages below which a name counts as made for the page
SALTS = 16  # parts in which a host's streams are aligned first

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object|textarea|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
LABEL = re.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Fixed values of HTML: elements that flow inside a line, and elements without content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end a sibling of the same kind, or a block after a paragraph, implies.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold no main text.
ASIDE = frozenset("head nav footer aside form menu dialog fieldset figure-footer template".split())
#: Words in an id, class or role that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|nav\w*|menus?|breadcrumbs?|sidebars?|side|aside|widgets?|related|recommend\w*|"
    r"shar(?:e|ing)|social|follow|newsletter|subscribe|signup|login|comments?|disqus|respond|responses|replies|reply|discussion|footer|copyright|header|masthead|toolbar|pagination|pager|tags|complementary|navigation|contentinfo|search)(?:[-_\s]|$)",
    re.I,
)
CONTENT = re.compile(r"(?:^|[-_\s])(?:article|post|entry|story|content|main|body)(?:[-_\s]|$)", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def label(tag: str, attributes: str) -> str:
    """The tag with its id, class and role: div#x.y z@w."""
    if not attributes or "=" not in attributes:
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in LABEL.finditer(attributes)}
    name = tag
    for key, sign in (("id", "#"), ("class", "."), ("role", "@")):
        if value := " ".join(found.get(key, "").split()):
            name += sign + re.sub(r"[\s>|]+", "_", re.sub(r"\d+", "0", value))
    return name


def parse(page: str) -> tuple[list[str], list[tuple[str, str, int]]]:
    """(structural tokens, text blocks as (path, raw text, characters in links)) of a page."""
    tokens: list[str] = []
    blocks: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = [("", "")]  # (tag, path)
    text: list[str] = []
    linked, in_link, last = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            text.clear()
            if not raw.isspace():
                blocks.append((stack[-1][1], raw, linked))
                tokens.append("#")
            linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > last:
            piece = page[last : m.start()]
            text.append(piece)
            linked += len(piece) * in_link
        last = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr" or tag == "img":
            text.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m[2]
            if m[2] or "=" not in m[4] or not MARKS.search(label("", m[4]).replace(".", " ").replace("#", " ").replace("@", " ")):
                if not (m[2] and any(t == tag for t, _ in stack)):
                    continue
        flush()
        in_link = in_link and tag == "a"
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    if tag != "p" and tag not in IMPLIED:
                        tokens.append("/" + tag)
                    break
            continue
        if stack[-1][0] == "p" and tag not in INLINE:
            stack.pop()
        elif tag in IMPLIED and stack[-1][0] in IMPLIED[tag]:
            stack.pop()
        name = label(tag, m[4])
        stack.append((tag, f"{stack[-1][1]}>{name}"))
        tokens.append(name)
    if last < len(page):
        text.append(page[last:].split("<", 1)[0] if "<" in page[last:] else page[last:])
    flush()
    return tokens, blocks


def folded(tokens: list[str], marks: list[list[int]]) -> tuple[list[str], list[list[int]]]:
    """The stream with neighbouring repetitions of a group as one group, ( ... )+, short groups first, and the marks of its tokens."""
    for period in range(1, min(MAX_PERIOD, len(tokens) // 2) + 1):
        out: list[str] = []
        made: list[list[int]] = []
        i, n = 0, len(tokens)
        while i < n:
            group = tokens[i : i + period]
            if len(group) == period and tokens[i + period : i + 2 * period] == group and balanced(group):
                j = i + period
                while tokens[j : j + period] == group:
                    j += period
                joined = [[x for at in range(i + k, j, period) for x in marks[at]] for k in range(period)]
                whole = not (period == 1 and group[0].startswith("("))
                out += ["(", *group, ")+"] if whole else group
                made += [[], *joined, []] if whole else joined
                i = j
            else:
                out.append(tokens[i])
                made.append(marks[i])
                i += 1
        tokens, marks = out, made
    return tokens, marks


def fold(tokens: list[str]) -> list[str]:
    return folded(tokens, [[] for _ in tokens])[0]


def balanced(group: list[str]) -> bool:
    depth = 0
    for x in group:
        depth += (x == "(") - (x in (")+", ")?"))
        if depth < 0:
            return False
    return depth == 0


def units(tokens: list[str]) -> list[tuple[str, ...]]:
    """Tokens, and groups as wholes."""
    out: list[tuple[str, ...]] = []
    depth, start = 0, 0
    for i, x in enumerate(tokens):
        if x == "(":
            if not depth:
                start = i
            depth += 1
        elif x in (")+", ")?"):
            depth -= 1
            if not depth:
                out.append(tuple(tokens[start : i + 1]))
        elif not depth:
            out.append((x,))
    return out


def align(a: list[str], b: list[str]) -> list[str]:
    """A union-free expression of both: equal parts stay, a group that repeats on one side repeats, the rest is optional."""
    if a == b:
        return a
    ua, ub = units(a), units(b)

    def bare(u: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(x for x in u[1:-1]) if u[0] == "(" else u

    ka, kb = [bare(u) for u in ua], [bare(u) for u in ub]
    out: list[str] = []

    def optional(part: list[tuple[str, ...]]) -> None:
        rest: list[str] = []
        for u in part:
            if u[-1] == ")?":
                if rest:
                    out.extend(["(", *rest, ")?"])
                    rest = []
                out.extend(u)
            else:
                rest.extend(u)
        if rest:
            out.extend(["(", *rest, ")?"])

    for kind, i, j, k, m in difflib.SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(ua[i:j], ub[k:m], strict=True):
                if x == y:
                    out.extend(x)
                elif ")?" in (x[-1], y[-1]):
                    out.extend(["(", *bare(x), ")?"])
                else:
                    out.extend(["(", *bare(x), ")+"])
        else:
            optional(ua[i:j])
            optional(ub[k:m])
    return out


def elements(path: str) -> list[str]:
    return [x for x in path.split(">") if x]


def tag_of(element: str) -> str:
    return re.split(r"[#.@]", element, maxsplit=1)[0]


def marked(element: str) -> bool:
    rest = element[len(tag_of(element)) :]
    return bool(rest) and bool(MARKS.search(re.sub(r"[#.@_]+", " ", rest)))


def excluded(path: list[str], inside: int) -> bool:
    """Whether an element of the path after the container says that this isn't main text; the container's ancestors count too."""
    for k, x in enumerate(path):
        t = tag_of(x)
        if t in ASIDE or (t == "header" and k < inside) or (marked(x) and t not in ("html", "body")):
            return True
    return False


def general(token: str, names: set[str] | None) -> str:
    """The token, without its id, class and role if these are not among the host's names."""
    return token if names is None or token in names else tag_of(token)


def located(tokens: list[str], names: set[str] | None) -> tuple[list[str], list[list[int]]]:
    """(the folded stream of general tokens, for each of its tokens the text blocks there)."""
    count = iter(range(len(tokens)))
    found, marks = folded(tokens, [[next(count)] if x == "#" else [] for x in tokens])
    return folded([general(x, names) for x in found], marks)


def slots(wrapper: list[str], stream: list[str]) -> list[int]:
    """For each token of a stream the place in the wrapper that it matches, or -1."""
    signs = ("(", ")+", ")?")
    at = [i for i, x in enumerate(wrapper) if x not in signs]
    of = [i for i, x in enumerate(stream) if x not in signs]
    out = [-1] * len(stream)
    for i, j, n in difflib.SequenceMatcher(None, [wrapper[k] for k in at], [stream[k] for k in of], autojunk=False).get_matching_blocks():
        for k in range(n):
            out[of[j + k]] = at[i + k]
    return out


class Matcher:
    """Text blocks of pages and their slots in their hosts' wrappers; what equal streams give is known from the first."""

    MOST = 4096  # streams that are remembered

    def __init__(self) -> None:
        self.known: dict[tuple, list[int]] = {}

    def __call__(self, page: str, wrapper: str | None, names: set[str] | None) -> tuple[list[tuple[str, str, int]], list[str]]:
        """(blocks, for each its slot: the place in the wrapper and the general path, as other layouts may match there too, or '')."""
        tokens, found = parse(page)
        out = [""] * len(found)
        if wrapper:
            stream, marks = located(tokens, names)
            key = (wrapper, tuple(stream))
            if key not in self.known:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[key] = slots(wrapper.split(" "), stream)
            for slot, blocks in zip(self.known[key], marks, strict=True):
                for k in blocks if slot >= 0 else ():
                    out[k] = f"{slot}>" + ">".join([general(x, names) for x in elements(found[k][0])])
        return found, out


def masses(blocks: list[tuple[str, str, int]], names: set[str] | None) -> tuple[dict[int, list[str]], dict[str, float]]:
    """(general path by number of each block that may be main text, text outside links by container)."""
    size: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for path, raw, links in blocks:
        size[path][0] += len(raw)
        size[path][1] += links
    free: dict[str, list[str]] = {}
    mass: dict[str, float] = defaultdict(float)
    for path, (chars, links) in size.items():
        x = elements(path)
        if chars > 2 * links and not excluded(x, len(x)):
            free[path] = g = [general(e, names) for e in x]
            container = g if not g or tag_of(g[-1]) not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td") else g[:-1]
            weight = 1.5 if x and CONTENT.search(re.sub(r"[#.@_]+", " ", x[len(container) - 1] if container else "")) else 1.0
            mass[">".join(container)] += (chars - 2 * links) * weight
    return {k: free[path] for k, (path, _, _) in enumerate(blocks) if path in free}, mass


def main_blocks(blocks: list[tuple[str, str, int]], names: set[str] | None, containers: dict[str, float]) -> list[int]:
    """The numbers of a page's blocks in its main container; containers: text by container over the host's pages."""
    paths = [elements(p) for p, _, _ in blocks]
    for wanted in ("article", "main", "role"):
        found = []
        for k, x in enumerate(paths):
            at = next((i for i, e in enumerate(x) if tag_of(e) == wanted or (wanted == "role" and e.endswith("@main"))), None)
            if at is not None and not excluded(x, at):
                found.append(k)
        if found:
            return found
    free, mass = masses(blocks, names)
    if not mass:
        return []
    least = max(mass.values()) / 5  # a container of little text here isn't this page's, however much it has on others
    best = max((x for x in sorted(mass) if mass[x] >= least), key=lambda x: (containers.get(x, 0.0), mass[x]))
    return [k for k, x in free.items() if (">".join(x) + ">").startswith(best + ">" if best else "")]


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def host(pages: DataFrame):
    return F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))


def rows_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def streams(pages: DataFrame) -> DataFrame:
    """(host, key, pages): folded token streams of pages (host, html), counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    found[name, " ".join(fold(parse(page)[0]))] += 1
            if found:
                yield rows_of([(*k, v) for k, v in found.items()], ["host", "key", "pages"], [pa.string(), pa.string(), pa.int64()])

    return pages.mapInArrow(run, "host string, key string, pages long").groupBy("host", "key").agg(F.sum("pages").alias("pages"))


def aligned(keys: list[str]) -> str:
    """The wrapper of folded streams or wrappers, aligned from the longest on."""
    ordered = sorted(set(keys), key=lambda x: (-x.count(" "), x))
    return " ".join(functools.reduce(align, [x.split(" ") for x in ordered]))


def expressions(pages: DataFrame) -> DataFrame:
    """(host, wrapper: the expression, names: what its pages call their elements)."""
    found = common.written(streams(pages.select(host(pages).alias("host"), "html").filter("host <> ''")), "streams")
    total = found.groupBy("host").agg(F.sum("pages").alias("total"))
    seen = found.select("host", F.explode(F.array_distinct(F.split("key", " "))).alias("name"), "pages").groupBy("host", "name").agg(F.sum("pages").alias("pages"))
    often = (F.col("total") == 1) | ((F.col("pages") >= 2) & (F.col("pages") >= F.col("total") * RARE))
    names = common.written(seen.join(total, "host").filter(often).groupBy("host").agg(F.collect_set("name").alias("names")), "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for name, key, known in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("names").to_pylist(), strict=True):
                known = {*known, "(", ")+", "#"} if known else {"(", ")+", "#"}
                out.add((name, " ".join(fold([general(x, known) for x in key.split(" ")]))))
            if out:
                yield rows_of(sorted(out), ["host", "key"], [pa.string(), pa.string()])

    def merge(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "key": [aligned(group["key"].tolist())]})

    parts = found.join(names, "host", "left").select("host", "key", "names").mapInArrow(run, "host string, key string").distinct()
    parts = parts.groupBy("host", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")).applyInPandas(merge, "host string, key string")
    whole = parts.groupBy("host").applyInPandas(merge, "host string, key string").toDF("host", "wrapper")
    return whole.join(names, "host", "left")


def with_hosts(pages: DataFrame, made: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with their hosts' columns of made; broadcast if these are small, as measured."""
    rest = [c for c in made.columns if c != "host"]
    size = made.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    made = made.withColumnRenamed("host", "__of")
    made = F.broadcast(made) if size <= WRAPPER_BYTES else made
    return pages.withColumn("__host", host(pages)).join(made, F.col("__host") == F.col("__of"), "left").select(*pages.columns, F.col("__host").alias("host"), *rest)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, names, fixed: slots that hold a fixed block, containers: text by container)."""
    made = common.written(expressions(pages), "expressions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher()
        for batch in batches:
            out: set[tuple[str, str, int, int]] = set()
            mass: dict[tuple[str, str], float] = defaultdict(float)
            for name, page, same, wrapper, names in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "same", "wrapper", "names")], strict=True):
                if page and name:
                    known = set(names or ())
                    blocks, places = match(page, wrapper, known)
                    texts: dict[str, list[str]] = defaultdict(list)
                    for (_, raw, _), slot in zip(blocks, places, strict=True):
                        if slot:
                            texts[slot].append(clean(raw))
                    out.add((name, "", 0, same))
                    out.update((name, slot, int.from_bytes(hashlib.blake2b("\n".join(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), same) for slot, x in texts.items())
                    for container, chars in masses(blocks, known)[1].items():
                        mass[name, container] += chars
            rows = [(name, slot, content, same, None, 0.0) for name, slot, content, same in sorted(out)] + [(name, None, 0, 0, c, m) for (name, c), m in mass.items()]
            if rows:
                yield rows_of(rows, ["host", "slot", "content", "same", "container", "mass"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()])

    joined = with_hosts(pages.select("url", "html"), made).withColumn("same", F.xxhash64("html"))
    found = common.written(joined.select("host", "html", "same", "wrapper", "names").mapInArrow(run, "host string, slot string, content long, same long, container string, mass double"), "slots")
    by_slot = found.filter("slot is not null").groupBy("host", "slot", "same").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    by_slot = by_slot.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    total = by_slot.filter("slot = ''").select("host", F.col("n").alias("total"))
    fixed = by_slot.filter(f"slot <> '' and n >= {FIXED_PAGES} and least = most").join(total, "host").filter("n * 2 >= total").groupBy("host").agg(F.collect_list("slot").alias("fixed"))
    weight = found.filter("slot is null").groupBy("host", "container").agg(F.sum("mass").alias("mass")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("container", "mass"))).alias("containers"))
    return made.join(fixed, "host", "left").join(weight, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) without html, with text and n_chars."""
    joined = with_hosts(pages.select("page_id", "url", "html"), common.written(wrappers(pages), "wrappers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher()
        for batch in batches:
            out = []
            for page, wrapper, names, fixed, containers in zip(*[batch.column(c).to_pylist() for c in ("html", "wrapper", "names", "fixed", "containers")], strict=True):
                if not page:
                    out.append("")
                    continue
                known = None if wrapper is None else set(names or ())
                blocks, places = match(page, wrapper, known)
                chosen = main_blocks(blocks, known, dict(containers or ()))
                gone = set(fixed or ())
                chosen = [k for k in chosen if places[k] not in gone] or chosen
                out.append(clean(" ".join([blocks[k][1] for k in chosen])))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    return extract(common.only(common.table(spark, sf_dir, "pages"), "page_id", "url", "html"))
