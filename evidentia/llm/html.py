"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its tags, told apart by their path from the root, and its text
blocks. A token's occurrence vector says how often each page of the host has it. Tokens with the same
vector form an equivalence class; one that is frequent (in half of the host's pages, three at least)
and large (two tokens), and whose tokens keep one order on every page, is ordered. Ordered classes nest:
each time, a class stands whole in one gap between two tokens of the class around it, and always in the
same gap of the same class. Those that do are valid and belong to the host's template; others are not
split, but left out of it. A valid class is in order on every page that has it, so what stands between
its tokens, all blocks of no valid class, are the slots.

Vectors aren't gathered: a token's signature is the sum of a hash of (page, count) over its pages, a
partial aggregate by (host, token), so a host with a third of all pages is spread over all tasks. The
template of a host has at most twice as many tokens as its mean page. Order and nesting are judged page
by page against the host's classes; verdicts are combined by partial aggregates by (host, class).

Slots of navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are told by element, role and class names of their enclosing tags and left out, at whatever
depth they stand, unless a main element begins within. Around articles, one word of a name is enough.
Of an article or main element, and within it, what the whole name calls the element must be one of those things ("post-comments",
"ad-300x250", "related-posts"); a name that only has such a word ("related-work", "ad-free") makes its blocks
doubtful, and these go if the template fixes them. If the page has an article or main element, the slots inside it are the main text;
otherwise all remaining slots are. Text that the template fixes is left out of both. Copies of one
article may fill a host, so a page keeps the blocks in its article or main element, doubtful ones aside, whole if the
template fixes half of their characters or more.

Pages meet their host's classes and template in a join on the host. Those of the hosts with more than a thousandth
of all pages each, so of a thousand hosts at most, are sent to every task if they take ``SENT`` bytes or less; the pages
of these hosts then stay where they are, and every other host is a small part of its join.

Null html counts as empty: empty text. A null url is a host of its own name "". Repeated rows give
equal results; other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, pieces

# Element names.
RAW = set("script style noscript template textarea title iframe svg xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = set("aside button dialog footer form head input label menu nav object select".split())
ENDS_P = BLOCK - {"br"}
# Words of class, id and role names that mark what isn't the article.
UNWANTED = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget widgets related recommended cookie cookies consent gdpr notice notices alert alerts popup "
    "modal newsletter subscribe subscription signup login search comment comments commentlist disqus respond replies reply footer masthead "
    "toolbar pagination pager share sharing social hidden skip contentinfo complementary form topbar".split()
)
# Such a word, but not as an element's whole name.
NOT_ALONE = set("promoted".split())
# Words after the one that names an element, for its form, place, size or parts.
TRAILING = set(
    "wrapper wrap container box area section region zone holder module block inner outer group list row column col panel pane card unit slot item items "
    "form bar link links button buttons icon icons content body text title heading header label meta author post posts article articles story stories "
    "topics news videos products reading left right top bottom center middle main primary secondary large medium small inline mobile desktop x".split()
)
# With these beside it, such a word tells of a page's layout ("has-sidebar").
LAYOUT = set("with has no without layout".split())
NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
RAW_END = {name: re.compile(rf"(?i)</{name}\s*+>") for name in RAW}
ATTRIBUTE = re.compile(r"""(?i)(?<![a-z-])([a-z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+["']?true""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")
TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")


KEPT, DOUBTFUL, OUT = range(3)


def named(parts: list[str]) -> bool:
    """Whether the words of a name call the element something unwanted: the last that isn't of its form, place, size or parts."""
    last = len(parts)
    while last > 1 and (parts[last - 1] in TRAILING or parts[last - 1].isdigit()):
        last -= 1
    return parts[last - 1] in UNWANTED or (parts[last - 1] in NOT_ALONE and len(parts) > 1)


def standing(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element with these attributes holds something other than the article, surely (OUT) or perhaps (DOUBTFUL)."""
    if tag in LEFT_OUT or (tag == "header" and not in_main):
        return OUT
    if not attributes or tag in ("html", "body", "main"):
        return KEPT
    if tag != "article" and HIDDEN.search(attributes):
        return OUT
    found = KEPT
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for one in (a or b or c).split():
                parts = [p.lower() for p in NAME_PART.findall(one)]
                if parts == ["header"] and not in_main:
                    return OUT
                if LAYOUT.isdisjoint(parts) and not (UNWANTED.isdisjoint(parts) and NOT_ALONE.isdisjoint(parts)):
                    if named(parts) or not (in_main or tag == "article"):
                        return OUT
                    found = DOUBTFUL
    return found


def unescaped(text: str) -> str:
    """Character references decoded; numbers of any length are borne."""
    if "&" not in text:
        return text
    return html.unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub(r"\1", text)))


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag, name "" for comments, declarations and raw elements.

    Linear: what no later character can close is told from the last ">", and once a tag's quotes don't
    close, the tags after it end at their first ">".
    """
    last, quotes_close, at = source.rfind(">"), True, source.find("<")
    while at >= 0:
        end = -1
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            yield at, (end := len(source) if close < 0 else close + 3), "", "", ""
        elif at < last:
            m = NAME.match(source, at + 1)
            if m is None:
                if source[at + 1 : at + 2] in ("!", "?"):
                    yield at, (end := source.index(">", at) + 1), "", "", ""
            else:
                stop = QUOTED.match(source, m.end()).end() if quotes_close else source.find(">", m.end())
                if stop >= len(source) or source[stop] != ">":
                    quotes_close, stop = False, source.find(">", m.end())
                name = m[2].lower()
                if stop >= 0 and not m[1] and name in RAW and not (name == "svg" and source[stop - 1] == "/"):
                    close = RAW_END[name].search(source, stop + 1)
                    yield at, (end := close.end() if close else len(source)), "", "", ""
                elif stop >= 0:
                    yield at, (end := stop + 1), m[1], name, source[m.end() : stop]
        at = source.find("<", max(end, at + 1))


def number(text: str, seed: int) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text, seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def parse(source: str) -> tuple[list[int], list[tuple[int, str, int, bool]]]:
    """The page's tokens in order, and its blocks: token, text, KEPT, DOUBTFUL or OUT, whether in an article or main element.

    A tag's token is its path, a running hash of element names, so that depth costs nothing; a block's
    is a hash of its path and text.
    """
    order: list[int] = []
    blocks: list[tuple[int, str, int, bool]] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, KEPT, False)]  # name, path, standing, in main
    opened: dict[str, list[int]] = {}  # depths of the open elements of a name
    block_depths: list[int] = [0]
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(unescaped("".join(held)).split())
            held.clear()
            if text:
                order.append(number(text, stack[-1][1]))
                blocks.append((order[-1], text, stack[-1][2], stack[-1][3]))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()
        while block_depths[-1] >= depth:
            block_depths.pop()

    for start, end, slash, name, attributes in tags(source):
        if start > at:
            held.append(source[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK:
            flush()
        depths = opened.get(name)
        if slash:
            if depths and (name in BLOCK or block_depths[-1] <= depths[-1]):  # an inline end tag doesn't close a block
                close_to(depths[-1])
            continue
        if name in ENDS_P:
            if stack[block_depths[-1]][0] == "p":
                close_to(block_depths[-1])
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                close_to(len(stack) - 1)
        _, path, out, main = stack[-1]
        if name in BLOCK:
            path = number(name, path)
            order.append(path)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        is_main = name == "main" or 'role="main"' in attributes
        out = max(KEPT if is_main else out, standing(name, attributes, main))
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            block_depths.append(len(stack))
        stack.append((name, path, out, main or is_main or name == "article"))
    held.append(source[at:])
    flush()
    return order, blocks


def host_of(url):
    """The host of a url column, lower case."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def parsed(pages: DataFrame) -> DataFrame:
    """Adds blocks; tokens: (token, count) of the page's distinct tokens; and order: all its tokens."""
    names = ["_blocks", "_tokens", "_order"]
    block = T.StructType().add("text", "string").add("token", "long").add("out", "integer").add("main", "boolean")
    token = T.StructType().add("token", "long").add("n", "integer")
    schema = T.StructType([*pages.schema.fields, *(T.StructField(n, T.ArrayType(t)) for n, t in zip(names, (block, token, T.LongType()), strict=True))])
    block_type = pa.list_(pa.struct([("text", pa.string()), ("token", pa.int64()), ("out", pa.int32()), ("main", pa.bool_())]))
    token_type = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20, "html"):
                all_blocks, all_tokens, all_order = [], [], []
                for source in part.column("html").to_pylist():
                    order, blocks = parse(source or "")
                    seen: dict[int, int] = {}
                    for one in order:
                        seen[one] = seen.get(one, 0) + 1
                    all_blocks.append([{"text": t, "token": k, "out": o, "main": m} for k, t, o, m in blocks])
                    all_order.append(order)
                    all_tokens.append([{"token": k, "n": n} for k, n in seen.items()])
                yield pa.record_batch([*part.columns, pa.array(all_blocks, block_type), pa.array(all_tokens, token_type), pa.array(all_order, pa.list_(pa.int64()))], [*part.schema.names, *names])

    return pages.mapInArrow(run, schema)


#: A host with more than this share of all pages, and FEW, is hot; most bytes, as JSON, of hot hosts' lists that are sent to every task.
HOT, FEW, SENT = 1 / 1000, 255, 64 << 20


def hot_hosts(seen: DataFrame, work: Workspace) -> DataFrame:
    """(_host) of the hot hosts: under a thousand rows."""
    least = max(FEW, HOT * seen.count())
    return work.save(seen.groupBy(F.col("host").alias("_host")).count().filter(F.col("count") > least).select("_host"), "hot")


def met(pages: DataFrame, known: DataFrame, hot: DataFrame, how: str = "inner", prepare=lambda pages: pages) -> DataFrame:
    """pages (_host, ...), prepared, joined with known (host, value) on the host: those of hot hosts without a shuffle."""
    known, hot = known.withColumnRenamed("host", "_host"), F.broadcast(hot)
    own, rest = (known.join(hot, "_host", kind) for kind in ("left_semi", "left_anti"))
    value = next(c for c in known.columns if c != "_host")
    if own.agg(F.coalesce(F.sum(F.length(F.to_json(value))), F.lit(0))).first()[0] <= SENT:
        own = F.broadcast(own)
    of_hot, others = (prepare(pages.join(hot, "_host", kind)) for kind in ("left_semi", "left_anti"))
    return of_hot.join(own, "_host", how).unionByName(others.join(rest, "_host", how))


def orders(tokens: list[int], classes: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(class, its tokens in the page's order) of the classes on a page; none if their order changes within the page."""
    at = {t: c for c, own in enumerate(classes) for t in own}
    met: dict[int, list[int]] = {}
    for t in tokens:
        if t in at:
            met.setdefault(at[t], []).append(t)
    found = []
    for c, row in met.items():
        first = row[: len(classes[c])]
        found.append((c, first if len(set(first)) == len(first) and row == first * (len(row) // len(first)) else []))
    return found


def _gaps(tokens: list[int], classes: list[list[int]]) -> tuple[dict[int, set[int]], set[int]]:
    """Of the ordered classes on a page: hashes of the gaps around each, outermost first; and those that cross the class around them."""
    at = {t: (c, j) for c, own in enumerate(classes) for j, t in enumerate(own)}
    stack: list[list[int]] = []  # class, its last token, hash of the gaps around it
    around: dict[int, set[int]] = {}
    crossing: set[int] = set()
    for t in tokens:
        c, j = at.get(t, (-1, 0))
        if c < 0 or c in crossing:
            continue
        if j == 0:
            gaps = hash((stack[-1][2], classes[stack[-1][0]][0], stack[-1][1])) if stack else 0
            around.setdefault(c, set()).add(gaps)
            stack.append([c, 0, gaps])
            continue
        while stack[-1][0] != c:
            crossing.add(stack.pop()[0])
        stack[-1][1] = j
        if j == len(classes[c]) - 1:
            stack.pop()
    return around, crossing


def uncrossed(tokens: list[int], classes: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(class, [1]) of the classes on a page; empty for those that cross another."""
    around, crossing = _gaps(tokens, classes)
    return [(c, [] if c in crossing else [1]) for c in around]


def nesting(tokens: list[int], classes: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(class, [hash of the gaps around it]) of the classes on a page; empty for those in several."""
    return [(c, list(gaps) if len(gaps) == 1 else []) for c, gaps in _gaps(tokens, classes)[0].items()]


def _agreed(seen: DataFrame, classes: DataFrame, hot: DataFrame, judge, work: Workspace, name: str) -> DataFrame:
    """(host, class, verdict): the classes on which all pages give one verdict, which isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts: dict[tuple[str, int], list[int]] = {}
            known: dict[str, list[list[int]]] = {}
            for host, tokens, own in zip(batch.column("_host").to_pylist(), batch.column("_order").to_pylist(), batch.column("classes"), strict=True):
                if host not in known:
                    known[host] = own.as_py()
                for c, verdict in judge(tokens, known[host]):
                    key = (host, min(known[host][c]))
                    if verdicts.setdefault(key, verdict) != verdict:
                        verdicts[key] = []
            longs = pa.list_(pa.int64())
            yield pa.record_batch([pa.array([h for h, _ in verdicts], pa.string()), pa.array([c for _, c in verdicts], pa.int64()), pa.array(list(verdicts.values()), longs)], ["host", "class", "verdict"])

    pages = met(seen.select(F.col("host").alias("_host"), "_order"), classes, hot)
    judged = pages.mapInArrow(run, "host string, class long, verdict array<long>").groupBy("host", "class").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("other"))
    return work.save(judged.filter("verdict = other and size(verdict) > 0").select("host", "class", "verdict"), name)


def _by_host(ordered: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(host, classes), from one row for each class with its tokens in order."""
    return work.save(ordered.groupBy("host").agg(F.array_sort(F.collect_list("tokens")).alias("classes")), name)


def templates(seen: DataFrame, hot: DataFrame, work: Workspace, least_share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(host, template): the tokens of the valid equivalence classes of every host.

    seen: host, page (a hash of the row), tokens, order. Two tokens are of one class if their signatures
    over the host's pages are equal. First order is judged; then, of the ordered classes, which cross
    another one; then whether the others always stand in the same gaps.
    """
    each = seen.select("host", "page", F.explode("_tokens").alias("t")).select("host", "page", "t.*")
    mark = F.xxhash64("page", "n")
    low = lambda c: c.bitwiseAND(F.lit((1 << 31) - 1))
    vectors = each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum(low(mark)).alias("s1"), F.sum(low(F.shiftright(mark, 32))).alias("s2"))
    size = seen.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    frequent = vectors.join(size, "host").filter((F.col("pages") >= least_pages) & (F.col("pages") >= least_share * F.col("of")))
    classes = frequent.groupBy("host", "pages", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    large = _by_host(classes.filter(F.size("tokens") >= 2), work, "large")
    ordered = _agreed(seen, large, hot, orders, work, "ordered").select("host", "class", F.col("verdict").alias("tokens"))
    apart = _agreed(seen, _by_host(ordered, work, "by-order"), hot, uncrossed, work, "uncrossed").select("host", "class")
    apart = work.save(ordered.join(apart, ["host", "class"]), "apart")
    nested = _agreed(seen, _by_host(apart, work, "by-nesting"), hot, nesting, work, "nested").select("host", "class")
    return apart.join(nested, ["host", "class"]).groupBy("host").agg(F.flatten(F.array_sort(F.collect_list("tokens"))).alias("template"))


def extract(pages: DataFrame, keep_html: bool = True) -> DataFrame:
    """Adds ``text`` (the main text, blocks joined by a line feed) and ``n_chars``.

    Pages are parsed twice: for their hosts' templates, and for their text. Only the tokens' hashes are
    written in between.
    """
    work = Workspace(pages.sparkSession, "html")
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if keep_html or c != "html"]
    read = pages.withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit(""))).withColumn("_host", host_of(F.col("url")))
    page = F.xxhash64(*(c for c in ("page_id", "url", "html") if c in pages.columns)).alias("page")
    seen = work.save(parsed(read).select(F.col("_host").alias("host"), page, "_tokens", "_order"), "seen")
    hot = hot_hosts(seen, work)
    found = work.save(templates(seen, hot, work), "templates").withColumnRenamed("template", "_template")
    blocks = lambda pages: parsed(pages).select("_host", *kept, "_blocks")
    known = met(read, found, hot, "left", blocks).withColumn("_template", F.coalesce("_template", F.array().cast("array<bigint>")))
    fixed = lambda b: F.array_contains(F.col("_template"), b.token)
    in_main = known.withColumn("_main", F.filter("_blocks", lambda b: b.main & ((b.out == KEPT) | ((b.out == DOUBTFUL) & ~fixed(b)))))
    in_main = in_main.withColumn("_slots", F.filter("_main", lambda b: ~fixed(b)))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, b: n + F.length(b.text))
    main = F.when(2 * chars("_slots") > chars("_main"), F.col("_slots")).otherwise(F.col("_main"))
    others = F.filter("_blocks", lambda b: (b.out != OUT) & ~fixed(b))
    slots = F.when(F.size("_main") > 0, main).otherwise(others)
    out = in_main.select(*kept, F.array_join(F.transform(slots, lambda b: b.text), "\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the extraction query."""
    return extract(pages.select("page_id", "url", "html"), keep_html=False).select("page_id", "url", "text", "n_chars")
