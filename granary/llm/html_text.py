"""Main text of web pages by nearest-URL page differencing.

Pages of a host stand in the order of their paths; each is paired with the nearest page on either side that is no copy
of it. Their lines are aligned by a longest common subsequence, and what both share is template, not text. A line is a
text block; blocks in one element that a class, id or role names stand together as a slot, by its name, so that two pages
share a slot whose text changes (an advert, say). Which slots are template in this corpus is counted from all pairs: one
that neighbours mostly share goes from every page, also where neighbours lack it or there is none to compare with.

An exact check of the markup follows: lines in the page's article element stay even if a neighbour has them (copies and
quoted passages are text), and elements that mean page furniture in HTML (nav, footer, aside, form and the like) go
even if no neighbour has them. Within an article an element is a slot only if its name says so (MARKS), as there
paragraphs may have classes too; without an article the slot that holds half of the page's text is none.
"""

import html
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from granary.llm.common import dropped, partitions, saved
from granary.llm.url_filter import host_path

#: Elements by what they mean for text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "head"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Words of class, id and role attributes that mark page furniture within an article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer",
    "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promos", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that close by themselves when another of their kind, or a block, opens.
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li", "dt", "dd", "option", "tr", "td", "th", "p"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WHITE = re.compile(r"\s+")
#: Pages that share so much of the larger one's text are copies; they say nothing about each other's template.
COPY_PERCENT = 80
#: A slot is believed to be template if so large a part of its lines on compared pages is shared, and so many in a thousand pages have it.
SLOT_PERCENT, SLOT_PAGES = 50, 1
#: Without an article, a slot with so large a part of a page's text holds its text.
TEXT_PERCENT = 50
#: Bits of the alignment's table that are held at once; larger ones are halved first.
TABLE_BITS = 1 << 27


@dataclass(frozen=True)
class Block:
    text: str
    main: bool
    furniture: bool
    slot: str | None  # the innermost element around it that is furniture, or that a class, id or role names


def _names(tag: str) -> list[str]:
    """Words of the tag's class, id and role, without what numbers them."""
    return [w for m in ATTRIBUTE.finditer(tag) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w]


def _mark(tag: str) -> str | None:
    """The tag's first word among MARKS."""
    return next((w for w in _names(tag) if w in MARKS), None)


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, blank ones left out; lenient about tags that are not closed."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, str | None]] = []  # name, and of Block: in main, in furniture, slot
    text: list[str] = []
    main = furniture = heading = False
    slot = None

    def flush() -> None:
        if text:
            # references are decoded before white space is, so a coded space counts as one
            if line := WHITE.sub(" ", html.unescape("".join(text))).strip():
                out.append(Block(line, main, False, None) if heading else Block(line, main, furniture, slot))
            text.clear()

    def state() -> None:
        nonlocal main, furniture, slot
        main, furniture, slot = stack[-1][1:] if stack else (False, False, None)

    source, pos = page or "", 0
    while m := TOKEN.match(source, pos):
        token, pos = m[0], m.end()
        if token[0] != "<" or token == "<":
            text.append(token)
            continue
        if not (t := TAG.match(token)):
            if token.startswith("<![CDATA["):
                text.append(html.escape(token[9:].removesuffix("]]>")))
            continue  # a comment or declaration
        name = t[1].lower()
        if token[1] == "/":
            if name not in INLINE:
                flush()
            names = [s[0] for s in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name) :]
                state()
            if name in HEADINGS:
                heading = False
            continue
        if name in RAW and not token.endswith("/>"):
            end = re.compile(rf"</{name}\s*>", re.I).search(source, pos)
            if name in ("svg", "math", "canvas"):
                flush()
            # an unclosed head ends where the body starts, any other unclosed raw element at the end
            if not end and name == "head":
                end = re.compile(r"(?=<body)", re.I).search(source, pos)
            pos = end.end() if end else len(source)
            if name not in ("svg", "math", "canvas"):
                text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            if not _mark(token) or name in VOID:
                continue
        flush()
        if name in CLOSED_BY_SAME or name not in INLINE:
            while stack and (stack[-1][0] == name and name in CLOSED_BY_SAME or stack[-1][0] in CLOSED_BY_BLOCK and name not in INLINE):
                stack.pop()
            state()
        if name in HEADINGS and main and not any(s[0] in ("nav", "aside", "footer", "form") for s in stack):
            # an article's own header holds its title
            heading = bool(stack) and all(not (s[2] or s[3]) or s[0] == "header" or not s[1] for s in stack)
        if name in VOID or token.endswith("/>"):
            continue
        if name in MAIN:
            if not main:
                furniture, slot = False, None
            main = True
        elif name in FURNITURE:
            furniture, slot = True, name
        elif name not in ("html", "body") and (word := _mark(token) if main else ".".join(_names(token))):
            slot = f"{name}.{word}"
        stack.append((name, main, furniture, slot))
    flush()
    if not any(b.main for b in out):
        held = Counter()
        for b in out:
            held[b.slot if not b.furniture else None] += len(b.text) * (not b.furniture)
        texts = {s for s, n in held.items() if s and 100 * n >= TEXT_PERCENT * held.total()}
        out = [replace(b, slot=None) if not b.furniture and b.slot in texts else b for b in out]
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel longest common subsequence: a bit vector over b after each element of a."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, v, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of a longest common subsequence in ``a``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    inner_a, inner_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    return [*range(lo), *(lo + i for i in _aligned(inner_a, inner_b)), *range(len(a) - hi, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > TABLE_BITS:  # halve a where the two halves' lengths add up best
        half = len(a) // 2
        head, tail = _rows(a[:half], b)[-1], _rows(a[half:][::-1], b[::-1])[-1]
        before, after = [0], [0]
        for j in range(len(b)):
            before.append(before[-1] + (not head >> j & 1))
            after.append(after[-1] + (not tail >> j & 1))
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        return [*_aligned(a[:half], b[:cut]), *(half + i for i in _aligned(a[half:], b[cut:]))]
    rows, found, j = _rows(a, b), [], len(b)
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):
        if not j:
            break
        # zeros in the first j bits count the subsequence's length against b's first j elements
        mask = (1 << j) - 1
        here, above = rows[i], rows[i - 1] if i else full
        length = j - (here & mask).bit_count()
        if j - (above & mask).bit_count() < length:
            found.append(i)
            while j - 1 - (here & (mask >> 1)).bit_count() == length:
                j, mask = j - 1, mask >> 1
            j -= 1
    return found[::-1]


@dataclass(frozen=True)
class Lines:
    """A page to compare: each line's key (its text's hash, or its slot's) and its length (0 for a slot)."""

    keys: list[int]
    sizes: list[int]

    def shared(self, other: "Lines") -> list[int]:
        return shared_lines(self.keys, other.keys)

    def copies(self, other: "Lines", shared: list[int] | None = None) -> bool:
        at = self.shared(other) if shared is None else shared
        return 100 * sum(self.sizes[i] for i in at) >= COPY_PERCENT * max(1, sum(self.sizes), sum(other.sizes))


def line_numbers(found: list[Block]) -> list[int]:
    """The line of each block: those in a row in one slot are one line."""
    out, line = [], -1
    for i, b in enumerate(found):
        line += not (i and b.slot and found[i - 1].slot == b.slot)
        out.append(line)
    return out


def lines_of(found: list[Block]) -> tuple[Lines, list[str | None]]:
    """The page's lines, and their slots."""
    numbers = line_numbers(found)
    firsts = [b for i, b in enumerate(found) if not i or numbers[i - 1] != numbers[i]]
    return Lines([xxh3_64_intdigest(f"slot:{b.slot}" if b.slot else b.text) >> 1 for b in firsts], [0 if b.slot else len(b.text) for b in firsts]), [b.slot for b in firsts]


def main_text(found: list[Block], template: set[int], believed: set[str]) -> str:
    """``template``: lines shared with a neighbour; ``believed``: slots that are template in the corpus."""
    kept = []
    for b, line in zip(found, line_numbers(found)):
        gone = b.furniture or b.slot in believed or line in template
        if not gone or b.main and not b.slot and not b.furniture:
            kept.append(b.text)
    return "\n\n".join(kept)


def _key(*values) -> tuple:
    """For comparison as Spark orders structs, nulls first."""
    return tuple((v is not None, v) for v in values)


#: Pages in their order; the row's number parts those that are otherwise alike.
ORDER = ("host", "path", "id", "url", "row")


def _bounds(rows: DataFrame, n: int) -> tuple[list[tuple], list[tuple]]:
    """First and last keys of ``n`` ranges of about as many rows: two keys a range reach the driver."""
    key = F.struct(*ORDER)
    dealt = rows.select(*ORDER).repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in ORDER])
    found = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    return sorted(_key(*r["lo"]) for r in found), sorted(_key(*r["hi"]) for r in found)


def compared(rows: Iterable[dict]) -> Iterator[dict]:
    """For each row that isn't a halo: row, range, pos, start, prev, open, at. One page is held at a time, whatever the runs.

    rows: of a range, in order, each with row, range, host, halo, keys and sizes; one row before the range may come as halo.
    A page that copies the one before it is in the same run, and all pages of a run are compared with the page before it.
    at: the lines shared with that page; None if there is none, or if it is a copy after all. start: the page begins a
    run, after page prev. open: its run began before the range.
    """
    place = last = before = last_row = None
    known, pos = True, 0
    for r in rows:
        own = Lines(r["keys"], r["sizes"])
        if (r["range"], r["host"]) != place:
            place, last, before, last_row, known = (r["range"], r["host"]), None, None, None, True
        at, start = None, last is None
        if last is not None:
            shared = own.shared(last)
            if not own.copies(last, shared):
                before, start, known, at = last, True, True, shared
        if r["halo"]:
            known = False  # where its run began is another range's matter
        else:
            if not start and before is not None:
                shared = own.shared(before)
                at = None if own.copies(before, shared) else shared
            yield {"row": r["row"], "range": r["range"], "pos": pos, "start": start, "prev": last_row if start else None, "open": not known, "at": at}
            pos += 1
        last, last_row = own, r["row"]


COMPARED = pa.schema([("row", pa.int64()), ("range", pa.int32()), ("pos", pa.int64()), ("start", pa.bool_()), ("prev", pa.int64()), ("open", pa.bool_()), ("at", pa.list_(pa.int32()))])


def shared_with_neighbours(light: DataFrame, n: int) -> DataFrame:
    """row, at: the lines that a page shares with the nearest page before or after it on its host that is no copy.

    light: ORDER, keys, sizes; pages without a line left out. Rows that no such page could be compared with have none. Pages
    are dealt by ranges and gone through forward, then backward. A range's first run may have begun in an earlier one;
    which page was before it is found from a row for each range, and those pages are then compared: the result doesn't
    depend on the ranges.
    """
    spark = light.sparkSession
    kinds = ", ".join(f"{c} {t}" for c, t in light.dtypes)
    lows, highs = _bounds(light, n)
    sides = []
    for forward in (True, False):
        edges, step = (highs, 1) if forward else (lows, -1)

        def deal(batches: Iterator[pa.RecordBatch], edges=edges, step=step) -> Iterator[pa.RecordBatch]:
            for x in batches:
                keys = [_key(*k) for k in zip(*(x[c].to_pylist() for c in ORDER))]
                own = [bisect_right(lows, k) - 1 for k in keys]
                more = [i for i, (k, b) in enumerate(zip(keys, own)) if k == edges[b] and 0 <= b + step < len(lows)]
                whole = x.take(pa.array([*range(len(keys)), *more], pa.int64()))
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array([*own, *(own[i] + step for i in more)], pa.int32()), pa.array([False] * len(keys) + [True] * len(more))], names=[*x.schema.names, "range", "halo"])

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for big in batches for i in range(0, big.num_rows, 200) for r in big.slice(i, 200).to_pylist())
            done = []
            for r in compared(rows):
                done.append(r)
                if len(done) == 1000:
                    yield pa.RecordBatch.from_pylist(done, COMPARED)
                    done = []
            yield pa.RecordBatch.from_pylist(done, COMPARED)

        order = [F.col(c).asc_nulls_first() if forward else F.col(c).desc_nulls_last() for c in ORDER]
        dealt = light.mapInArrow(deal, f"{kinds}, range int, halo boolean").repartitionById(max(1, len(lows)), "range").sortWithinPartitions("range", *order)
        side = saved(dealt.mapInArrow(go, "row long, range int, pos long, start boolean, prev long, open boolean, at array<int>"), "compared")
        sides.append((side, side.where("at is not null").select("row", "at")))
        # the page before the run that a range ends in
        ends = {r["range"]: r["prev"] for r in side.where("start").groupBy("range").agg(F.max_by("prev", "pos").alias("prev")).collect()}
        before, carried = [], None
        for b in range(len(lows)) if forward else reversed(range(len(lows))):
            if carried is not None:
                before.append((b, carried))
            carried = ends.get(b, carried)
        open_ = side.where("open").select("row", "range")
        if before and not open_.isEmpty():
            names = ["row", "keys", "sizes"]
            earlier = spark.createDataFrame(before, "range int, row long").join(light.select(*names), "row").select("range", F.col("keys").alias("keys_"), F.col("sizes").alias("sizes_"))

            def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for big in batches:
                    for i in range(0, big.num_rows, 200):
                        rows = big.slice(i, 200).to_pylist()
                        pairs = [(Lines(r["keys"], r["sizes"]), Lines(r["keys_"], r["sizes_"])) for r in rows]
                        at = [None if a.copies(b, shared := a.shared(b)) else shared for a, b in pairs]
                        yield pa.RecordBatch.from_arrays([pa.array([r["row"] for r in rows], pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["row", "at"])

            found = open_.join(light.select(*names), "row").join(earlier, "range").select(*names, "keys_", "sizes_").mapInArrow(late, "row long, at array<int>")
            sides.append((None, found.where("at is not null")))
    every = sides[0][1]
    for _, more in sides[1:]:
        every = every.unionAll(more)
    out = saved(every.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "shared")
    dropped(*(side for side, _ in sides if side is not None))
    return out


def believed_slots(light: DataFrame, shared: DataFrame) -> set[str]:
    """Slots that neighbours mostly share, of those that a thousandth of all pages have: so at most a thousand times as many
    as a page has."""
    pages = light.count()
    lines = light.join(shared, "row", "left").select("at", F.posexplode("slots").alias("line", "slot")).where("slot is not null")
    seen = lines.groupBy("slot").agg(F.count("at").alias("n"), F.sum(F.array_contains("at", F.col("line")).cast("int")).alias("shared"))
    common = light.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count("*").alias("pages")).where(F.col("pages") * 1000 >= SLOT_PAGES * pages)
    return {r["slot"] for r in seen.join(common, "slot").where((F.col("n") > 0) & (100 * F.col("shared") >= SLOT_PERCENT * F.col("n"))).select("slot").collect()}


def extracted(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, template_lines for every row of ``pages``; other columns, whatever their names, are not read.

    Null and empty pages give an empty text; an empty table gives no row. Pages without a host (null or malformed urls)
    are paired among themselves, pages of one url stand by id; repeated rows are copies of each other and have one result.
    Pages are compared whole, however long. Lines' hashes are dealt by ranges of host, path and id, so a host of any size
    spreads over tasks; texts are shuffled once, to meet what their pages share. A page that is alone on its host, or has
    only copies beside it, is judged by the slots that the rest of the corpus shares and by what HTML itself names.
    """
    host, path = host_path(pages[url_col])
    digest: list[Column] = [F.xxhash64(*[F.coalesce(pages[c].cast("string"), F.lit("\0")) for c in cols]) for cols in ((id_col, url_col, html_col), (html_col, id_col, url_col))]
    rows = pages.select(host.alias("host"), path.alias("path"), pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), digest[0].alias("k1"), digest[1].alias("k2"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 200):
                x = big.slice(i, 200)
                found = [lines_of(blocks(p)) for p in x["html"].to_pylist()]
                cols = [pa.array([y.keys for y, _ in found], pa.list_(pa.int64())), pa.array([y.sizes for y, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*x.drop_columns("html").columns, *cols], names=[*(c for c in x.schema.names if c != "html"), "keys", "sizes", "slots"])

    named = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "html")
    light = rows.mapInArrow(hash_lines, f"{named}, keys array<bigint>, sizes array<int>, slots array<string>").where("size(keys) > 0")
    light = saved(light.withColumn("row", F.monotonically_increasing_id()), "lines")
    shared = shared_with_neighbours(light.select(*ORDER, "keys", "sizes"), partitions(spark))
    believed = believed_slots(light.select("row", "slots"), shared)
    # rows alike in id, url and page stand in one run, and so share the same lines
    by_digest = saved(light.select("row", "k1", "k2").join(shared, "row").groupBy("k1", "k2").agg(F.any_value("at").alias("at")), "template")
    dropped(light, shared)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What could be returned of each page, packed; the text of what is gone in any case is left out."""
        pack = ZstdCompressor()
        for big in batches:
            for i in range(0, big.num_rows, 200):
                x = big.slice(i, 200)
                found = [[("" if b.furniture or b.slot in believed else b.text, b.main, b.furniture, b.slot) for b in blocks(p)] for p in x["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*x.select(["id", "url", "k1", "k2"]).columns, pa.array([pack.compress(json.dumps(p).encode()) for p in found], pa.binary())], names=["id", "url", "k1", "k2", "page"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = ZstdDecompressor()
        for big in batches:
            for i in range(0, big.num_rows, 500):
                done = []
                for r in big.slice(i, 500).to_pylist():
                    template = set(r["at"] or ())
                    text = main_text([Block(*b) for b in json.loads(packed.decompress(r["page"]))], template, believed)
                    done.append((r["id"], r["url"], text, len(text), len(template)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), out_types)], names=[id_col, url_col, "text", "n_chars", "template_lines"])

    out_types = (to_arrow_type(rows.schema["id"].dataType), pa.string(), pa.string(), pa.int64(), pa.int64())
    parsed = rows.mapInArrow(parse, f"id {kinds['id']}, url string, k1 long, k2 long, page binary")
    # the same plan at every size: what pages share grows with the pages, and packs so well that files say little of it
    joined = parsed.join(by_digest.hint("merge"), ["k1", "k2"], "left").select("id", "url", "page", "at")
    return joined.mapInArrow(finish, f"`{id_col}` {kinds['id']}, `{url_col}` string, text string, n_chars long, template_lines long")
