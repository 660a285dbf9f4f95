"""Main text of web pages by differencing against the page of the nearest URL.

Pages are ordered by path within their host; a page is paired with the
neighbour in that order whose path shares the longer prefix. The text lines of
the two are aligned by a longest common subsequence, and what they share is the
site's template: those lines are deleted. Two things bound the deletion. A pair
that shares nearly all letters outside the host's template are copies of one
article, not two pages of one template; then the other neighbour is taken, or
none. And a paragraph that the page itself marks as body text (inside
``article`` or ``main``) stays, since articles of one host quote the same
passages, unless it is of the host's template. A line is of the template if
most of the host's different pages hold it; how surely is the lower bound of
that share, so few pages are little evidence and the same rule serves a host of
any size.

Lines that are the page's own but stand in menus, footers, asides, adverts,
notices or comments go by their markup. Class and id names and forms are only
hints: an element that they point at stays if it holds the article, a main
heading or most of the page's text, and its lines are then left to differencing.

A page is parsed once. Only line hashes are shuffled: to their place in the
order, and to blocks of bounded size in which pages meet their neighbours, so a
host of any size is spread over many tasks. The lines that may become the text
wait in a table bucketed by the input partition that they came from; what was
found is brought to that partition, so neither html nor text is ever shuffled.
"""
from __future__ import annotations

import re
import uuid
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_sum, scratch
from .urlfilter import host_of, path_of

BLOCK_PAGES = 256
# groups over which the copies of one page are dealt
COPY_SALTS = 8
# two pages are copies if they share more than this of the letters outside the template (of marked paragraphs, if any)
COPY_SHARE = 0.8
# a line is of the template if the lower bound of its share among the host's different pages is above one half;
# the bound lies this many standard errors below the share (99 % sure, one-sided)
TEMPLATE_SURE = 2.326
# an element that a name or a form points at stays if it holds more than this of the page's letters
MOST = 0.5

PROTECTED, KEPT = 1, 2

DROPPED, LOOSE, BODY = 0, 1, 2

# Elements of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button "
                "head datalist".split())
# what a head can hold: anything else ends it, its end tag may be left out
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
TEMPLATE = frozenset("nav aside footer dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option "
                   "p pre section summary table tbody td tfoot th thead title tr ul".split())
SCOPES = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main "
                   "menu nav ol section table td th ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li td th dd dt figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                  "toolbar".split())
NAMES = frozenset("ad ads adv advert advertisement adsbygoogle advertising banner breadcrumb breadcrumbs byline "
                  "comment comments cookie cookies consent disclaimer disqus footer gdpr header login masthead menu "
                  "modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion "
                  "recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe "
                  "subscription tags teaser toolbar widget".split())
# names of areas that hold articles of their own, none of them the page's
OTHERS = frozenset("comment comments disqus recommended related respond sidebar teaser promo promoted".split())
# words that say what kind of element it is and nothing about its content
GENERIC = frozenset("area bar block body box btn button buttons col column container content group holder icon icons "
                    "inner item items label layout link links list outer panel row section text title unit wrap "
                    "wrapper".split())
# words before a name that speak of another element, or of a state
STATES = frozenset("has have with without no not is show shows hide hides toggle open close js after before under "
                   "above below".split())
# words that tell what the following ones are
KINDS = frozenset("related recommended promoted sponsored advertisement ad ads".split())
FIELDS = frozenset("input select textarea button".split())
_NAME = re.compile(r"[A-Za-z]+")


def _names(attrs: dict) -> set[str]:
    """What class and id names say of an element itself: the last telling word of each, or a leading kind."""
    out = set()
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        # camelCase and dash-separated names alike
        words = [w.lower() for w in _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))]
        if not words or words[0] in STATES:
            continue
        while len(words) > 1 and words[-1] in GENERIC:
            words.pop()
        out |= {w for w in (words[-1], words[0] if words[0] in KINDS else "") if w in NAMES}
    return out


class Suspect:
    """An element that its name or its being a form marks as no part of the article, until it proves otherwise."""

    __slots__ = ("others", "form", "letters", "fields", "articles", "headings")

    def __init__(self, others: bool, form: bool):
        self.others, self.form = others, form
        self.letters = self.fields = self.articles = self.headings = 0

    def condemned(self, letters: int) -> bool:
        if self.form and not self.fields:
            return False
        # areas of other articles hold many, and comments can outweigh the page; only its heading clears them
        if self.others:
            return not self.headings
        return not (self.articles or self.headings or self.letters > MOST * letters)


class PageLines(HTMLParser):
    """Text lines of a page in order, see :meth:`lines`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # (text, dropped for good, inside body, in a paragraph and not all links, suspects around it)
        self.found: list[tuple] = []
        # (tag, dropped for good, suspects, inside an area of other articles, inside body, raw)
        self.stack: list[tuple] = [("", False, (), False, False, False)]
        self.text: list[str] = []
        self.linked = self.total = 0
        self.links = 0

    def lines(self) -> list[tuple[str, int, bool]]:
        """(text, zone, protected)"""
        letters = sum(len(f[0]) for f in self.found if not f[1])
        out = []
        for text, dropped, body, prose, suspects in self.found:
            gone = dropped or any(x.condemned(letters) for x in suspects)
            zone = DROPPED if gone else BODY if body else LOOSE
            out.append((text, zone, zone == BODY and prose))
        return out

    def flush(self):
        line = " ".join("".join(self.text).split())
        if line:
            block = next((e[0] for e in reversed(self.stack) if e[0] in BLOCKS), "")
            _, dropped, suspects, _, body, _ = self.stack[-1]
            self.found.append((line, dropped, body, block in PROSE and self.linked < self.total, suspects))
            if not dropped:
                for x in suspects:
                    x.letters += len(line)
        self.text, self.linked, self.total = [], 0, 0

    def _close_head(self, tag):
        names = [e[0] for e in self.stack]
        if tag == "body" and "head" in names and "template" not in names:
            del self.stack[names.index("head"):]
        while tag not in HEAD and self.stack[-1][0] == "head":
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        self._close_head(tag)
        if tag in BLOCKS:
            self.flush()
            self._close_implied(tag)
        if tag in VOID:
            self._field(tag)
            return
        attrs = dict(attrs)
        _, dropped, suspects, others, body, raw = self.stack[-1]
        names = _names(attrs) if tag not in ("html", "body", "main") else set()
        if tag == "main" or (tag == "article" and not names & OTHERS and not others):
            # the article itself: what its own names say of the whole page does not matter
            names, body = set(), True
            for x in suspects:
                x.articles += 1
                x.headings += tag == "main"
        if tag == "h1":
            for x in suspects:
                x.headings += 1
        if names or tag == "form":
            suspects = (*suspects, Suspect(bool(names & OTHERS), tag == "form" and not names))
            others = others or bool(names & OTHERS)
        style = (attrs.get("style") or "").replace(" ", "").lower()
        hidden = ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style
                  or (attrs.get("role") or "").lower() in ROLES)
        template = tag in TEMPLATE or (tag == "header" and not body)
        self._field(tag)
        self.stack.append((tag, dropped or template or hidden or tag in RAW, suspects, others, body, raw or tag in RAW))
        if tag == "a":
            self.links += 1

    def _field(self, tag):
        if tag in FIELDS:
            for x in self.stack[-1][2]:
                x.fields += 1

    def _close_implied(self, tag):
        # a paragraph ends where the next block begins, a list item where the next one does
        ends = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
                "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "br": ()}.get(tag, ("p",))
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name in ends:
                del self.stack[i:]
                return
            if name in SCOPES:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                self.links -= sum(e[0] == "a" for e in self.stack[i:])
                del self.stack[i:]
                return
            if name in SCOPES and tag not in SCOPES:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and data.strip():
            self._close_head("")
        if self.stack[-1][5]:
            return
        self.text.append(data)
        n = len(data.strip())
        self.total += n
        if self.links > 0:
            self.linked += n


def page_lines(html: str | None) -> list[tuple[str, int, bool]]:
    """(text, zone, protected) of every text line of a page, in order."""
    if not html:
        return []
    p = PageLines()
    p.feed(html)
    p.close()
    p.flush()
    return p.lines()


def _lengths(a, b) -> np.ndarray:
    """LCS lengths of a against every prefix of b."""
    v, _ = _sweep(a, b, False)
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[:len(b)].astype(np.int64))])


def _sweep(a, b, keep: bool):
    """Bit-parallel LCS rows: bit j of row i is 0 where the length grows from b[:j] to b[:j + 1]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return v, rows


def common_lines(a: list, b: list, cells: int = 1 << 28) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``; memory stays below ``cells`` bits."""
    out: list[int] = []

    def solve(a, b, base):
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            out.append(base + head)
            head += 1
        a, b, base = a[head:], b[head:], base + head
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            out.append(base + len(a) - 1 - tail)
            tail += 1
        a, b = a[:len(a) - tail], b[:len(b) - tail]
        if not a or not b:
            return
        if len(a) * len(b) > cells and len(a) > 1:
            mid = len(a) // 2
            left, right = _lengths(a[:mid], b), _lengths(a[mid:][::-1], b[::-1])
            cut = int(np.argmax(left + right[::-1]))
            solve(a[:mid], b[:cut], base)
            solve(a[mid:], b[cut:], base + mid)
            return
        _, rows = _sweep(a, b, True)
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not (i and not rows[i - 1] >> (j - 1) & 1):
                    j -= 1
                    out.append(base + i)

    solve(a, b, 0)
    return sorted(out)


def _kept_zone(lines) -> int:
    """The zone the main text is taken from."""
    return BODY if any(zone == BODY for _, zone, _ in lines) else LOOSE


LINE_SCHEMA = ("part long, row long, page_id long, url string, page long, digest long, host string, path string, "
               "lines binary, flags binary, chars binary, content long, kept array<long>, text string")


def _line_hashes(parts: np.ndarray):
    """Pages to line hashes, flags and lengths, and the lines of the kept zone; ``parts`` names the input partitions."""
    def run(batches):
        import xxhash

        part, row = int(parts[TaskContext.get().partitionId() % len(parts)]), TaskContext.get().partitionId() << 33
        same = ["page_id", "url", "page", "digest", "host", "path"]
        for b in batches:
            hashes, flags, chars, content, own, texts = [], [], [], [], [], []
            for html in b.column("html"):
                lines = page_lines(html.as_py())
                zone = _kept_zone(lines)
                h = np.array([xxhash.xxh64_intdigest(t) for t, _, _ in lines], dtype="<u8")
                f = np.array([PROTECTED * p + KEPT * (z == zone) for _, z, p in lines], dtype=np.uint8)
                kept = h[f & KEPT > 0]
                hashes.append(h.tobytes())
                flags.append(f.tobytes())
                chars.append(np.array([len(t) for t, _, _ in lines], dtype="<i4").tobytes())
                content.append(kept.tobytes())
                own.append(np.unique(kept).view("<i8"))
                # white space inside a line is one space, so a newline can part the lines
                texts.append("\n".join(t for t, z, _ in lines if z == zone))
            n = b.num_rows
            ends = np.cumsum([0] + [len(x) for x in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), *[b.column(c) for c in same],
                 pa.array(hashes, pa.binary()), pa.array(flags, pa.binary()), pa.array(chars, pa.binary()),
                 pa.array([xxhash.xxh64_intdigest(x) - 2 ** 63 for x in content], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "<i8"), *own]))),
                 pa.array(texts, pa.string())],
                ["part", "row", *same, "lines", "flags", "chars", "content", "kept", "text"])
            row += n
    return run


MAX_BUCKETS = 50_000


def _bucket_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n buckets a number that Spark's hash puts there."""
    got = np.full(n, -1, dtype=np.int64)
    at = 0
    while (got < 0).any():
        some = spark.range(at, at + 16 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("b"))
        for r in some.groupBy("b").agg(F.min("id").alias("id")).collect():
            if got[r["b"]] < 0:
                got[r["b"]] = r["id"]
        at += 16 * n
    return got


def _line_table(pages: DataFrame) -> DataFrame:
    """The parsed pages as a table in the shared folder, one bucket for each input partition."""
    spark = pages.sparkSession
    # a hash of the url and html names a page among those of one page_id
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("page_id").cast("long"), F.lit(-(2 ** 63))).alias("page"),
        F.xxhash64("url", "html").alias("digest"), host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"), "html")
    n = max(1, min(MAX_BUCKETS, keyed.rdd.getNumPartitions()))
    name = f"llm_lines_{uuid.uuid4().hex}"
    keyed.mapInArrow(_line_hashes(_bucket_keys(spark, n)), LINE_SCHEMA).write.format("parquet").bucketBy(
        n, "part").option("path", scratch(spark, "lines")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _shared_places(i: int, lines: list, flags: list, chars: list, path: list, pos: list, common: set) -> list[int]:
    """Places of the lines that page ``i`` shares with its nearest neighbour that is no copy of it."""
    if not lines[i]:
        return []
    sides = [j for j in (i - 1, i + 1) if 0 <= j < len(pos) and abs(pos[j] - pos[i]) == 1]
    # what tells two pages apart: letters of marked paragraphs, or of the kept zone, outside the template
    marked = flags[i] & PROTECTED > 0
    weight = chars[i] * (marked if marked.any() else flags[i] & KEPT > 0)
    weight = weight * np.array([x not in common for x in lines[i]], dtype=np.int64)
    for j in sorted(sides, key=lambda j: -_prefix(path[i], path[j])):
        at = common_lines(lines[i], lines[j])
        if not weight[at].sum() > COPY_SHARE * weight.sum():
            return at
    return []


def _pair_block(table: pa.Table) -> pa.Table:
    """What the pages of one block share with their nearest neighbours, and what of it is to go.

    A row without a place holds the template lines of the host.
    """
    common: set[int] = set()
    for x in table.filter(pc.is_null(table["pos"]))["lines"]:
        common.update(np.frombuffer(x.as_py(), "<u8").tolist())
    table = table.filter(pc.is_valid(table["pos"])).sort_by("pos")
    path, pos, own = (table[c].to_pylist() for c in ("path", "pos", "own"))
    lines = [np.frombuffer(x.as_py(), "<u8").tolist() for x in table["lines"]]
    flags = [np.frombuffer(x.as_py(), np.uint8) for x in table["flags"]]
    chars = [np.frombuffer(x.as_py(), "<i4") for x in table["chars"]]
    cut, n_shared = [], []
    for i in np.flatnonzero(own):
        shared = _shared_places(i, lines, flags, chars, path, pos, common)
        gone = [k for k in shared if not flags[i][k] & PROTECTED or lines[i][k] in common]
        cut.append(np.array(gone, dtype="<i4").tobytes())
        n_shared.append(len(shared))
    rows = table.filter(pa.array(own, pa.bool_()))
    return pa.table({"page": rows["page"], "digest": rows["digest"], "cut": pa.array(cut, pa.binary()),
                     "n_shared": pa.array(n_shared, pa.int64())})


def _assemble(pages: pa.Table, found: pa.Table) -> pa.Table:
    """The pages of one input partition and what was found of them to main texts."""
    at = {r: i for i, r in enumerate(found["at"].to_pylist())}
    cuts, shared = found["cut"], found["n_shared"].to_pylist()
    texts, n_lines, n_shared = [], [], []
    for row, raw, text in zip(pages["row"].to_pylist(), pages["flags"], pages["text"]):
        i = at[row]
        flags = np.frombuffer(raw.as_py(), np.uint8)
        gone = set(np.frombuffer(cuts[i].as_py(), "<i4").tolist())
        lines = text.as_py().split("\n")
        texts.append(" ".join(t for k, t in zip(np.flatnonzero(flags & KEPT).tolist(), lines) if k not in gone))
        n_lines.append(len(flags))
        n_shared.append(shared[i])
    return pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": pa.array(texts, pa.string()),
                     "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                     "n_lines": pa.array(n_lines, pa.int64()), "n_shared": pa.array(n_shared, pa.int64())})


def _template_lines(light: DataFrame) -> DataFrame:
    """(host, lines): the lines that surely more than half of the different pages of a host hold.

    Pages with the same lines count once, so copies do not make a template. The
    lower bound is Wilson's: of a line that all n pages hold it is n / (n + 5.4).
    At most twice the mean number of lines of a page per host.
    """
    contents = light.dropDuplicates(["host", "content"])
    total = contents.groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    held = contents.select("host", F.explode("kept").alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1")
    share, n, z = F.col("_n") / F.col("_all"), F.col("_all"), TEMPLATE_SURE
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    held = held.join(total, "host").where(bound > 0.5)
    return held.groupBy("host").agg(F.collect_list("line").alias("_lines")).mapInArrow(
        _as_binary, "host string, lines binary")


def _as_binary(batches):
    for b in batches:
        lines = [np.array(x.as_py(), dtype="<i8").tobytes() for x in b.column("_lines")]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(lines, pa.binary())], ["host", "lines"])


def main_text(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Main text of every page.

    Returns one row per input row: page_id, url, text, n_chars, n_lines (text
    lines of the page), n_shared (lines that its nearest neighbour has too).
    Null or empty html has the empty text; a null URL is on the host of the
    empty name; html and texts of any length are read whole; rows repeated whole
    are one page and get the same result each; pages of equal URLs are ordered by
    page_id; an empty table gives an empty result; other columns are not read.
    """
    table = _line_table(pages)
    once = table.groupBy("host", "path", "page", "digest").agg(F.min("row").alias("row")).withColumn("one", F.lit(1))
    order = running_sum(once, ["host"], ["path", "page", "digest"], "one", "pos", "order")
    placed = table.select("row", "host", "page", "digest", "path", "lines", "flags", "chars").join(
        order.select("row", "pos"), "row")
    block = F.floor((F.col("pos") - 1) / block_pages)
    inside = (F.col("pos") - 1) % block_pages
    blocks = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")),
                     F.when(inside == 0, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
                     F.when(inside == block_pages - 1, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    spread = placed.withColumn("_b", F.explode(F.array_compact(blocks))).select(
        "host", "_b.block", "_b.own", "pos", "page", "digest", "path", "lines", "flags", "chars")
    # the template of the host goes to each of its blocks
    last = order.groupBy("host").agg(F.floor((F.max("pos") - 1) / block_pages).alias("_last"))
    common = _template_lines(table.select("host", "content", "kept")).join(last, "host").select(
        "host", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("block"), "lines")
    spread = spread.unionByName(common, allowMissingColumns=True)
    found = spread.groupBy("host", "block").applyInArrow(
        _pair_block, "page long, digest long, cut binary, n_shared long")
    # rows repeated whole are one page; what was found of it goes to each of them
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_SALTS - 1).cast("long"))))
    found = table.select("part", "row", "page", "digest", (F.col("row") % COPY_SALTS).alias("_salt")).join(
        found, ["page", "digest", "_salt"]).select(F.col("part").alias("of"), F.col("row").alias("at"), "cut", "n_shared")
    return table.select("part", "row", "page_id", "url", "flags", "text").groupBy("part").cogroup(
        found.groupBy("of")).applyInArrow(
        _assemble, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long")
