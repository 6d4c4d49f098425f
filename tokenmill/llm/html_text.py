"""Main text of web pages by the maximum-scoring subsequence (operator 10).

A page is read as a sequence of words and tags. A word scores the share of
content among the words of its kind of element, a tag minus its share of
boilerplate; both are learned from labelled pages, those that mark their
content with an ``article`` or ``main`` element. One linear scan finds the contiguous
region of the highest total. The region's blocks are the text; if the region
lies in an ``article`` or ``main`` element, the blocks of that whole element are.
Elements that are never content (menus, headers and footers of the page,
sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden
parts) are left out by their name, class, id or role. A class or id leaves out
no main element and nothing around it, and an article or what is around it only
on pages with other content. Names that content has too ("discussion",
"related") cost points in the scan instead.

The weights come from a sample of at most ``sample`` labelled pages (the
documented bound of the fit; its counts are summed by Spark and are as many as
there are HTML element names). Every page is read whole.

Defined results: null or empty html gives the empty text; so do pages without
words; unclosed and stray tags are repaired; repeated rows get equal results;
without labelled pages a word scores 1 and a tag -0.5; an empty table gives no
rows. Existing columns with the result's names are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import landed, numbered, table
from tokenmill.session import ship_code

SAMPLE = 2000
TAG_COST = 6.0

# Element names by their part in a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video select".split())
NEVER = RAW | frozenset("head nav footer aside form button dialog menu label input datalist".split())
CONTENT = frozenset(("article", "main"))
SHELL = frozenset("head nav header menu title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_ENDS = BLOCKS - {"body", "html"}
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
# words of a class or id that name a part which is never content
_PART_WORDS = (
    r"(?:^|[-_])(?:ads?|adverts?|advertisements?|advertising|adsense|adbox|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|"
    r"menus?|nav(?:bar|igation)?|breadcrumbs?|sidebars?|side-?bar|aside|footers?|site-?header|page-?header|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscribe|subscription|signup|"
    r"comments?|disqus|replies|(?:share|sharing|social)[-_](?:share|sharing|links?|icons?|media|bar|buttons?|tools?)|"
    r"(?:related|recommended)[-_](?:posts?|articles?|stories|links?|content|news|items?)|"
    r"login|search(?:box|form|bar)?|pagination|pager|toolbar|widgets?|skip-?link|copyright)")
# words of layout that may follow them
_LAYOUT = (r"(?:[-_](?:box|bar|banner|container|wrapper|wrap|outer|inner|block|widget|form|section|list|area|unit|slot|links?|"
           r"items?|content|body|top|bottom|left|right|header|footer|main|primary|secondary|text|message|panel|popup|modal|"
           r"overlay|notice|\d+))*$")
PARTS = re.compile(_PART_WORDS + _LAYOUT, re.I)
# words that also name content: they cost points in the scan, and cut nothing
LOOSE = re.compile(_PART_WORDS + r"(?=$|[-_])|"
                   r"(?:^|[-_])(?:responses|discussion|share|sharing|social|related|recommended|recommendations|legal)(?=$|[-_])",
                   re.I)
# names that tell of a part elsewhere, or of a state
STATES = re.compile(r"(?:has|no|not|non|with|without|is|category|tag|type|format|status)[-_]|"
                    r".*[-_](?:open|closed|enabled|disabled|active|visible|layout)$", re.I)
# what an article may call itself when it is no content
ASIDES = frozenset("comment comments comment-body reply ad advert advertisement sponsored".split())
LOOSE_COST = 3 * TAG_COST

# a quote opens a value only behind "=", where HTML lets it; a quote that nothing closes is a character of the value
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<\?[^>]*>|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!/][^>]*>|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_KEYS = frozenset("class id role style aria-hidden hidden".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_part(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether the attributes say that an element is never content, whether
    its class or id does, and whether they only hint at it."""
    sure = named = loose = False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        if key not in _KEYS:
            continue
        value = m[2] or m[3] or (m[4] or "").strip("\"'")
        if key in ("class", "id"):
            for x in _CAMEL.sub("-", value).split():
                if name in CONTENT:
                    named |= name == "article" and x.lower() in ASIDES
                elif not STATES.match(x) and not (key == "id" and name in HEADINGS):   # a heading's id is its anchor
                    named |= bool(PARTS.search(x))
                    loose |= bool(LOOSE.search(x))
        sure |= key == "role" and value.lower() in ROLES
        sure |= key == "hidden" or key == "aria-hidden" and value.lower() == "true"
        sure |= key == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return sure, named, loose and not named


class Page:
    """Tokens of one page: ``(kind, feature, words, block, content)`` with
    block the number of the text block (words) and content the number of the
    enclosing article or main element, or -1.

    A part that only its class or id names is no part if a main element opens
    in it, or, on a page without other content, an article."""

    def __init__(self, page: str):
        self._reset(False)
        self._read(page)
        if not self.contents and self._missed:
            self._reset(True)
            self._read(page)

    def _reset(self, rescue: bool) -> None:
        self._rescue = rescue            # articles open in parts that only a class or id names
        self._missed = False             # there was one
        self.tokens: list[tuple[str, str, int, int, int]] = []
        self.blocks: list[list[str]] = [[]]
        self.homes: list[int] = [-1]     # content element of each block
        self.contents = 0
        # name, part that is left out, content element, left out by class or id alone, hint at a part, and the
        # places in the stack of the nearest block and of the nearest block or link, itself included
        self._stack: list[tuple[str, bool, int, bool, bool, int, int]] = []
        self._names: Counter = Counter()     # open elements by name, so that no stray tag searches the stack
        self._out = 0                        # open parts
        self._hard = 0                       # those that not only a class or id names

    def _home(self) -> int:
        return self._stack[-1][2] if self._stack else -1

    def _cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])
            self.homes.append(self._home())
        else:
            self.homes[-1] = self._home()

    def _close_to(self, depth: int) -> None:
        for name, part, home, soft, loose, *_ in self._stack[depth:]:
            self._names[name] -= 1
            self._out -= part
            self._hard -= part and not soft
            if loose and not self._out:
                self.tokens.append(("loose", "/", 1, -1, home))
        del self._stack[depth:]

    def _push(self, name: str, part: bool, home: int, soft: bool, loose: bool) -> None:
        at = len(self._stack)
        block, near = self._stack[-1][5:] if at else (-1, -1)
        self._stack.append((name, part, home, soft, loose, at if name in BLOCKS else block,
                            at if name in BLOCKS or name == "a" else near))
        self._names[name] += 1
        self._out += part
        self._hard += part and not soft

    def _open(self, name: str, attrs: str) -> None:
        block = name in BLOCKS
        if name in PARAGRAPH_ENDS or name == "li":
            # an open paragraph ends before a block; a list item before the next
            k = self._stack[-1][5] if self._stack else -1
            if k >= 0 and (self._stack[k][0] == "p" or name == "li" and self._stack[k][0] == "li"):
                self._close_to(k)
        if name in CONTENT and self._out and any(self._names[n] for n in SHELL):
            # a menu or header left open ends where the content starts
            for k, (n, part, *_) in enumerate(self._stack):
                if part and n in SHELL:
                    self._close_to(k)
                    break
        home = self._home()
        sure, named, loose = _is_part(name, attrs) if attrs else (False, False, False)
        if name in CONTENT and home < 0 and not sure and (named or self._out) and not self._hard:
            if name == "main" or self._rescue:
                if self._out:
                    self._stack = [(n, False, h, False, *rest) for n, _, h, _, *rest in self._stack]
                self._out, named = 0, False
            else:
                self._missed = True
        part = sure or named
        if name in CONTENT and not self._out and not part and home < 0:
            home = self.contents
            self.contents += 1
        if name in NEVER or name == "header" and home < 0:
            part = sure = True
        if name in ("html", "body") or name in CONTENT and home >= 0 and self._home() < 0:
            part = loose = False
        loose = loose and not part and home < 0
        if loose and not self._out:
            self.tokens.append(("loose", name, 1, -1, home))
        shown = not self._out
        if name not in VOID:
            self._push(name, part, home, part and not sure, loose)
        if block and shown:
            self._cut()
        if self._out <= part:
            self.tokens.append(("tag", name, 1, -1, home))

    def _close(self, name: str) -> None:
        if not self._names[name]:
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                before = self._out
                self._close_to(k)
                if name in BLOCKS and not self._out:
                    self._cut()
                if not before:
                    self.tokens.append(("tag", "/" + name, 1, -1, self._home()))
                return

    def _text(self, text: str) -> None:
        text = entities.unescape(text)
        self.blocks[-1].append(text)
        n = len(text.split())
        if n:
            k = self._stack[-1][6] if self._stack else -1
            near = self._stack[k][0] if k >= 0 else "body"
            self.tokens.append(("word", near, n, len(self.blocks) - 1, self._home()))

    def _read(self, page: str) -> None:
        at = 0
        while m := _TOKEN.match(page, at):
            at = m.end()
            if m[4] is not None:
                if not self._out:
                    self._text(m[4])
            elif m[2]:
                name = m[2].lower()
                if m[1]:
                    self._close(name)
                elif name in RAW:
                    if not (m[3] or "").rstrip().endswith("/"):
                        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                        at = end.end() if end else len(page)
                elif name == "br":
                    if not self._out:
                        self.blocks[-1].append(" ")
                else:
                    self._open(name, m[3] or "")

    def text(self, words: dict[str, float], tags: dict[str, float], other: tuple[float, float]) -> str:
        best, a, b = _best_region(self.tokens, words, tags, other)
        if best <= 0:
            return ""
        used = {t[3] for t in self.tokens[a:b] if t[0] == "word"}
        homes = {t[4] for t in self.tokens[a:b] if t[0] == "word"}
        inside = {h for h in homes if h >= 0}
        if inside:   # the whole content element, and nothing beside it
            keep = [k for k, h in enumerate(self.homes) if h in inside]
        else:
            keep = sorted(used)
        lines = (" ".join("".join(self.blocks[k]).split()) for k in keep)
        return "\n".join(x for x in lines if x)


def _feature(name: str) -> str:
    """The name under which a kind of element is counted and scored."""
    return name if name.lstrip("/") in BLOCKS or name in ("a", "/a") else "other"


def _best_region(tokens, words, tags, other) -> tuple[float, int, int]:
    """Highest total and the range of tokens that has it (the first, shortest one)."""
    best = total = 0.0
    a = b = start = 0
    for k, (kind, feature, n, _, _) in enumerate(tokens):
        if kind == "loose":
            total -= LOOSE_COST
        else:
            total += words.get(_feature(feature), other[0]) * n if kind == "word" else tags.get(_feature(feature), other[1])
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, a, b = total, start, k + 1
    return best, a, b


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for page in batch.column(0):
            p = Page(page.as_py() or "")
            if p.contents:
                for kind, feature, n, _, home in p.tokens:
                    if kind == "loose":
                        continue
                    seen[kind, _feature(feature), home >= 0] += n
        rows = [(k, f, inside, n) for (k, f, inside), n in sorted(seen.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["kind", "feature", "inside", "n"])


def learn_weights(pages: DataFrame, html: str = "html", sample: int = SAMPLE):
    """Scores of words and costs of tags, from the ``sample`` distinct labelled
    pages that come first by the hash of their html. Only hashes and row
    identities are ordered, and of them those below a bound that the number
    of distinct ones gives; the pages chosen are fetched by their identity."""
    ship_code(pages.sparkSession)
    rows = numbered(pages.select(F.col(html).alias("html")))
    marks = landed(rows.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
                   .select(F.xxhash64("html").alias("h"), "_row"), "labelled")
    distinct = marks.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = min(1.0, 2 * sample / max(distinct, 1))      # twice as many as needed, so the estimate's error is covered
    bound = min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63)
    chosen = marks.filter(F.col("h") <= bound).groupBy("h").agg(F.min("_row").alias("_row")).orderBy("h").limit(sample)
    labelled = rows.join(F.broadcast(chosen.select("_row")), "_row", "left_semi").select("html")   # ``sample`` rows
    counts = labelled.mapInArrow(_count_pages, "kind string, feature string, inside boolean, n long") \
        .groupBy("kind", "feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
                                        F.sum("n").alias("n")).collect()
    words = {r.feature: (r.inside + 0.01) / (r.n + 0.02) for r in counts if r.kind == "word"}
    tags = {r.feature: -TAG_COST * (r.n - r.inside + 0.01) / (r.n + 0.02) for r in counts if r.kind == "tag"}
    return words, tags, (words.get("p", 1.0) if words else 1.0, -0.5)


def main_text(pages: DataFrame, weights, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text and ``n_chars``, its code points."""
    ship_code(pages.sparkSession)
    words, tags, other = weights

    @F.arrow_udf("string")
    def extract(col: pa.Array) -> pa.Array:
        return pa.array([Page(v.as_py() or "").text(words, tags, other) for v in col], pa.string())

    return pages.withColumn(text, extract(F.col(html))).withColumn("n_chars", F.length(text).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, learn_weights(pages)).drop("html")
