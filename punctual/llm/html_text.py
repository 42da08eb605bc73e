"""Main text of web pages, by site style trees.

The pages of a host are merged into one tree of elements, named by tag and class. An element's
importance has two parts: how differently it is built from page to page (the entropy of its
children's sequences), and how much what stands below it differs (one less the entropy of each
block's text over the pages that hold it). Elements that are alike on most pages are templates,
and a page loses the branches under them. What markup itself declares to be no article (menus,
footers, forms, adverts ...) goes before the tree is built, and pages that declare an article
are read inside it only. Near copies (revisions, print versions) count as one page, and no page
loses all its text to its host's templates.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.components import components
from punctual.llm.store import stored

#: Weight of content against presentation, importance below which a branch goes, and pages that it takes to tell.
CONTENT, LEAST, PAGES = 0.9, 0.3, 4
#: Least hashes by which near copies meet, and the Jaccard of their main blocks from which on they are such.
HASHES, NEAR = 8, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements that part blocks; all others are inside their block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul caption button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element closes.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
IN_LINE = frozenset("button label select option".split())
DECLARED = frozenset("nav footer aside form button select dialog menu search fieldset head option label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that tell of no article.
SIGNS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|"
    r"masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|"
    r"recommended|comments?|commentlist|replies|reply|respond|disqus|widget|pagination|pager|login|signup|signin|skip|toolbar|toc|hidden)(?:$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|\s)(?:article|article-?body|post-?content|entry-?content|article-?content|story-?body|main-?content)(?:$|\s)", re.I)


class Page:
    """Blocks of a page, and the elements they stand in."""

    def __init__(self, source: str):
        #: Of each block: its text, path of element names, and whether it stands in a declared article.
        self.blocks: list[tuple[str, tuple[str, ...], int]] = []
        #: Path and children of each element that closed.
        self.elements: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
        self._stack: list[tuple[str, str, bool, int, list[str]]] = []
        self._text: list[str] = []
        for token in TOKEN.finditer(source):
            text = token["text"]
            if text is not None:
                self._text.append(text)
            elif token["tag"]:
                tag = token["tag"].lower()
                if tag == "br" or tag in VOID and tag != "hr":
                    self._text.append(" ")
                elif tag in BLOCKS:
                    if token["end"]:
                        self._close(tag)
                    else:
                        self._open(tag, token["rest"])
        self._flush()
        while self._stack:
            self._pop()

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text = []
        if text and not (self._stack and self._stack[-1][2]):
            path = tuple(entry[1] for entry in self._stack)
            self.blocks.append((text, path, self._stack[-1][3] if self._stack else 0))

    def _pop(self) -> None:
        self._flush()
        path = tuple(entry[1] for entry in self._stack)
        _, _, noise, _, children = self._stack.pop()
        if not noise:
            self.elements.append((path, tuple(children)))

    def _open(self, tag: str, rest: str) -> None:
        self._flush()
        if tag == "hr":
            return
        tags = [entry[0] for entry in self._stack]
        if tag not in IN_LINE and "p" in tags:
            self._close("p")
        for other in CLOSES.get(tag, ()):
            tags = [entry[0] for entry in self._stack]
            if other in tags and not any(x in ("ul", "ol", "dl", "table") for x in tags[len(tags) - 1 - tags[::-1].index(other) :]):
                self._close(other)
        facts = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(rest)}
        label = " ".join(filter(None, (facts.get("class"), facts.get("id"))))
        within, noise = (self._stack[-1][3], self._stack[-1][2]) if self._stack else (0, False)
        if tag == "article" or facts.get("itemprop") == "articleBody":
            own = 2
        elif tag == "main" or facts.get("role") == "main" or ARTICLE.search(label):
            own = 1
        else:
            own = 0
        noise = noise or tag in DECLARED or facts.get("role", "").lower() in ROLES or facts.get("aria-hidden") == "true"
        noise = noise or bool(re.search(r"(?:^|\s)hidden(?:$|[\s=])", rest)) or "display:none" in facts.get("style", "").replace(" ", "")
        if not noise and tag not in ("html", "body"):
            noise = bool(SIGNS.search(label)) or within < 1 and own == 0 and (tag == "header" or bool(HEADER.search(label)))
        first = (facts.get("class") or "").split()
        name = f"{tag}.{first[0]}" if first else tag
        if self._stack:
            self._stack[-1][4].append(name)
        self._stack.append((tag, name, noise, max(own, within), []))

    def _close(self, tag: str) -> None:
        if any(entry[0] == tag for entry in self._stack):
            while True:
                last = self._stack[-1][0]
                self._pop()
                if last == tag:
                    return
        else:
            self._flush()

    def candidates(self) -> list[tuple[str, tuple[str, ...], int]]:
        """Blocks of the strongest declaration that the page makes."""
        most = max((block[2] for block in self.blocks), default=0)
        return [block for block in self.blocks if block[2] == most]


def _code(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def _ancestors(path: tuple[str, ...]) -> list[int]:
    """Codes of the element paths from the outermost to the block's own."""
    return [_code(*path[:n]) for n in range(1, len(path) + 1)]


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return found[1].lower() if found else ""


def _main(blocks: list[tuple[str, tuple[str, ...], int]]) -> list[tuple[str, tuple[str, ...], int]]:
    """Blocks under the element that holds most text itself."""
    sizes: dict[tuple[str, ...], int] = {}
    for text, path, _ in blocks:
        sizes[path[:-1]] = sizes.get(path[:-1], 0) + len(text)
    most = max(sizes, key=sizes.__getitem__)
    return [block for block in blocks if block[1][:-1] == most]


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and element: the distinct styles and block texts, by code; and the page's main blocks (``is_text`` null)."""
    for batch in batches:
        rows: list[tuple] = []
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            blocks = page.candidates()
            if not blocks:
                continue
            host, own = host_of(url), _code(host_of(url), *sorted({text for text, _, _ in blocks}))
            rows.append((host, own, tuple(sorted({_code("text", text) for text, _, _ in _main(blocks)})), 0, None))
            rows += {(host, own, tuple(_ancestors(path)), _code("text", text), True) for text, path, _ in blocks}
            rows += {(host, own, (_code(*path),), _code("style", *children), False) for path, children in page.elements}
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(x) for x in column] if i == 2 else column, kind) for i, (column, kind) in enumerate(zip(columns, kinds, strict=True))],
            names=["host", "page", "path", "feature", "is_text"],
        )


def _near_copies(sets: DataFrame) -> DataFrame:
    """``page``, ``root`` of the pages that are near copies of another page of their host.

    Pages meet by least hashes of their main blocks; each is compared with one page of a meeting.
    """
    codes = F.col("path").alias("codes")
    least = [F.xxhash64("host", F.lit(k), F.array_min(F.transform("codes", lambda c, k=k: F.xxhash64(c, F.lit(k))))) for k in range(HASHES)]
    keys = sets.select("host", "page", codes).select("page", "codes", F.explode(F.array(*least)).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("page").alias("hub"), F.min_by("codes", "page").alias("hub_codes"), F.count("*").alias("met"))
    met = keys.join(hubs.where("met > 1").drop("met"), "key").where("page <> hub")
    near = F.size(F.array_intersect("codes", "hub_codes")) >= NEAR * F.size(F.array_union("codes", "hub_codes"))
    return components(met.where(near).select(F.col("page").alias("a"), F.col("hub").alias("b"))).toDF("page", "root")


def style_tree(pages: DataFrame) -> DataFrame:
    """``host``, ``element``, ``pages``, ``importance`` (0 to 1) of each element of each host's tree.

    Copies and near copies count as one page, so they do not make an article look like a template.
    Everything is counted by partial aggregates; a host's size is no matter.
    """
    seen = pages.select("url", "html").mapInArrow(_surveyed, "host string, page long, path array<long>, feature long, is_text boolean")
    seen = stored(seen.distinct(), "survey")
    copies = _near_copies(seen.where("is_text is null"))
    seen = seen.where("is_text is not null").join(copies, "page", "left").withColumn("page", F.coalesce("root", "page")).drop("root")
    element = F.element_at("path", -1).alias("element")
    spread = seen.select("host", "page", "path", element, "feature", "is_text").distinct()
    spread = spread.groupBy("host", "path", "element", "feature", "is_text").agg(F.count("*").alias("pages"))
    total = seen.select("host", "page", F.explode("path").alias("element")).distinct().groupBy("host", "element").agg(F.count("*").alias("all_pages"))
    # Entropy of a text found on n of m pages alike is log n to the base m.
    texts = spread.where("is_text").select("host", "pages", "feature", element, F.explode("path").alias("above"))
    texts = texts.join(total, ["host", "element"]).groupBy("host", F.col("above").alias("element")).agg(
        (F.sum(F.col("pages") * F.when(F.col("all_pages") > 1, 1 - F.log("pages") / F.log("all_pages")).otherwise(1.0)) / F.sum("pages")).alias("content")
    )
    styles = spread.where("not is_text").join(total, ["host", "element"]).groupBy("host", "element").agg(
        F.sum(F.when(F.col("all_pages") > 1, -F.least(F.col("pages") / F.col("all_pages"), F.lit(1.0))
                     * F.log(F.least(F.col("pages") / F.col("all_pages"), F.lit(1.0))) / F.log("all_pages")).otherwise(1.0)).alias("style")
    )
    return total.join(texts, ["host", "element"], "left").join(styles, ["host", "element"], "left").select(
        "host", "element", F.col("all_pages").alias("pages"),
        (CONTENT * F.coalesce("content", F.lit(1.0)) + (1 - CONTENT) * F.least(F.coalesce("style", F.lit(0.0)), F.lit(1.0))).alias("importance"),
    )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed = [], []
        for source, templates in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            blocks = Page(source or "").candidates()
            kept = blocks
            if templates:
                gone = set(templates)
                kept = [block for block in blocks if gone.isdisjoint(_ancestors(block[1]))]
                if blocks and not kept:
                    # No declared article goes as a whole, and no page's last content.
                    kept = blocks if blocks[0][2] == 2 else _main(blocks)
            texts.append("\n\n".join(text for text, _, _ in kept))
            removed.append(len(blocks) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_removed"],
        )


def main_text(pages: DataFrame, least: float = LEAST, enough: int = PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_removed`` (blocks under template branches) of each page.

    A branch is a template if its importance is under ``least`` over ``enough`` different pages
    of its host or more, near copies taken as one. If all of a page would go, a declared article
    stays whole, and of other pages the blocks of the element with most text. Null, empty or tag-only pages have an empty text; broken markup is read
    as browsers do: open elements end where another block must begin. A url without a host
    belongs to the host of no name. Each row has its own result, repeated rows and null ids
    included; an empty table gives no rows; other columns are not read. Pages are read whole.
    The element codes sent to a host's pages are those of its templates, not of its pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    templates = style_tree(rows).where((F.col("importance") < least) & (F.col("pages") >= enough))
    templates = stored(templates.groupBy("host").agg(F.collect_set("element").alias("templates")), "templates")
    pattern = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
    hosts = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), pattern, 1))
    met = rows.withColumn("_host", hosts).join(templates.withColumnRenamed("host", "_host"), "_host", "left")
    return met.select("page_id", "url", "html", "templates").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long, n_removed long"
    )
