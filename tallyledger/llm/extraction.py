"""Main text of web pages by tree scoring: paragraphs pass points to ancestors, the best container is kept.

Defined results: null or empty html, or html without text, gives empty text; markup that is cut off or never
closed is read as far as it goes; a very long page is read whole, in time that grows with its blocks and their depth; repeated rows are
extracted row by row; an empty table gives no rows; extra columns are ignored. Of containers that score alike the later
one is best, or, without article and main, the outer one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyledger.llm.text import ready_workers, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Elements whose content is no text of the page.
_OPAQUE = _set(
    "script style noscript template textarea title svg iframe object canvas audio video select head annotation"
    " annotation-xml"
)
_VOID = _set("area base br col embed hr img input link meta param source track wbr")
# Elements around the article, never part of it.
_AROUND = _set("nav footer aside form button dialog menu fieldset")
_BLOCKS = _set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    " caption"
)
_HEADINGS = _set("h1 h2 h3 h4 h5 h6")
# An open element of the left kind ends where one of the right kinds begins.
_ENDS = {
    "li": _set("li"),
    "dt": _set("dt dd"),
    "dd": _set("dt dd"),
    "tr": _set("tr tbody thead tfoot"),
    "td": _set("td th tr tbody thead tfoot"),
    "th": _set("td th tr tbody thead tfoot"),
}
_SCOPES = _set("table ul ol dl menu")
# Parts of class and id names of what surrounds an article, and of what may hold it all the same.
_UNLIKELY = _set(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary"
    " consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation"
    " newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion"
    " recommended related replies reply respond rail share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription teaser toolbar widget copyright legal responses discussion"
)
_LIKELY = _set("article body content entry main post story text")
# Beside such a part a name inside an article still says what surrounds it: ad-slot, share-bar; not social-history.
_LAYOUT = _set(
    "area bar block bottom box button buttons container count embed form group holder icon icons inline inner item items"
    " left link links list module outer panel posts right row section site slot stories top unit widget wrap wrapper zone"
) | _LIKELY
# Inside an article these can name its own parts; an id is mostly an anchor of its topic.
_OWN_CLASSES = _set("header masthead")
_OWN_IDS = _OWN_CLASSES | _set(
    "banner commentary copyright disclaimer discussion legal menu menus notice notices notification notifications promotion"
    " rail recommended related reply respond responses skip social sponsor sponsors subscription"
)
_ROLES = _set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar")
_PARAGRAPHS = _HEADINGS | _set("p pre li blockquote td dd")
_PARAGRAPH = 25  # fewer characters earn no points
# A container with this share of its characters inside links is no part of the article.
MOST_LINKED = 0.25
_TELLING = _PARAGRAPHS - _HEADINGS
# Parts of a page without article and main that belong to the text beside them, however short.
_PARTS = _set("section ul ol dl table pre blockquote figure")


def _surrounding(token: str, own: frozenset[str], in_article: bool) -> bool:
    """Whether one class or id inside article or main is made up of what surrounds an article and of layout words only."""
    parts = {x.lower() for x in _NAME_PART.findall(token)}
    unlikely = _UNLIKELY - own
    return bool(parts & unlikely) and parts <= unlikely | _LAYOUT and (in_article or not parts & _LIKELY)


class _Page:
    """Elements by number with parent and tag; blocks of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.out = [-1], ["html"], [False]
        self.stack = [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._text: list[str] = []
        self._linked: list[str] = []
        self._links = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self.stack[-1] if self._at is None else self._at, text, len(" ".join("".join(self._linked).split()))))
        self._text, self._linked, self._at = [], [], None

    _at: int | None = None

    def _say(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if self._at is None and not text.isspace():
            self._at = self._holder()
        self._text.append(text)
        if self._links:
            self._linked.append(text)

    def _holder(self) -> int:
        """The innermost open block."""
        return next((k for k in reversed(self.stack) if self.tag[k] in _BLOCKS), 0)

    def _close_to(self, depth: int) -> None:
        for k in self.stack[depth:]:
            if self.tag[k] == "a":
                self._links -= 1
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self._flush()
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[depth]]
                if name == "p" or tag in _ENDS.get(name, ()) or tag in _HEADINGS and name in _HEADINGS:
                    self._close_to(depth)
                elif name in _BLOCKS and (name in _SCOPES or name not in _ENDS):
                    break
        if tag == "br":
            self._say(" ")
        if tag in _VOID:
            return
        if tag == "a" and self._links:
            depth = next(d for d in range(len(self.stack) - 1, -1, -1) if self.tag[self.stack[d]] == "a")
            if not any(self.tag[k] in _BLOCKS for k in self.stack[depth:]):
                self._close_to(depth)
        parent = self.stack[-1]
        self.parent.append(parent)
        self.tag.append(tag)
        self.out.append(self.out[parent] or self._surrounds(tag, attributes))
        self.stack.append(len(self.tag) - 1)
        self._links += tag == "a"

    def _surrounds(self, tag: str, attributes: str) -> bool:
        if tag in _AROUND:
            return True
        holders = {self.tag[k] for k in self.stack} & {"article", "main"}
        if tag in ("header", "label"):
            return not holders
        if not attributes or tag in ("html", "body", "main"):
            return False
        unlikely, parts = False, set()
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if name == "role" and value.lower() in _ROLES:
                return True
            if name in ("class", "id") and holders:
                own = _OWN_IDS if name == "id" else _OWN_CLASSES
                unlikely |= any(_surrounding(token, own, "article" in holders) for token in value.split())
            elif name in ("class", "id"):
                parts.update(x.lower() for x in _NAME_PART.findall(value))
        if holders:
            return unlikely
        return bool(parts & _UNLIKELY) and (tag not in ("article",) or "comment" in parts) and not parts & _LIKELY

    def _close(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._flush()
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[depth]]
            if name == tag:
                self._close_to(depth)
                return
            if tag not in _BLOCKS and name in _BLOCKS:
                return  # a stray end of an inline element does not end blocks

    def _read(self, source: str) -> None:
        at = 0
        while found := _TOKEN.search(source, at):
            self._say(source[at : found.start()])
            at = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            tag = name.lower()
            if closing:
                self._close(tag)
            elif tag == "head":
                continue
            elif tag in _OPAQUE:
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
                if not (attributes or "").rstrip().endswith("/"):
                    at = end.end() if end else len(source)
            else:
                self._open(tag, attributes or "")
        self._say(source[at:])

    def above(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.parent[element]


def _menus(page: _Page, blocks: list[tuple[int, str, int]]) -> set[int]:
    """Lists of three entries or more that are nothing but links."""
    entries: dict[int, list[bool]] = {}
    for element, text, linked in blocks:
        for k in page.above(element):
            if page.tag[k] in ("ul", "ol"):
                entries.setdefault(k, []).append(linked >= len(text))
                break
    return {k for k, linked in entries.items() if len(linked) >= 3 and all(linked)}


def _up_to(page: _Page, element: int, last: int) -> Iterator[int]:
    for k in page.above(element):
        yield k
        if k == last:
            return


def _is_prose(text: str) -> bool:
    """A paragraph that earns points, or a short one that ends like a sentence."""
    return len(text) >= _PARAGRAPH or text.endswith((".", "!", "?", "…", ":"))


def main_text(source: str) -> str:
    """The article's blocks in page order, joined by an empty line."""
    page = _Page(source)
    blocks = [b for b in page.blocks if not page.out[b[0]]]
    menus = _menus(page, blocks)
    blocks = [b for b in blocks if not any(k in menus for k in page.above(b[0]))]
    if not blocks:
        return ""
    score: dict[int, float] = {}
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    for element, text, linked in blocks:
        # A paragraph passes points to what holds it; text that stands in a container by itself, to that container.
        first = page.parent[element] if page.tag[element] in _PARAGRAPHS else element
        points = 1 + text.count(",") + min(len(text) // 100, 3) if len(text) >= _PARAGRAPH else 0
        for k in page.above(element):
            size[k] = size.get(k, 0) + len(text)
            links[k] = links.get(k, 0) + linked
        for level, k in enumerate(page.above(max(first, 0))):
            score[k] = score.get(k, 0) + points / (1, 2)[level] if level < 2 else score.get(k, 0) + points / (3 * level)
    worth = {k: s * (1 - links[k] / size[k]) for k, s in score.items()}
    best = max(worth, key=lambda k: (worth[k], k))
    # The outermost article around the best container, or the main element around it, is the whole of it.
    around = list(page.above(best))
    whole = next((k for k in reversed(around) if page.tag[k] == "article"), None)
    main = next((k for k in around if page.tag[k] == "main"), None)
    if whole is not None:
        path = around[around.index(whole) :]
        path = set(path[: path.index(main) + 1] if main in path else path)
        inside = main if main in path else 0
        kept = {whole} | {
            k
            for k in size
            if page.tag[k] == "article" and links[k] < MOST_LINKED * size[k] and inside in page.above(k)
        }
    elif main is not None:
        whole, path, kept = main, {main, page.parent[main]}, {main}
    else:
        # Without one, an outer container that is worth as much holds more of the article.
        best = max(worth, key=lambda k: (worth[k], -k))
        path, kept = set(page.above(best)), {best}
    # What stands beside any container around the best one is judged by its links.
    said: dict[int, list[tuple[int, str, int]]] = {}
    for block in blocks:
        below = None
        for k in page.above(block[0]):
            if k in path:
                break
            below = k
        if below is not None and k in path and k not in kept:
            said.setdefault(below, []).append(block)
    titled = any(page.tag[e] == "h1" and kept & set(page.above(e)) for e, _, _ in blocks)
    for k, texts in said.items():
        if page.tag[k] in _HEADINGS:
            kept.add(k)
            continue
        if sum(n for _, _, n in texts) >= MOST_LINKED * sum(len(t) for _, t, _ in texts):
            continue
        told = any(page.tag[e] in _TELLING and n < MOST_LINKED * len(t) and _is_prose(t) for e, t, n in texts)
        if whole is None:
            most = max(worth.get(e, 0) for element, _, _ in texts for e in _up_to(page, element, k))
            told = told or page.tag[k] in _PARTS or most > 0 and most >= worth[best] / 5
        if told or not titled and any(page.tag[e] == "h1" for e, _, _ in texts):
            kept.add(k)
    return "\n\n".join(text for element, text, _ in blocks if any(k in kept for k in page.above(element)))


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text of every page."""
    ready_workers(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py() or "") for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("url"), texts], [key, "url", "text"])

    return pages.select(key, "url", "html").mapInArrow(run, f"`{key}` {kind}, url string, text string")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).selectExpr(
        "page_id", "url", "text", "CAST(length(text) AS bigint) AS n_chars"
    )
