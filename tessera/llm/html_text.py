"""Main text of web pages: flat text blocks, shallow features, and a decision tree trained here."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements within a text block; all others end it.
INLINE = frozenset("""
a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em embed font i img ins kbd label mark object q rp rt ruby s samp small span strike strong
sub sup time tt u var video wbr svg g text tspan math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, styles, the page's name, and what a form offers.
RAW = frozenset("script style template title textarea select datalist".split())
BOILER_TAGS = frozenset("nav footer header aside form button menu dialog fieldset address".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of which the names of boilerplate are made: one of the first, and else only of the first and second.
BOILER_WORDS = frozenset("""
ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs
header masthead topbar foot footer sidebar sidebars side aside widget widgets related share shares sharing social comment comments commentlist respond reply replies
disqus discussion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login search copyright legal pagination pager skip toolbar hidden
""".split())
PLAIN_WORDS = frozenset("""
main site page global top bottom left right list lists item items box boxes bar bars wrap wrapper container inner outer section block area group holder row col content body
link links post posts article articles story stories entry entries text message messages form panel button buttons icon icons title heading bg primary secondary mobile desktop
""".split())
MAIN_WORDS = frozenset("article articlebody content main post postbody entry story storybody".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alertdialog": -1, "alert": -1, "main": 1, "article": 1}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    #: 1, -1: the nearest element that says what it is is main text, boilerplate; 0: none does.
    standing: int
    boiler: bool
    heading: bool
    item: bool


def _named(value: str) -> tuple[int, int]:
    """(main, boiler) of a class or id: names of which every part is known."""
    main = boiler = 0
    for name in value.split():
        parts = [x.lower() for x in _PARTS.findall(name) if not x.isdigit()]
        ours = BOILER_WORDS.intersection(parts)
        if ours and all(x in BOILER_WORDS or x in PLAIN_WORDS or x in MAIN_WORDS for x in parts):
            boiler = 1
        elif parts and all(x in MAIN_WORDS or x in ("text", "body", "the", "single", "main") for x in parts) and MAIN_WORDS.intersection(parts):
            main = 1
    return main, boiler


def _hint(tag: str, attributes: str) -> int:
    """1: the element says that it holds main text, by its tag, role, class or id; -1: boilerplate; 0: neither."""
    main, boiler = int(tag in MAIN_TAGS), int(tag in BOILER_TAGS)
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                side = ROLES.get(value.strip().lower(), 0)
                main, boiler = max(main, side > 0), max(boiler, side < 0)
            elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                boiler = 1
            elif name in ("class", "id"):
                main, boiler = map(max, (main, boiler), _named(value))
    return -1 if boiler else int(main)


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order: runs of text between block-level tags, without code, styles and the page's name."""
    page = page or ""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, what it says, what was said around it
    opened: dict[str, int] = {}  # how many of a tag are in the stack
    standing = in_boiler = in_link = heading = at = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                words = len(line.split(" "))
                out.append(Block(line, words, min(words, len(html.unescape(" ".join(linked)).split())), standing, in_boiler > 0, heading > 0, bool(opened.get("li"))))
            text, linked = [], []

    def push(tag: str, says: int) -> None:
        nonlocal standing, in_boiler
        stack.append((tag, says, standing))
        opened[tag] = opened.get(tag, 0) + 1
        standing = says or standing
        in_boiler += says < 0

    def close(tag: str) -> None:
        """Take elements off the stack down to the last open one of this tag."""
        nonlocal standing, in_boiler
        name = ""
        while opened.get(tag) and name != tag:
            name, says, standing = stack.pop()
            opened[name] -= 1
            in_boiler -= says < 0

    while True:
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text.append(page[at:end])
            if in_link:
                linked.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW:
            if tag not in INLINE:
                flush()
            if not attributes.rstrip().endswith("/"):
                end_tag = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end_tag.end() if end_tag else (len(page) if tag != "template" else at)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            text.append(" ")
        if tag in INLINE:  # on the stack only where its text isn't of the block around it
            if closing:
                if opened.get(tag):
                    flush()
                    close(tag)
            elif attributes and tag not in VOID and _hint(tag, attributes) < 0:
                flush()
                push(tag, -1)
            elif opened.get(tag):
                push(tag, 0)
            continue
        flush()
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
            heading = 0 if closing else 1
        if tag in VOID:
            continue
        if not closing:
            if tag in ("p", "li", "tr", "td", "th", "dd", "dt") and stack and stack[-1][0] == tag:  # end tags that may be left out
                close(tag)
            if not attributes.endswith("/"):
                push(tag, _hint(tag, attributes))
        else:
            close(tag)
    flush()
    return out


FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "before", "after", "standing", "in_boiler", "heading", "item")
#: Blocks on either side among which "before" and "after" look for the longest run of words that aren't links.
NEAR = 4


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: its own and its neighbours' word count and link density, the longest prose near it, and what
    its elements say."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    linked = np.array([b.linked for b in page], float)
    density = linked / words

    def at(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(x))
        if by < 0:
            out[-by:] = x[:by]
        else:
            out[: len(x) - by] = x[by:]
        return out

    prose = words - linked
    before = np.max([at(prose, -k) for k in range(1, min(NEAR, len(page)) + 1) if k < len(page)] or [np.zeros(len(page))], axis=0)
    after = np.max([at(prose, k) for k in range(1, min(NEAR, len(page)) + 1) if k < len(page)] or [np.zeros(len(page))], axis=0)
    next_to = lambda x, by: at(x, by) if len(page) > 1 else np.zeros(1)
    said = [np.array([getattr(b, name) for b in page], float) for name in ("standing", "boiler", "heading", "item")]
    return np.stack([words, density, next_to(words, -1), next_to(density, -1), next_to(words, 1), next_to(density, 1), before, after, *said], axis=1)


#: The labelled table: parts of pages, written for this purpose. "+" begins a block of the main text, "-" any other;
#: ~9 stands for nine words. A page is a top, one or two notes, a body, what follows it, and an end.
TOPS = [
    "<nav><ul><li><a>- ~1</a></li><li><a>- ~1</a></li><li><a>- ~2</a></li></ul></nav>", "<header><div>- ~3</div><nav><a>- ~1</a><a>~1</a></nav></header>", "<div><a>- ~1</a> <a>~1</a> <a>~2</a></div>",
    "<div id=menu><a>- ~1</a></div><div class=breadcrumbs>- ~4</div>", "<div><ul><li>- ~1</li><li>- ~2</li><li>- ~1</li></ul></div>", "<p>- ~1</p><p>- ~1</p>", "<ul><li><a>- ~2</a></li><li><a>- ~1</a></li><li><a>- ~3</a></li><li><a>- ~2</a></li></ul>",
    "<header>- ~18</header>", "<table><tr><td><a>- ~1</a></td><td><a>- ~2</a></td><td><a>- ~2</a></td></tr></table>", "", "<div>- ~2</div><div><a>- ~3</a></div>",
    "<ul><li>- ~1</li><li>- ~2</li></ul>", "<div>- ~2</div><ul><li>- ~3</li><li>- ~2</li><li>- ~2</li><li>- ~1</li></ul>", "<ul><li>- ~2</li><li>- ~2</li><li>- ~4</li></ul>",
]
NOTES = [
    "", "", "<div class=ad>- ~9</div>", "<div class='cookie-notice'>- ~20</div>", "<aside>- ~5 <a>~3</a></aside>", "<div><a>- ~6</a></div><div><a>- ~8</a></div>", "<form>- ~3 <button>- ~1</button></form>", "<div class=ad-banner>- ~30</div>",
    "<div class=sidebar><h3>- ~2</h3><p>- ~12</p><ul><li><a>- ~5</a></li><li><a>- ~6</a></li></ul></div>", "<div role=alert>- ~14</div>", "<div class=widget><a>- ~4</a> - ~1</div>",
]
BODIES = [
    "<article><h1>+ ~5</h1><p>+ ~40</p><p>+ ~2</p><p>+ ~25</p></article>", "<article><h1>+ ~2</h1><p>+ ~3</p><p>+ ~1</p></article>", "<main><h2>+ ~3</h2><p>+ ~9 <a>~1</a> ~4</p><ul><li>+ ~2</li><li>+ ~1</li></ul><p>+ ~30</p></main>",
    "<article><header><h1>+ ~6</h1><p>- ~5</p></header><p>+ ~35</p><aside>- ~15</aside><p>+ ~20</p><footer>- ~6</footer></article>", "<div><h1>+ ~6</h1><p>+ ~45</p><p>+ ~30</p><p>+ ~5</p><p>+ ~38</p></div>",
    "<p>+ ~40</p><p>+ ~22</p><p>+ ~31</p>", "<div class=content><p>+ ~12</p><p><a>+ ~9</a></p><p>+ ~6</p></div>", "<div><p>+ ~50</p><ul><li>+ ~6</li><li>+ ~9</li><li>+ ~2</li></ul><p>+ ~26</p></div>",
    "<article><p>+ ~28</p><p>+ <a>~1</a> ~1 <a>~1</a></p><p>+ ~33</p><blockquote>+ ~11</blockquote><p>+ ~1</p></article>", "<div class=widget><article><p>+ ~36</p><p>+ ~44</p></article></div>", "<main><p>+ ~1</p><p>+ ~1</p></main>",
    "<div><h2>+ ~4</h2><p>+ ~60 <a>~4</a> ~20</p><h2>+ ~3</h2><p>+ ~35</p><p>+ ~2</p><p>+ ~41</p></div>", "<table><tr><td>+ ~40<br>~30</td></tr><tr><td>+ ~25</td></tr></table>", "<div class=story><h1>+ ~3</h1><p>+ ~4</p><div class=ad>- ~7</div><p>+ ~5</p></div>",
    "<article><h1>+ ~7</h1><ul><li><a>+ ~4</a></li><li>+ ~5 <a>~2</a></li></ul><p>+ ~18</p></article>", "<div><p>+ ~33</p><div><a>- ~5</a></div><p>+ ~29</p></div>", "<div><h1>+ ~8</h1><p>+ ~24</p><p>+ ~9</p><p>+ ~27</p><p>+ ~7</p><p>+ ~3</p><p>+ ~30</p></div>",
]
FOLLOWS = [
    "", "", "<section class=comments><h3>- ~1</h3><p>- ~25</p><p>- ~40</p><p>- ~3</p></section>", "<div id=disqus>- ~30</div>", "<div class='related-posts'><h3>- ~2</h3><ul><li><a>- ~6</a></li><li><a>- ~5</a></li></ul></div>", "<div><h3><a>- ~2</a></h3><a>- ~7</a></div>",
    "<ul class=comment-list><li>- ~18</li><li>- ~33</li></ul>", "<p><a>- ~8</a></p><p><a>- ~6</a></p>", "<aside><article><h4><a>- ~6</a></h4><p><a>- ~10</a></p></article></aside>",
]
ENDS = ["<footer>- ~7</footer>", "<footer><p>- ~20</p><a>- ~1</a></footer>", "<div><a>- ~1</a> <a>~2</a></div>", "<div>- ~3</div>", "<p>- ~1</p>", "", "<div class=copyright>- ~9</div>", "<ul><li><a>- ~1</a></li><li><a>- ~1</a></li></ul>"]
#: Pages of few blocks, as they are.
WHOLE = ["<p>+ ~4</p>", "<p>+ ~13</p>", "+ ~8", "<nav>- ~1</nav>", "<nav><a>- ~2</a></nav><footer>- ~5</footer>", "<div><a>- ~1</a> <a>~1</a></div>", "<h1>+ ~3</h1><p>+ ~9</p>", "<p>+ ~7</p><p>+ ~12</p>", "<div>+ ~16<br>~9</div>", "<div class=ad>- ~8</div>"]
#: Pages that are made of the parts; in each, numbers of nine words and more are multiplied by one of these.
N_PAGES, SCALES = 600, (0.5, 0.8, 1.0, 1.5)


def labelled_pages(seed: int = 4) -> list[str]:
    """Pages of the labelled table: every part with others in turn, in a drawn order, and the whole pages."""
    rng = np.random.default_rng(seed)
    kinds = (TOPS, NOTES, BODIES, FOLLOWS, ENDS)
    orders = [np.concatenate([rng.permutation(len(k)) for _ in range(-(-N_PAGES // len(k)))])[:N_PAGES] for k in kinds]
    made = ["".join(part[k] for part, k in zip(kinds, own, strict=True)) for own in zip(*orders, strict=True)]
    scales = rng.choice(SCALES, N_PAGES).tolist()
    filled = lambda page, by: re.sub("~([0-9]+)", lambda m: " ".join(["word"] * (int(m[1]) if int(m[1]) < 9 else round(int(m[1]) * by))), page)
    return [f"<body>{filled(page, by)}</body>" for page, by in zip(made, scales, strict=True)] + [f"<body>{filled(page, by)}</body>" for page in WHOLE for by in SCALES]


def labelled_rows(seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of all blocks of the labelled pages."""
    rows, labels = [], []
    for page in labelled_pages(seed):
        own = blocks(page)
        labels += [b.text.startswith("+") for b in own]
        for b in own:  # the marks are no words of the page
            marks = sum(x in "+-" for x in b.text.split(" "))
            b.words = max(1, b.words - marks)
            b.linked = min(b.linked, b.words)
        rows.append(features(own))
    return np.concatenate(rows), np.array(labels, float)


@dataclass
class Tree:
    """A binary decision tree; left is "at most"."""

    feature: int = -1
    limit: float = 0.0
    share: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(rows), self.share >= 0.5)
        low = rows[:, self.feature] <= self.limit
        out = np.zeros(len(rows), bool)
        out[low], out[~low] = self.left.predict(rows[low]), self.right.predict(rows[~low])
        return out


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 9, least: int = 4) -> Tree:
    """CART by Gini impurity, leaves of at least so many blocks; ties go to the first feature and lowest limit."""
    share = float(labels.mean())
    whole, best = 2 * share * (1 - share) * len(labels), None
    if depth and 0 < share < 1:
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            x, ones = rows[order, f], np.cumsum(labels[order])
            cut = np.flatnonzero(x[1:] > x[:-1])
            n = cut + 1.0
            cut, n = cut[(n >= least) & (len(x) - n >= least)], n[(n >= least) & (len(x) - n >= least)]
            if len(cut):
                low, high = ones[cut], ones[-1] - ones[cut]
                cost = 2 * low * (1 - low / n) + 2 * high * (1 - high / (len(x) - n))
                k = int(np.argmin(cost))
                if cost[k] < (best[0] if best else whole) - 1e-9:
                    best = (cost[k], f, float(x[cut[k]] + x[cut[k] + 1]) / 2)
    if best is None:
        return Tree(share=share)
    _, f, limit = best
    low = rows[:, f] <= limit
    return Tree(f, limit, share, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


_tree: list[Tree] = []


def trained_tree() -> Tree:
    """Grown once in a process."""
    if not _tree:
        _tree.append(grow(*labelled_rows()))
    return _tree[0]


def main_text(page: str | None, tree: Tree | None = None) -> str:
    own = blocks(page)
    if not own:
        return ""
    keep = (tree or trained_tree()).predict(features(own))
    return " ".join(b.text for b, k in zip(own, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars) of each row, from its whole html.

    Null, empty and text-free html gives an empty text. A page is parsed in one pass in its own row, so long,
    broken and repeated pages are rows like any other, and equal pages get equal texts. Other columns aren't read; keep
    can't hold text or n_chars. No rows: none out.
    """
    kept, tree = pages.select(*keep), trained_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[1:], "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(html_col).cast("string").alias("__html"), *keep).mapInArrow(run, schema)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
