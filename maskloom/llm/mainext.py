"""Main text of web pages: boosted trees over DOM-node features and a consistent choice of nodes.

A page becomes a tree of elements.  Trees boosted in numpy give every element a log-odds of holding
main text from its subtree's density, attribute words, depth and siblings.  Decoding keeps the set of
elements with the greatest sum of log-odds in which no kept element lies under a dropped one.

Labels come from article elements.  The trees learn from copies of the pages under made-up and misleading names and
plain tags, with furniture and content of many kinds set in, so they decide by structure and take names as hints.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe object svg canvas textarea select option".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section "
    "article main header footer nav aside form fieldset figure figcaption address details summary hr dialog menu center".split()
)
CLOSES_P = BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption figcaption summary".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "option": ("option",)}
# Words of class, id and role that name page furniture, and words that name content.
FURNITURE = frozenset(
    "ad ads adv advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay "
    "sidebar side widget aside menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager topbar masthead header "
    "footer foot bottom copyright legal comment comments reply replies respond discussion disqus share sharing social follow "
    "related recommended newsletter subscribe signup login search form tags toc skip complementary contentinfo".split()
)
CONTENT = frozenset("article content main post entry story body text page blog".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog header label input fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_STOP = re.compile("[<>\"']")
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Elements in page order (an element's parent comes before it) and pieces of text."""

    tags: list[str] = field(default_factory=list)
    names: list[frozenset] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # block number, element, text


class Tags:
    """Where tags end.  What does not follow any more is known, so broken html is read once, not once a tag."""

    def __init__(self, source: str):
        self.source = source
        self.last = {mark: source.rfind(mark) for mark in ">\"'"}

    def end(self, at: int) -> int:
        """The ``>`` of the tag whose name ends at ``at``: outside quotes, or the next one where quotes do not close; or -1."""
        place = at
        while (stop := TAG_STOP.search(self.source, place)) is not None:
            mark, here = stop[0], stop.start()
            if mark == ">":
                return here
            if mark == "<" or here >= self.last[mark]:
                break
            place = self.source.find(mark, here + 1) + 1
        return self.source.find(">", at) if at <= self.last[">"] else -1


@functools.cache
def closing_tag(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


def parse(source: str) -> Page:
    """The page's tree.  Unclosed and stray tags are taken as browsers roughly do.

    Time is linear in the source: a stray close tag is known by the number of open elements of its name, and
    what an element pops from the stack is popped once.
    """
    page = Page(["#root"], [frozenset()], [-1], [])
    stack, block, end, tags = [0], 0, len(source), Tags(source)
    open_: Counter = Counter()
    hidden = 0  # depth of hidden elements that are open

    def text(piece):
        if piece and not hidden:
            page.texts.append((block, stack[-1], html.unescape(piece)))

    def pop_to(place):
        nonlocal hidden
        while len(stack) > place:
            tag = page.tags[stack.pop()]
            open_[tag] -= 1
            hidden -= tag in HIDDEN

    at = look = 0  # text not yet taken, and where to look for the next tag
    while (start := source.find("<", look)) >= 0:
        if source.startswith("<!--", start):
            text(source[at:start])
            close = source.find("-->", start + 4)
            at = look = close + 3 if close >= 0 else end
            continue
        if source.startswith(("<!", "<?"), start):
            close = source.find(">", start) if start <= tags.last[">"] else -1
            if close >= 0:
                text(source[at:start])
                at = close + 1
            look = max(start + 1, at)
            continue
        found = TAG.match(source, start)
        close = tags.end(found.end()) if found else -1
        if close < 0:
            look = start + 1
            continue
        text(source[at:start])
        tag, attributes = found[1].lower(), source[found.end():close]
        at = look = close + 1
        if source[start + 1] == "/":
            if open_[tag] > 0:
                for place in range(len(stack) - 1, 0, -1):
                    if page.tags[stack[place]] == tag:
                        pop_to(place)
                        break
            block += tag in BLOCK
            continue
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        closing = ("p",) if tag in CLOSES_P else SAME_LEVEL.get(tag, ())
        if any(open_[other] > 0 for other in closing):
            for place in range(len(stack) - 1, 0, -1):
                open_tag = page.tags[stack[place]]
                if open_tag in closing:
                    pop_to(place)
                    if tag not in ("tr",):
                        break
                elif open_tag in BLOCK and open_tag not in ("p", "td", "th"):
                    break
        block += tag in BLOCK
        words = frozenset(
            w for found in NAMES.findall(attributes) for w in WORDS.findall("".join(found).lower())
        ) if "=" in attributes else frozenset()
        page.tags.append(tag)
        page.names.append(words)
        page.parents.append(stack[-1])
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append(len(page.tags) - 1)
        open_[tag] += 1
        if tag in HIDDEN:
            hidden += 1
        if tag in RAW:
            close = closing_tag(tag).search(source, at)
            at = look = close.start() if close else end
    text(source[at:])
    return page


# Pages scored together.
TOGETHER = 100


def features(page: Page) -> np.ndarray:
    """One row of numbers per element: density of its subtree, words of its attributes, depth, siblings, and how it lies to
    the element with most text in its own paragraphs."""
    count = len(page.tags)
    parents = np.array(page.parents)
    flags = {
        "p": ("p",), "head": HEADINGS, "link": ("a",), "list": ("li", "ul", "ol"), "field": ("input", "button", "form", "label", "textarea", "select"),
    }
    is_p, heads, links, lists, fields = (np.array([t in kinds for t in page.tags], float) for kinds in flags.values())
    chars, marks, pieces, linked = (np.zeros(count) for _ in range(4))
    first = np.full(count, np.inf)
    total = 0
    ups = parents.tolist()
    in_link = [False] * count
    for i in range(1, count):
        in_link[i] = in_link[ups[i]] or page.tags[i] == "a"
    for _, node, text in page.texts:
        size = len(text)
        chars[node] += size
        pieces[node] += not text.isspace()
        marks[node] += text.count(",") + text.count(".")
        linked[node] += size if in_link[node] else 0
        first[node] = min(first[node], total)
        total += size
    own_chars = chars.copy()
    bad_tag = np.array([t in FURNITURE_TAGS for t in page.tags], float)
    good_tag = np.array([t in CONTENT_TAGS for t in page.tags], float)
    bad_name = np.array([len(n & FURNITURE) for n in page.names], float)
    good_name = np.array([len(n & CONTENT) for n in page.names], float)
    # Elements are in page order, so a subtree is a stretch of them and its sums are differences of running sums.
    last, height, children, starts = list(range(count)), [0] * count, [0] * count, first.tolist()
    for i in range(count - 1, 0, -1):
        up = ups[i]
        last[up] = max(last[up], last[i])
        height[up] = max(height[up], height[i] + 1)
        starts[up] = min(starts[up], starts[i])
        children[up] += 1
    first, height, children, child_chars = np.array(starts), np.array(height), np.array(children, float), np.zeros(count)
    running = np.zeros((count + 1, 10))
    np.cumsum(np.stack([chars, marks, pieces, linked, is_p, heads, links, lists, fields, np.ones(count)], axis=1), axis=0, out=running[1:])
    chars, marks, pieces, linked, is_p, heads, links, lists, fields, tags_under = (running[np.array(last) + 1] - running[:-1]).T
    paragraph = np.zeros(count)
    plain_p = np.array([i for i in range(1, count) if page.tags[i] == "p"], int)
    np.add.at(paragraph, parents[plain_p], (chars - linked)[plain_p])
    top = int(paragraph.argmax())
    # Distance to the element with most paragraph text: up from it, down again elsewhere; and which side of it.
    far = [-1] * count
    node, steps = top, 0
    while node >= 0:
        far[node], node, steps = steps, ups[node], steps + 1
    above = np.array(far) >= 0
    order = np.arange(count)
    inside = (order >= top) & (order <= last[top])
    depth, index, seen = [0] * count, [0] * count, [0] * count
    over = [[0] * count for _ in range(4)]
    own = [values.tolist() for values in (bad_tag, good_tag, bad_name, good_name)]
    for i in range(1, count):
        up = ups[i]
        depth[i], index[i] = depth[up] + 1, seen[up]
        seen[up] += 1
        if far[i] < 0:
            far[i] = far[up] + 1
        for values, mine in zip(over, own):
            values[i] = values[up] + mine[up]
    depth, index = np.array(depth), np.array(index)
    np.add.at(child_chars, np.maximum(parents, 0), chars)
    side = np.where(inside | above, 0, np.where(order < top, -1, 1))
    same = Counter((u, t) for u, t in zip(ups, page.tags))
    alike = np.array([same[u, t] for u, t in zip(ups, page.tags)], float)
    safe = np.maximum(chars, 1)
    up = np.maximum(parents, 0)
    whole = max(total, 1)
    return np.stack([
        np.log1p(chars), np.log1p(own_chars), linked / safe, chars / tags_under, marks / safe, pieces, tags_under, height, depth,
        index, children[up], index / np.maximum(children[up], 1), chars / np.maximum(chars[up], 1), chars / whole,
        np.where(np.isfinite(first), first, whole) / whole, is_p, heads, links, lists, fields, fields[up] - fields, alike,
        child_chars[up] / np.maximum(children[up], 1), linked[up] / np.maximum(chars[up], 1), far, above, inside, side,
        chars / np.maximum(chars[top], 1), np.minimum(bad_tag, 2), np.minimum(good_tag, 2), np.minimum(bad_name, 2),
        np.minimum(good_name, 2), *[np.minimum(values, 2) for values in over],
    ], axis=1)


@dataclass
class BoostedTrees:
    """Regression trees on binned features, fitted to the gradient of the logistic loss."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per tree: feature, bin, leaf values

    DEPTH, ROUNDS, RATE, BINS = 4, 40, 0.3, 24

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray) -> "BoostedTrees":
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, cls.BINS)[1:-1])) for f in range(rows.shape[1])]
        bins = np.stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)], axis=1)
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        model = cls(edges, float(np.log(share / (1 - share))), [])
        raw = np.full(len(rows), model.start)
        inner = 2**cls.DEPTH - 1
        for _ in range(cls.ROUNDS):
            chance = 1 / (1 + np.exp(-raw))
            slope, curve = labels - chance, chance * (1 - chance) + 1e-6
            feature, cut = np.zeros(inner, np.int64), np.full(inner, cls.BINS)
            node = np.zeros(len(rows), np.int64)
            for level in range(cls.DEPTH):
                base, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for f in range(rows.shape[1]):
                    code = (node - base) * cls.BINS + bins[:, f]
                    g = np.bincount(code, slope, width * cls.BINS).reshape(width, cls.BINS).cumsum(axis=1)
                    h = np.bincount(code, curve, width * cls.BINS).reshape(width, cls.BINS).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(width), top]
                    better = value > best
                    best = np.where(better, value, best)
                    feature[base:base + width][better] = f
                    cut[base:base + width][better] = top[better]
                node = 2 * node + 1 + (bins[np.arange(len(rows)), feature[node]] > cut[node])
            leaf = node - inner
            values = cls.RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + 1)
            raw += values[leaf]
            model.trees.append((feature, cut, values))
        return model

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(self.edges)], axis=1)
        raw, every = np.full(len(rows), self.start), np.arange(len(rows))
        for feature, cut, values in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.DEPTH):
                node = 2 * node + 1 + (bins[every, feature[node]] > cut[node])
            raw += values[node - len(cut)]
        return np.clip(raw, -6, 6)


def choose(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """Elements kept: the tree from the root with the greatest sum of log-odds."""
    gain = odds.astype(float).copy()
    for i in range(len(parents) - 1, 0, -1):
        if gain[i] > 0:
            gain[parents[i]] += gain[i]
    kept = np.zeros(len(parents), bool)
    kept[0] = True
    for i in range(1, len(parents)):
        kept[i] = kept[parents[i]] and gain[i] > 0
    return kept


def join_blocks(page: Page, kept: np.ndarray) -> str:
    """Kept text, white space within a block made one space, blocks one line each."""
    blocks: dict[int, list[str]] = {}
    for block, node, text in page.texts:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join([line for line in lines if line])


def teach(page: Page) -> np.ndarray | None:
    """Labels from plain page marks: inside an article and outside furniture; none for pages without one."""
    count = len(page.tags)
    inside, wanted = np.zeros(count, bool), np.zeros(count, bool)
    for i in range(1, count):
        up = page.parents[i]
        if page.tags[i] in FURNITURE_TAGS or page.names[i] & FURNITURE:
            continue
        inside[i] = wanted[i] = inside[up] or page.tags[i] in CONTENT_TAGS
    if not wanted.any():
        return None
    for i in range(count - 1, 0, -1):  # what holds main text is on its way
        wanted[page.parents[i]] |= wanted[i]
    return wanted


def variants(source: str, other: str) -> list[tuple[str, bool]]:
    """The page, and copies with furniture and content of many kinds set into and around its article.

    The flag says that every piece of furniture shows by its structure, so its names may change.
    """
    paragraphs = [p for p in re.findall(r"<p>((?:(?!<p>|</p>|</article).)*)", other, re.S) if p.strip()][:6] or ["Text, plain."]
    first, short = paragraphs[0], [" ".join(p.split()[:9]) for p in paragraphs]
    prose = "".join(f"<p>{p}</p>" for p in paragraphs[:3])
    links = [f'<a href="/{i}">{" ".join(p.split()[:2])}</a>' for i, p in enumerate(paragraphs * 3)]
    replies = "".join(
        f'<div class="comment"><b>{p.split()[0]}</b> <span>{i} May</span><p>{p}</p><a href="#r{i}">Reply</a></div>'
        for i, p in enumerate(short[:4])
    )
    plain = [
        f'<div class="menu">{" ".join(links[:3])}</div>', f'<ul class="links">{"".join(f"<li>{x}</li>" for x in links[:6])}</ul>',
        f'<p class="share">{" | ".join(links[:4])}</p>', f'<div class="related"><h4>Related</h4><ul>{"".join(f"<li>{x}</li>" for x in links[2:7])}</ul></div>',
        f'<div class="comments"><h3>Comments</h3>{replies}<form><textarea name="c"></textarea><button>Send</button></form></div>',
        f'<section class="comments">{replies}</section>',
        f'<div class="comments"><h3>{short[0]}</h3>' + "".join(f'<div class="comment"><b>{p.split()[0]}</b><p>{p}</p></div>' for p in short[:4]) + "</div>",
        f'<div class="cookie-notice"><p>{short[-1]}</p><button>OK</button> <button>No</button></div>',
        f'<form class="newsletter"><label>{short[0]}</label><input name="m"><button>Go</button></form>',
    ]
    # These hold prose like the article's own: only names and tags tell.
    named = [
        f'<aside class="sidebar">{prose}</aside>', f'<section id="comments"><ol><li class="comment">{prose}</li></ol></section>',
        f'<div class="ad">{first[:120]}</div>', f'<div class="promo"><p>{first}</p></div>',
    ]
    good = [
        f"<section><h2>{short[0]}</h2>{prose}</section>", f"<ul>{''.join(f'<li>{p}</li>' for p in paragraphs[:3])}</ul>", f"<blockquote>{prose}</blockquote>",
        f"<table><tr><th>{short[0]}</th><td>{short[-1]}</td></tr><tr><td>{first}</td><td>1</td></tr></table>",
        f"<p>{first[:80]} {links[0]} {first[80:]}</p>", f"<p>{short[0]} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {short[-1]}</p>",
        f"<div><div>{prose}</div></div>", f"<figure><img src=i><figcaption>{short[0]}</figcaption></figure>",
    ]
    pick = zlib.crc32(source.encode())
    opened = re.search(r"<article\b[^>]*>", source)
    if opened is None:
        return [(source, True)]
    head, body = source[:opened.start()], source[opened.start():]

    def built(inner, before, after, own):
        parts = re.split(r"(?=<p>)", body)
        middle = 1 + pick % max(len(parts) - 1, 1)
        inside = "".join([*parts[:middle], own, *parts[middle:]]).replace("</article>", inner + "</article>" + after)
        return head + before + inside

    take = lambda pieces, n: pieces[(pick + n) % len(pieces)]
    return [
        (source, False), (built(take(plain, 0), take(plain, 3), take(plain, 5), take(good, 0)), True),
        (built("", take(plain, 1), take(plain, 4), take(good, 3)), True), (built(take(named, 0), take(plain, 6), take(named, 1), take(good, 5)), False),
    ]


MADE_UP = tuple(f"zz{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
LISTED = tuple(sorted(FURNITURE | CONTENT))


def renamed(page: Page, rng: np.random.Generator, furniture_too: bool, wanted: np.ndarray) -> Page:
    """A copy under other names: words become made-up or any listed ones, and telling tags become plain ones.

    So names are hints that often fail, and structure has to decide.  With ``furniture_too`` false the names of what
    is not wanted stay.
    """
    words: dict[str, str] = {}

    def other(word):
        if word not in words:
            chance = rng.random()
            words[word] = str(rng.choice(MADE_UP)) if chance < 0.5 else str(rng.choice(LISTED)) if chance < 0.75 else word
        return words[word]

    tags, names = list(page.tags), list(page.names)
    for i in range(1, len(tags)):
        if not wanted[i] and not furniture_too:
            continue
        names[i] = frozenset(other(w) for w in names[i])
        if not names[i] and rng.random() < 0.1:
            names[i] = frozenset([str(rng.choice(LISTED if wanted[i] else MADE_UP))])
        if tags[i] in CONTENT_TAGS and rng.random() < 0.6 or tags[i] in ("nav", "aside", "header", "footer") and rng.random() < 0.4:
            tags[i] = str(rng.choice(["div", "section"]))
        elif wanted[i] and tags[i] in ("div", "section") and rng.random() < 0.1:
            tags[i] = str(rng.choice(["header", "aside"]))
    return Page(tags, names, page.parents, page.texts)


def fit(pages: list[str]) -> BoostedTrees | None:
    """Trees learnt from pages with an article: what is inside it and no furniture is wanted."""
    rows, labels = [], []
    for place, source in enumerate(pages):
        rng = np.random.default_rng(zlib.crc32(source.encode()))
        for version, plain in variants(source, pages[(place + 1) % len(pages)]):
            page = parse(version)
            wanted = teach(page)
            if wanted is None:
                continue
            for copy in (page, renamed(page, rng, plain, wanted), renamed(page, rng, plain, wanted)):
                rows.append(features(copy))
                labels.append(wanted)
    return BoostedTrees.fit(np.concatenate(rows), np.concatenate(labels).astype(float)) if rows else None


def train(pages: DataFrame, sample: int = 100) -> BoostedTrees | None:
    """Trees learnt from at most ``sample`` pages, the first by a hash; none if no page has an article.

    The hashes alone are ranked, then the pages up to the last one chosen are read, so a task hands
    over no more html than the sample holds.
    """
    hashed = pages.where("html IS NOT NULL").select("html", F.xxhash64("page_id", "url").alias("h"))
    chosen = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if chosen is None:
        return None
    return fit([r["html"] for r in hashed.where(F.col("h") <= chosen).orderBy("h", "html").limit(sample).collect()])


def plain_odds(page: Page) -> np.ndarray:
    """Without a model: all text outside furniture elements."""
    odds = np.array([-6.0 if t in FURNITURE_TAGS or n & FURNITURE else 6.0 for t, n in zip(page.tags, page.names)])
    for i in range(1, len(odds)):
        odds[i] = min(odds[i], odds[page.parents[i]])
    return odds


def extract(sources: list[str], model: BoostedTrees | None) -> list[str]:
    """Main texts of some pages, scored together."""
    pages = [parse(source) for source in sources]
    if model is None:
        odds = [plain_odds(page) for page in pages]
    else:
        ends = np.cumsum([len(page.tags) for page in pages])
        odds = np.split(model.log_odds(np.concatenate([features(page) for page in pages])), ends[:-1])
    return [join_blocks(page, choose(page.parents, own)) for page, own in zip(pages, odds)]


def main_texts(pages: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``.

    Null and empty html, and pages without main text, give the empty text.  Equal rows and null ids stay; an empty
    table gives an empty one; other columns are not read.  A very long page is one row, read in linear time.
    """
    broadcast = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, TOGETHER):
                texts += extract([source or "" for source in batch.column("html").slice(at, TOGETHER).to_pylist()], own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
