"""HTML extraction by the maximum-scoring subsequence.

A page is cut into words and tags. Words score positive and tags negative; the weights are log-odds
of the token's kind (a tag's name, or a word with the innermost open tag) inside against outside the
content region, learned from labelled pages. To these come the log-odds, learned likewise, of the words
in an element's class, id, role and aria-label: to its own two tags where they are negative, and to the words of
which it is the innermost open element with such names. Names never seen, and words of place or form, say nothing. Weights are held to
the sign of their class. One linear scan finds the best contiguous run.

Boilerplate elements weigh nothing and give no text, so that one inside the article doesn't end it: those of a fixed list of names, and those with a class, id, role or
aria-label all of whose words are marks of boilerplate or say only a place or form. If only some of its
words are marks, the words inside weigh LOWER as much and the run decides. An element that holds the
largest article or main element, or on pages without these more than half of the words, is neither
left out nor lowered, nor is one that never ends.

Labelled pages are at most ``sample`` pages with exactly one article element, chosen by a hash of the
id: what lies inside that element is the content. Without any, words weigh 1 and tags -1.

The text of the run is given by block: character references decoded, white space turned into one
space, trimmed, blocks joined by one space in page order. Null, empty and wordless pages give empty
text. Repeated rows are extracted each; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Comments, declarations, raw-text elements as a whole, tags, text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S | re.I,
)
LABEL = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "select", "button", "canvas", "head"}
#: Words of a class, id or role that mark boilerplate.
MARKS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar comment comments reply replies disqus cookie cookies consent gdpr banner notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations menu navigation nav navbar breadcrumb breadcrumbs footer header masthead widget toolbar pagination pager copyright complementary contentinfo search".split())
#: Words that say only where an element is or what it is made of.
PLAIN = set("left right top bottom upper lower inner outer box bar block area panel list item items row col column wrap wrapper container slot unit zone group site global primary secondary posts articles links link buttons icons".split())
LOWER = 0.25
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "param", "track"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: The largest weight, the smallest of a word, and that of one whose names speak against it.
CAP, LEAST, AGAINST = 8.0, 0.05, 0.001


def named(attributes: str) -> list[set[str]]:
    """The words of each name in class, id, role and aria-label."""
    found = []
    for label, value in LABEL.findall(attributes):
        value = value.strip("\"'")
        for name in [value] if label.lower() == "aria-label" else value.split():
            found.append(set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""})
    return found


def marked(attributes: str) -> float:
    """What the words inside weigh: 0 for boilerplate, LOWER if only some words of a name are marks, else 1."""
    share = 1.0
    for own in named(attributes):
        if own & MARKS:
            share = min(share, LOWER if own - MARKS - PLAIN else 0.0)
    return share


@dataclass
class Token:
    kind: str  # weight's name; "" weighs nothing
    text: str | None  # words, or None for a tag
    block: bool  # a block ends here
    count: int = 1
    share: float = 1.0
    names: tuple[str, ...] = ()  # a tag's own; of words, those of the innermost open element that has any


def spans(cut: list[tuple]) -> dict[int, int]:
    """Place of an opening tag -> that of its closing tag."""
    opened: dict[str, list[int]] = {}
    found = {}
    for i, (slash, name, attributes, *_) in enumerate(cut):
        if slash and opened.get(name):
            found[opened[name].pop()] = i
        elif name and not slash and name not in VOID and not attributes.rstrip().endswith("/"):
            opened.setdefault(name, []).append(i)
    return found


def tokens(page: str) -> list[Token]:
    """Tokens in page order; boilerplate elements are left out."""
    cut = [(m.group(2), (m.group(3) or "").lower(), m.group(4) or "", m.group(1), m.group(0)) for m in TOKEN.finditer(page)]
    out: list[Token] = []
    opened: list[str] = []
    names: list[tuple[str, ...]] = [()]  # in force outside all elements, then in each open one
    owned: list[tuple[str, ...]] = []  # of each open element itself
    ends = spans(cut)
    before = [0, *accumulate(0 if name or raw is not None or whole.startswith(("<!", "<?")) else len(whole.split()) for _, name, _, raw, whole in cut)]
    regions = []
    for kind in ("article", "main"):
        places = [(i, ends.get(i, i)) for i, (slash, name, *_) in enumerate(cut) if name == kind and not slash]
        regions += [max(places, key=lambda p: before[p[1]] - before[p[0]])] if places else []

    def held(i: int) -> bool:
        """Whether the content is in the element that opens at ``i``."""
        if regions:
            return any(i < begin and end < ends[i] for begin, end in regions)
        return 2 * (before[ends[i]] - before[i]) > before[-1]

    skipped = lowered = -1  # the ends of such elements
    for i, (slash, name, attributes, raw, whole) in enumerate(cut):
        if i <= skipped:
            continue
        if raw is not None or whole.startswith(("<!", "<?")):
            continue
        if not name:
            words = len(whole.split())
            out.append(Token(f"word:{opened[-1] if opened else ''}" if words else "", whole, False, words, LOWER if i < lowered else 1.0, names[-1]))
            continue
        if i in ends:
            share = 0.0 if name in DROPPED else 1.0 if name in ("html", "body", "article", "main") else marked(attributes)
            if share < 1 and not held(i):
                if share == 0:
                    skipped = ends[i]
                    out.append(Token("", None, True))
                    continue
                lowered = max(lowered, ends[i])
        own: tuple[str, ...] = ()
        if slash:
            closed = "" if name in opened else name
            while closed != name:
                closed, own = opened.pop(), owned.pop()
                names.pop()
        elif name not in VOID and name not in INLINE - {"a"}:
            if name in ("p", "li", "tr", "td", "option") and opened and opened[-1] == name:
                opened.pop()
                names.pop()
                owned.pop()
            own = tuple(sorted({f".{x}" for words in named(attributes) for x in words - PLAIN})) if attributes else ()
            opened.append(name)
            names.append(own or names[-1])
            owned.append(own)
        out.append(Token(name if not slash else f"/{name}", None, name not in INLINE, names=own))
    return out


@dataclass
class Model:
    weights: dict[str, float]

    def weight(self, t: Token) -> float:
        if not t.kind:
            return 0.0
        said = float(np.clip(sum(self.weights.get(x, 0.0) for x in t.names), -CAP, CAP)) if t.names else 0.0
        if t.text is None:
            return self.weights.get(t.kind, -1.0) + min(said, 0.0)
        return max(self.weights.get(t.kind, 1.0) + said, LEAST if said >= 0 else AGAINST) * t.count * t.share


def learn(pages: list[str]) -> Model:
    """Log-odds of each kind inside the one article element against outside it."""
    inside, outside = Counter(), Counter()
    for page in pages:
        cut = tokens(page)
        begin = [i for i, t in enumerate(cut) if t.kind == "article"]
        end = [i for i, t in enumerate(cut) if t.kind == "/article"]
        if len(begin) != 1 or len(end) != 1 or begin[0] > end[0]:
            continue
        for i, t in enumerate(cut):
            if t.kind:
                for kind in (t.kind, *t.names) if t.text is not None else (t.kind,):
                    (inside if begin[0] < i < end[0] else outside)[kind] += t.count
    weights = {}
    every = [sum(n for kind, n in side.items() if kind.startswith("word:")) for side in (inside, outside)]
    for kind in inside | outside:
        odds = float(np.clip(np.log((inside[kind] + 0.5) / (outside[kind] + 0.5)), -CAP, CAP))
        if kind.startswith("."):  # what a name adds to what is known of all words
            weights[kind] = float(np.clip(odds - np.log((every[0] + 0.5) / (every[1] + 0.5)), -CAP, CAP))
        else:  # words stay positive, or nearly nothing; tags stay negative, or nearly nothing
            weights[kind] = max(odds, LEAST) if kind.startswith("word:") else min(odds, -LEAST)
    for name in ("article", "main"):  # the bounds of a labelled region are outside it
        for kind in (name, f"/{name}"):
            weights[kind] = min(weights.get(kind, -CAP), -CAP) * 100
    return Model(weights)


def best_run(weights: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous run of the largest positive sum; the first and shortest on ties."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, w in enumerate(weights):
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def extract(page: str, model: Model) -> str:
    cut = tokens(page)
    begin, end = best_run([model.weight(t) for t in cut])
    blocks, held = [], []
    for t in cut[begin:end]:
        if t.text is not None:
            held.append(html.unescape(t.text))
        elif t.block:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return " ".join(x for b in blocks if (x := " ".join(b.split())))


def labelled(pages: DataFrame, sample: int, id_col: str, html_col: str) -> list[str]:
    """At most ``sample`` pages, one of an id's rows."""
    rows = pages.where(pages[html_col].contains("<article")).select(pages[id_col].alias("_id"), pages[html_col].alias("_html"))
    chosen = sampled(rows, sample)
    if not chosen:
        return []
    few = F.broadcast(pages.sparkSession.createDataFrame([(i,) for i, _ in chosen], f"_id {rows.schema['_id'].dataType.simpleString()}"))
    taught = rows.join(few, "_id").groupBy("_id").agg(F.min("_html").alias("_html")).collect()
    return [r["_html"] for r in sorted(taught, key=lambda r: r["_id"])]


def main_text(pages: DataFrame, sample: int = 400, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = learn(labelled(pages, sample, id_col, html_col))
    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [extract(x.as_py() or "", model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=names)

    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
