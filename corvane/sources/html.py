"""Records from HTML pages: embedded application JSON, then JSON-LD, then plain cards."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "name string, price double, regular double, url string, image string, in_stock boolean"
#: Where a category page keeps its list of products, and what it shows when that is empty.
LIST_SCRIPT, LIST_PATH = "__NEXT_DATA__", "$.props.pageProps.pageProps.productPageProps.products"
EMPTY_PHRASES = ["ไม่พบสินค้า", "ไม่มีสินค้า", "no products found"]


def first(record: dict, *names: str) -> object:
    """The first value that is there and not empty; names may be dotted."""
    for name in names:
        value: object = record
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value not in (None, "", [], {}):
            return value
    return None


def price_of(value: object) -> float | None:
    """A finite number that isn't negative, from a number or a text."""
    if isinstance(value, bool) or value is None:
        return None
    found = re.search(r"\d+(?:\.\d+)?", str(value).replace(",", ""))
    return float(found[0]) if found and not str(value).strip().startswith("-") else None


def product(record: dict) -> tuple | None:
    """A product record of any of the known shapes; None without a name."""
    name = first(record, "name", "title", "product_name")
    if not isinstance(name, str) or not name.strip():
        return None
    offers = record.get("offers")
    offer = offers[0] if isinstance(offers, list) and offers else offers if isinstance(offers, dict) else {}
    if offer:
        price, regular = price_of(first(offer, "price", "lowPrice", "salePrice")), price_of(first(record, "originalPrice", "highPrice") or first(offer, "highPrice"))
    else:
        # a sale price of nothing is none
        sale = price_of(first(record, "discount", "salePrice", "sale_price", "special_price", "currentPrice"))
        regular = price_of(first(record, "price", "normalPrice", "originalPrice", "final_price"))
        price = sale if sale else regular
    sold_out = first(record, "sold_out", "soldout", "soldOut", "isSoldOut")
    stock = first(offer, "availability") if offer else first(record, "in_stock", "is_in_stock", "inStock", "available", "isAvailable", "availability")
    if sold_out is not None:
        known = str(sold_out).lower() in ("false", "0", "no")
    elif stock is None:
        known = None
    else:
        said = str(stock)
        known = False if SOLD_OUT.search(said) else bool(IN_STOCK.search(said)) or said.lower() in ("true", "1", "yes")
    image = first(record, "mainImg", "mainImage", "image", "imageUrl", "image_url", "thumbnail")
    image = image[0] if isinstance(image, list) else first(image, "url") if isinstance(image, dict) else image
    return " ".join(name.split()), price, regular, first(record, "url", "productUrl", "product_url", "href", "link"), image if isinstance(image, str) else None, known


def walk(node: object, kinds: set[str]) -> Iterator[dict]:
    """Objects of a JSON-LD type, or elements of lists named products, anywhere in a tree."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            kind = top.get("@type")
            if kinds & set(kind if isinstance(kind, list) else [kind]):
                yield top
            if not kinds:
                yield from (x for x in top.get("products") or [] if isinstance(x, dict)) if isinstance(top.get("products"), list) else ()
            stack += reversed(list(top.values()))
        elif isinstance(top, list):
            stack += reversed(top)


#: Elements that have no end tag, and those whose text isn't shown.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HIDDEN = frozenset({"script", "style", "template", "noscript"})
CARD = re.compile(r"(?:[a-z0-9]+[-_])*card|product(?:[-_]item)?|item")
SOLD_OUT = re.compile(r"out[ _-]?of[ _-]?stock|sold[ _-]?out|สินค้าหมด", re.I)
IN_STOCK = re.compile(r"in[ _-]?stock|มีสินค้า", re.I)
CURRENCY = re.compile(r"฿|\bTHB\b|บาท|[$€£]", re.I)


class Element:
    """An element of a page with its children: elements and texts in order."""

    __slots__ = ("name", "given", "children")

    def __init__(self, name: str, given: dict[str, str]):
        self.name, self.given, self.children = name, given, []

    def elements(self) -> Iterator[Element]:
        """All elements below, in page order."""
        stack = list(reversed(self.children))
        while stack:
            top = stack.pop()
            if isinstance(top, Element):
                yield top
                stack += reversed(top.children)

    def text(self) -> str:
        stack, out = [self], []
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
            elif top.name not in HIDDEN:
                stack += reversed(top.children)
        return " ".join(" ".join(out).split())

    def words(self) -> list[str]:
        return self.given.get("class", "").lower().split()

    def first(self, *names: str) -> str:
        """The first attribute of these names that isn't empty."""
        return next((v for n in names if (v := " ".join(self.given.get(n, "").split()))), "")


class Tree(HTMLParser):
    """The elements of a page. An end tag closes the nearest open element of its name; others that are open in it end with it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        place = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].name == tag), 0)
        if place:
            del self.open[place:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parsed(page: str) -> Element:
    tree = Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def is_card(e: Element) -> bool:
    return e.name in ("article", "li", "div", "section", "a") and any(CARD.fullmatch(w) for w in e.words()) or e.given.get("itemtype", "").lower().endswith("/product") or "data-product-id" in e.given


def shown(card: Element, *rules: Callable[[Element], bool]) -> str:
    """The content or text of the first element that the earliest rule takes and that has any."""
    inside = list(card.elements())
    for rule in rules:
        for e in inside:
            if rule(e) and (text := e.first("content") or e.text()):
                return text
    return ""


def marked(word: str) -> Callable[[Element], bool]:
    return lambda e: any(word in w for w in e.words())


def property_is(name: str) -> Callable[[Element], bool]:
    return lambda e: e.given.get("itemprop") == name


def card_record(card: Element) -> tuple | None:
    """name, price, regular price, url, image and stock of one card; None without a name and a link.

    A number without a currency isn't taken for a price unless an element is marked as one.
    """
    inside = list(card.elements())
    link = card if card.name == "a" and card.given.get("href") else next((e for e in inside if e.name == "a" and e.given.get("href")), None)
    url = card.first("data-url", "data-href") or (link.first("href") if link else "")
    picture = next((e for e in inside if e.name == "img"), None)
    name = card.first("data-product-name", "data-name") or shown(card, property_is("name"), marked("product-title"), marked("product-name"), lambda e: "title" in e.words(), *[lambda e, h=h: e.name == h for h in ("h1", "h2", "h3", "h4")])
    name = name or (picture.first("alt", "title") if picture else "")
    if not name or not url:
        return None
    price = price_of(card.first("data-price", "data-sale-price") or shown(card, property_is("price"), marked("sale-price"), marked("current-price"), lambda e: "price" in e.words()) or None)
    regular = price_of(card.first("data-original-price") or shown(card, marked("original-price"), lambda e: e.name == "del", lambda e: e.name == "s") or None)
    text = card.text()
    if price is None and CURRENCY.search(text):
        price = price_of(text)
    image = picture.first("src", "data-src", "data-lazy-src") or picture.first("srcset").split(",")[0].split(" ")[0] if picture else ""
    state = " ".join([*card.words(), card.first("data-stock"), card.first("data-availability"), text])
    stock = False if SOLD_OUT.search(state) else True if IN_STOCK.search(state) else None
    return name, price, regular, url, image or None, stock


def cards(root: Element) -> list[tuple]:
    """Records of cards. A card that holds cards with records is their frame; one whose inner ones have none is a record itself."""
    out: list[tuple] = []
    # elements whose inside is done come after it
    stack: list[tuple[Element, int]] = [(root, -1)]
    while stack:
        e, begun = stack.pop()
        if begun < 0:
            stack.append((e, len(out)))
            stack += [(c, -1) for c in reversed(e.children) if isinstance(c, Element)]
        elif begun == len(out) and is_card(e) and (found := card_record(e)):
            out.append(found)
    return out


def records(page: str | None) -> list[tuple]:
    """Records of the first kind of source that has any, each with that kind."""
    root = parsed(page or "")
    app, linked = [], []
    for script in root.elements():
        kind = script.given.get("type", "").lower()
        if script.name != "script" or "json" not in kind:
            continue
        try:
            body = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        if "ld+json" in kind:
            linked += [p for x in walk(body, {"Product"}) if (p := product(x))]
        else:
            app += [p for x in walk(body, set()) if (p := product(x))]
    if app or linked:
        return [(*p, "app") for p in app] or [(*p, "json-ld") for p in linked]
    return [(*p, "card") for p in cards(root)]


def catalogue(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, record number, RECORD and the kind of source, one row per record."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, *r) for i, page in zip(part["id"], part["page"]) for n, r in enumerate(records(page))]
            yield pd.DataFrame(rows, columns=["id", "n", "name", "price", "regular", "url", "image", "in_stock", "kind"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("page"))
    return chosen.mapInPandas(run, f"id {dict(pages.dtypes)[id_col]}, n int, {RECORD}, kind string")


def links(page: Column) -> Column:
    """Targets of links, in page order."""
    return F.regexp_extract_all(page, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))


def title(page: Column) -> Column:
    found = F.regexp_extract(page, "(?s)<title[^>]*>(.*?)</title>", 1)
    return F.when(found != "", F.trim(found))


def explicitly_empty(page: Column) -> Column:
    """Whether a page says itself that it has no records: its own list is there and empty, and it shows a phrase that says so.

    Either sign alone isn't enough: another list may be empty, and a phrase may be about something else.
    """
    script = F.regexp_extract(page, rf"""(?is)<script[^>]*\bid=["']?{LIST_SCRIPT}\b[^>]*>(.*?)</script""", 1)
    own = F.get_json_object(script, LIST_PATH)
    text = F.lower(F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " "))
    said = F.exists(F.array(*map(F.lit, EMPTY_PHRASES)), lambda p: F.contains(F.regexp_replace(text, r"\s+", " "), p))
    return F.coalesce(F.regexp_like(own, F.lit(r"^\[\s*\]$")) & said, F.lit(False))


def sitemap(files: DataFrame, column: str = "value") -> DataFrame:
    """loc: the addresses of sitemap XML texts."""
    return files.select(F.explode(F.xpath(column, F.lit("//*[local-name()='loc']/text()"))).alias("loc"))
