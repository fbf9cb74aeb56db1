"""Records of nested HTML, empty pages by both signs, normalised texts: the cases of the rules as rows."""

import json

import pytest

from corvane.functions import text
from corvane.sources import html

CARD = '<div class="grid"><section><div class="product-card"><div class="img"><a href="/p/1"><img data-src="/i/1.png"></a></div><div><h2>Lamp <b>No 5</b></h2></div><div class="box"><div class="badge">New</div><div class="price"><span>฿</span> 1,290</div><del>1,990.50</del></div></div></section></div>'


@pytest.mark.parametrize(
    "page,want",
    [
        (CARD, [("Lamp No 5", 1290.0, 1990.5, "/p/1", "/i/1.png", None, "card")]),
        # cards in a card, void elements and unclosed ones
        ('<div class="item"><h2>Frame</h2><a href="/all">all</a><article class="card"><img src=/a.png alt="Red pen"><br><a href="/a">see</a><p>sold out</article><article class="card"><h3>Blue<wbr> pen</h3><a href="/b">see</a><span itemprop=price content="12.5">12,50</span> in stock</article></div>', [("Red pen", None, None, "/a", "/a.png", False, "card"), ("Blue pen", 12.5, None, "/b", None, True, "card")]),
        # a number isn't a price without a sign of money; a card without a link, or a name, is none
        ('<li class="product"><h3>iPhone 15</h3><a href="/i">16 GB</a></li><li class="product"><h3>No link</h3></li><li class="product"><a href="/x"></a></li>', [("iPhone 15", None, None, "/i", None, None, "card")]),
        ('<li class="item"><h3>Bare</h3><a href="/i">x</a> ฿ 1,200</li>', [("Bare", 1200.0, None, "/i", None, None, "card")]),
        # regular and sale price, sold out the other way round; a sale price of nothing is none
        ('<script type="application/json">' + json.dumps({"props": {"products": [{"title": "A", "price": 10, "special_price": 0, "url": "/a", "soldout": "0"}, {"name": "B", "price": "1,000", "discount": 900, "slug": "b", "sold_out": True, "mainImg": {"url": "/b.png"}}, {"name": " "}]}}) + "</script>" + CARD, [("A", 10.0, 10.0, "/a", None, True, "app"), ("B", 900.0, 1000.0, None, "/b.png", False, "app")]),
        ('<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"C","image":["/1.png","/2.png"],"offers":[{"price":"5","availability":"http://schema.org/OutOfStock","highPrice":"7"}]}]}</script><script type="application/ld+json">{broken</script>', [("C", 5.0, 7.0, None, "/1.png", False, "json-ld")]),
        ("", []), (None, []), ("<div class='product'>", []), ("< not html & <b", []),
    ],
)
def test_records_of_pages(page, want):
    assert html.records(page) == want


def test_a_page_of_very_deep_elements():
    assert html.records("<div>" * 50_000 + CARD) == [("Lamp No 5", 1290.0, 1990.5, "/p/1", "/i/1.png", None, "card")]


def test_a_page_is_empty_by_its_list_and_its_words(spark):
    own = lambda products: '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"pageProps": {"productPageProps": {"products": products}}}}}) + "</script>"
    pages = [(own([]) + "<p>No <b>products</b>\n found</p>", True), (own([]) + "<p>ไม่พบสินค้า</p>", True), (own([]), False), ("<p>no products found</p>", False), (own([{"name": "a"}]) + "no products found", False), (own([]) + "<script>no products found</script>", False), ('<script>{"products": []}</script> no products found', False), (None, False), ("", False)]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, page string")
    assert [r["e"] for r in rows.select("i", html.explicitly_empty(rows["page"]).alias("e")).orderBy("i").collect()] == [e for _, e in pages]


def test_normalised_texts(spark):
    cases = {"1,234,567": "1234567", "ดีมากกกก": "ดีมาก", "WH-1000XM5": "wh-1000xm5", "≥ ๑๐ – ≤ 20": ">= 10 - <= 20", "été": "été", "a​b c": "ab c", "soooo (good)! .-": "so good", "a_b": "a_b", "10000": "10000", "": "", None: None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r["n"] for r in rows.select("i", text.normalised(rows["t"]).alias("n")).orderBy("i").collect()] == list(cases.values())
