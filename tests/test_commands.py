"""Messages as commands: a table of messages and what they ask for."""

import pytest

from corvane.operators import commands

BRANDS = [("sony", "Sony"), ("jbl", "JBL"), ("keychron", "Keychron"), ("logitech", "Logitech"), ("razer", "Razer"), ("sennheiser", "Sennheiser")]
KINDS = [("หูฟัง", "หูฟัง"), ("headphone", "หูฟัง"), ("keyboard", "คีย์บอร์ด"), ("คีย์บอร์ด", "คีย์บอร์ด"), ("mouse", "เมาส์"), ("เมาส์", "เมาส์"), ("speaker", "ลำโพง")]
#: message: intent, category, brands, excluded, low, high, in stock, sort, query.
CASES = {
    "หูฟัง Sony หรือ JBL ไร้สาย งบ ๕k พร้อมส่ง ถูกสุด": ("search", "หูฟัง", ["Sony", "JBL"], [], None, 5000.0, True, "price_asc", "ไร้สาย"),
    "mechanical keyboard Keychron budget 3.5k available now": ("search", "คีย์บอร์ด", ["Keychron"], [], None, 3500.0, True, None, "mechanical"),
    "hedphone senheiser under 9000": ("search", "หูฟัง", ["Sennheiser"], [], None, 9000.0, None, None, ""),
    "หูฟังไม่เอาของหมด": ("search", "หูฟัง", [], [], None, None, True, None, ""),
    "หูฟังไม่เอา Sony": ("search", "หูฟัง", [], ["Sony"], None, None, None, None, ""),
    "headphone except brand Sony out of stock": ("search", "หูฟัง", [], ["Sony"], None, None, False, None, ""),
    "mouse pad": ("search", "เมาส์", [], [], None, None, None, None, "pad"),
    "find me speaker JBL most expensive please": ("search", "ลำโพง", ["JBL"], [], None, None, None, "price_desc", ""),
    "wh-1000xm5": ("search", None, [], [], None, None, None, None, "wh-1000xm5"),
    "how to order a mouse": ("order", None, [], [], None, None, None, None, ""),
    "ติดต่อแอดมิน เรื่องหูฟัง": ("contact", None, [], [], None, None, None, None, ""),
    "show me another": ("refresh", None, [], [], None, None, None, None, ""),
    "refresh please": ("refresh", None, [], [], None, None, None, None, ""),
    "มีคูปองอะไร": ("promotion", None, [], [], None, None, None, None, ""),
    "what can you do": ("help", None, [], [], None, None, None, None, ""),
    "ขอบคุณครับ": ("thanks", None, [], [], None, None, None, None, ""),
    "สวัสดี": ("greeting", None, [], [], None, None, None, None, ""),
    "สวัสดี ขอหูฟัง": ("search", "หูฟัง", [], [], None, None, None, None, "สวัสดี"),
    "โอเค": ("unknown", None, [], [], None, None, None, None, ""),
    "this": ("unknown", None, [], [], None, None, None, None, ""),
    "": ("unknown", None, [], [], None, None, None, None, ""),
}
FIELDS = ["intent", "category", "brands", "excluded", "low", "high", "in_stock", "sort", "query"]


@pytest.fixture(scope="module")
def got(spark):
    names = lambda rows: spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(rows)], "alias string, canonical string, place int")
    messages = spark.createDataFrame([(i, m) for i, m in enumerate(CASES)] + [(99, None), (98, "x " * 20_000 + "keyboard")], "id long, text string")
    return {r["id"]: r for r in commands.parsed(messages, names(BRANDS), names(KINDS)).collect()}


def test_commands(got):
    for i, (message, want) in enumerate(CASES.items()):
        assert tuple(got[i][f] for f in FIELDS) == want, message


def test_confidence(got):
    at = {m: got[i]["confidence"] for i, m in enumerate(CASES)}
    assert at["หูฟังไม่เอา Sony"] == pytest.approx(0.72 + 0.045 * 2)
    assert at["mouse pad"] == pytest.approx(0.72 + 0.045 * 2)
    assert at["hedphone senheiser under 9000"] == pytest.approx(0.72 + 0.045 * 3 - 0.05)
    assert at["หูฟัง Sony หรือ JBL ไร้สาย งบ ๕k พร้อมส่ง ถูกสุด"] == pytest.approx(0.99)
    assert (at["โอเค"], at[""], at["สวัสดี"]) == (0.2, 0.0, 0.95)


def test_null_and_long_messages(got):
    assert got[99]["intent"] == "unknown" and got[99]["confidence"] == 0.0 and got[99]["brands"] == []
    assert got[98]["category"] == "คีย์บอร์ด" and len(got[98]["query"]) == 39_999


def test_an_empty_table(spark):
    names = spark.createDataFrame([], "alias string, canonical string, place int")
    assert commands.parsed(spark.createDataFrame([], "id long, text string"), names, names).count() == 0
