"""Messages to a shop assistant as commands: entities by rules that claim spans of the text, what is left as the query, intent and confidence."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions import udfs

from . import dictionary
from .nlp import typo_matches
from .stored import Tables

#: Phrases of each intent, in order of priority; those before "search" win over entities, those after yield to them.
FIRST_INTENTS = {
    "order": ["อยากสั่งซื้อ", "ต้องการสั่ง", "สั่งซื้อ", "สั่งของ", "ออเดอร์", "สั่งอย่างไร", "ชำระเงิน", "สถานะคำสั่งซื้อ", "order status", "how to order", "place an order", "place order", "checkout", "payment"],
    "contact": ["ติดต่อ", "คุยกับแอดมิน", "คุยกับเจ้าหน้าที่", "เบอร์โทร", "ฝ่ายบริการลูกค้า", "customer service", "contact staff", "contact us"],
    "refresh": ["อื่นๆ", "ดูอีก", "สุ่มใหม่", "สุ่มไหม่", "ขอชุดใหม่", "ดูชุดใหม่", "ขออันอื่น", "ดูอย่างอื่น", "มีตัวอื่นไหม", "เอาใหม่", "show another", "show me another", "show more", "more options"],
    "promotion": ["โปรโมชัน", "โปรโมชั่น", "โปรโมชั้น", "โปรล่าสุด", "โปรอะไร", "มีคูปองอะไร", "มีคูปองลดไหม", "คูปองล่าสุด", "promotion", "promotions", "latest deals"],
}
LAST_INTENTS = {
    "help": ["ช่วยเหลือ", "ช่วยอะไรได้บ้าง", "ทำอะไรได้บ้าง", "ใช้งานยังไง", "วิธีใช้งาน", "คำสั่งมีอะไรบ้าง", "help", "how to use", "what can you do"],
    "thanks": ["ขอบคุณ", "ขอบคุน", "ขอบใจ", "ขอบพระคุณ", "thanks", "thank you", "thx"],
    "greeting": ["สวัสดี", "สวัดดี", "หวัดดี", "ดีจ้า", "ฮัลโหล", "hello", "hi", "hey", "good morning", "good evening"],
}
CONFIDENCE = {"order": 0.97, "contact": 0.97, "refresh": 0.96, "promotion": 0.97, "help": 0.96, "thanks": 0.96, "greeting": 0.95, "unknown": 0.20}
SEARCH = ["ช่วยหา", "กำลังหา", "ค้นหา", "อยากได้", "อยากซื้อ", "ขอดู", "แนะนำสินค้า", "มีอะไรขาย", "มีอะไรแนะนำ", "มีอะไรน่าสนใจ", "แนะนำหน่อย", "มีรุ่นไหน", "หาให้หน่อย", "looking for", "find me", "show me", "recommend", "i want", "i need"]
#: Stock. What says that sold-out goods aren't wanted is looked for first.
IN_STOCK = ["ไม่เอาของหมด", "ไม่เอาสินค้าหมด", "ไม่เอาหมดสต็อก", "ของไม่หมด", "not out of stock", "exclude sold out", "พร้อมส่ง", "มีของ", "มีสต็อก", "ของพร้อม", "ส่งได้เลย", "in stock", "available now", "ready to ship"]
SOLD_OUT = ["ของหมด", "หมดสต็อก", "สินค้าหมด", "ไม่พร้อมส่ง", "ยังไม่พร้อมส่ง", "out of stock", "sold out", "unavailable"]
#: Orders of the results.
SORTS = {
    "price_asc": ["ตัวถูกๆ", "ถูกๆ", "เรียงถูกสุด", "ถูกสุด", "ถูกที่สุด", "ราคาต่ำสุด", "เรียงราคาถูก", "price low to high", "cheapest"],
    "price_desc": ["แพงสุด", "แพงที่สุด", "ราคาสูงสุด", "เรียงราคาแพง", "price high to low", "most expensive"],
    "newest": ["ใหม่สุด", "ใหม่ล่าสุด", "รุ่นใหม่", "สินค้ามาใหม่", "newest", "latest"],
    "popular": ["ยอดนิยม", "ขายดี", "ฮิต", "นิยมสุด", "popular", "best seller", "bestseller"],
    "discount": ["ลดเยอะสุด", "ลดแรงสุด", "ส่วนลดสูงสุด", "คุ้มสุด", "biggest discount", "best discount"],
}
#: Words around what is asked for. Those of the first list go from the beginning, of the second from the end, of the third anywhere.
LEADING = ["ช่วยหา", "ช่วยแนะนำ", "ขอแนะนำ", "แนะนำ", "กำลังหา", "อยากได้", "อยากซื้อ", "ขอดู", "ค้นหา", "ขอรุ่น", "หา", "เอาไว้", "show me", "find me", "find", "search for", "search", "looking for", "recommend", "i want", "i need", "สำหรับ"]
TRAILING = ["ให้หน่อย", "หน่อย", "ทีครับ", "ทีค่ะ", "ครับ", "ค่ะ", "คะ", "จ้า", "ที", "นะ", "ด้วย", "please"]
ANYWHERE = ["เอาเฉพาะ", "เฉพาะ", "อย่างเดียว", "ไม่เอา", "ไม่รับ", "ไม่ต้องการ", "ยกเว้น", "not", "except", "without", "เท่านั้น", "สินค้า", "รุ่น", "product", "ราคา", "price", "งบ", "budget", "มีไหม", "หรือเปล่า"]
SMALL = ["and", "or", "with", "that", "the", "a", "an", "for", "me", "want", "need", "และ", "หรือ", "แต่", "ที่", "แบบ", "มี", "ของ", "ขอ", "เอา", "เรียง", "บ้าง", "ไหม", "ตัว"]
#: What stands before a brand that isn't wanted, and what calls a word a brand.
UNWANTED, LABEL = r"(?:ไม่เอา|ไม่รับ|ไม่ต้องการ|ยกเว้น|not|except|without)\s*(?:แบรนด์|brand)?\s*$", r"แบรนด์|brand"
THAI = r"[฀-๿]"


@dataclass
class Words:
    """The word lists of a parser; a shop may give its own."""

    first: dict[str, list[str]] = field(default_factory=lambda: FIRST_INTENTS)
    last: dict[str, list[str]] = field(default_factory=lambda: LAST_INTENTS)
    search: list[str] = field(default_factory=lambda: SEARCH)
    in_stock: list[str] = field(default_factory=lambda: IN_STOCK)
    sold_out: list[str] = field(default_factory=lambda: SOLD_OUT)
    sorts: dict[str, list[str]] = field(default_factory=lambda: SORTS)


def pattern(phrases: list[str]) -> str:
    """Any of the phrases, the longest first; Latin ones stand between other signs than letters and digits."""
    each = [f"(?<![a-z0-9]){p}(?![a-z0-9])" if p.isascii() else p for p in sorted(phrases, key=lambda p: (-len(p), p))]
    return "(?:" + "|".join(each) + ")"


def span(text: Column, phrases: list[str]) -> Column:
    """struct(at, long) of the phrase that begins first, from 0; null without one."""
    found = F.regexp_extract(text, "^((?s:.*?))(" + pattern(phrases) + ")", 2)
    before = F.regexp_extract(text, "^((?s:.*?))(" + pattern(phrases) + ")", 1)
    return F.when(found != "", F.struct(F.length(before).alias("at"), F.length(found).alias("long")))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spans (array of struct(at, long)) as spaces; places stay as they are."""
    return F.aggregate(spans, text, lambda acc, s: F.overlay(acc, F.repeat(F.lit(" "), s["long"]), s["at"] + 1, s["long"]))


def query_of(text: Column) -> Column:
    """What is asked for: the text without words around it; white space squeezed, points and dashes off its ends."""
    lead = "|".join((rf"{p}(?![a-z0-9])\s*" if p.isascii() else rf"{p}\s*") for p in sorted(LEADING, key=len, reverse=True))
    trail = "|".join((rf"\s*(?<![a-z0-9]){p}" if p.isascii() else rf"\s*{p}") for p in sorted(TRAILING, key=len, reverse=True))
    out = F.trim(text)
    # stacked words of politeness go from the outside in; what stands around them may go first
    for _ in range(2):
        out = F.regexp_replace(F.regexp_replace(out, rf"^(?:{lead})+", ""), rf"(?:{trail})+$", "")
        each = "|".join(rf"(?<![a-z0-9]){p}(?![a-z0-9])" if p.isascii() else rf"(?<!{THAI}){p}(?!{THAI})" for p in sorted([*ANYWHERE, *SMALL], key=len, reverse=True))
        out = F.trim(F.regexp_replace(F.regexp_replace(out, each, " "), r"\s+", " "))
    return F.regexp_replace(out, r"^[ .\-]+|[ .\-]+$", "")


def disjoint(spans: Column) -> Column:
    """Of spans of one message, longest first, those that overlap none taken before; in order of their place."""
    order = F.array_sort(spans, lambda a, b: F.when(a["long"] != b["long"], b["long"] - a["long"]).otherwise(a["at"] - b["at"]))
    taken = F.aggregate(order, F.slice(order, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda o: (o["at"] < s["at"] + s["long"]) & (s["at"] < o["at"] + o["long"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(taken, lambda a, b: a["at"] - b["at"])


def mentions(messages: DataFrame, names: DataFrame, fuzzy: float | None) -> DataFrame:
    """_id, spans: array of struct(at, long, canonical, fuzzy) of the names each message mentions, none within another, in order.

    Spans of one message are at most as many as there are names in it.
    """
    known = names.select(F.lower("alias").alias("alias"), "canonical", "place")
    exact = dictionary.found(messages.select("_id", "_t"), known, "_id", "_t", "alias").join(known, F.col("term") == F.col("alias"))
    rows = exact.select("_id", F.col("start").alias("at"), F.length("alias").alias("long"), "canonical", F.lit(False).alias("fuzzy"))
    if fuzzy is not None:
        near = typo_matches(messages.select("_id", "_t"), known, fuzzy, "_id", "_t").join(messages.select("_id", "_t"), "_id")
        rows = rows.unionAll(near.select("_id", (F.position("word", "_t") - 1).alias("at"), F.length("word").alias("long"), "canonical", F.lit(True)))
    spans = rows.groupBy("_id").agg(disjoint(F.array_sort(F.collect_set(F.struct("at", "long", "canonical", "fuzzy")))).alias("spans"))
    return spans


def parsed(messages: DataFrame, brands: DataFrame, categories: DataFrame, key: str = "id", text: str = "text", fuzzy: float | None = 0.84, words: Words | None = None) -> DataFrame:
    """key, intent, confidence, category, brands, excluded, low, high, low_inclusive, high_inclusive, in_stock, sort, query of each message.

    Ids are unique. brands, categories: alias, canonical, place (their order). Rules claim spans of the normalised text in turn: prices, brands
    with the word that calls them one, the first category, stock, order of results; what no rule claims and isn't filler is the query. Intents
    in order: order, contact, refresh, promotion, search (any entity, a phrase of search, or a word of letters and digits), help, thanks,
    greeting, unknown; all but search carry no entities. Search is 0.72 sure, 0.045 more for each kind of evidence, 0.05 less with a
    near alias, 0.99 at most. Null and empty messages are unknown with confidence 0. Python reads prices and typing errors only.
    """
    words = words or Words()
    # read by each dictionary and by the join, so normalised once
    plain = Tables(messages.sparkSession, "messages").save(messages.select(F.col(key).alias("_id"), F.coalesce(t.normalised(F.col(text)), F.lit("")).alias("_t")), "plain")
    met = plain
    for name, table in (("_brands", brands), ("_kinds", categories)):
        found = mentions(plain, table, fuzzy).select("_id", F.col("spans").alias(name))
        met = met.join(found, "_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<at:int,long:int,canonical:string,fuzzy:boolean>>"))
    met = met.withColumns({"_brands": none("_brands"), "_kinds": F.slice(none("_kinds"), 1, 1), "_p": udfs.price_claims("_t")})
    short = F.col("_t")
    sold, stocked = span(short, words.sold_out), span(short, words.in_stock)
    sorts = F.array_min(F.filter(F.array(*[F.when(span(short, p).isNotNull(), F.struct(span(short, p)["at"].alias("at"), F.lit(name).alias("name"), span(short, p)["long"].alias("long"))) for name, p in words.sorts.items()]), lambda x: x.isNotNull()))
    met = met.withColumns({"_sold": sold, "_stocked": stocked, "_sort": sorts})
    out_of = F.col("_sold").isNotNull() & (F.col("_stocked").isNull() | (F.col("_sold.at") < F.col("_stocked.at")))
    in_stock = F.when(out_of, F.lit(False)).when(F.col("_stocked").isNotNull(), F.lit(True))
    stock_span = F.when(out_of, F.col("_sold")).otherwise(F.col("_stocked"))
    before = lambda b: F.substring(F.col("_t"), F.lit(1), b["at"])
    refused = lambda b: F.regexp_like(F.right(before(b), F.lit(32)), F.lit(UNWANTED))
    called = lambda b: F.length(F.regexp_extract(before(b), rf"((?:{LABEL})\s*)$", 1))
    bare = lambda s: F.struct(s["at"].cast("int").alias("at"), s["long"].cast("int").alias("long"))
    labelled = F.transform("_brands", lambda b: F.struct((b["at"] - called(b)).cast("int").alias("at"), (b["long"] + called(b)).cast("int").alias("long")))
    single = lambda c: F.when(c.isNotNull(), F.array(bare(c))).otherwise(F.array().cast("array<struct<at:int,long:int>>"))
    spans = F.concat(labelled, F.transform("_kinds", bare), single(stock_span), single(F.col("_sort")))
    ready = met.withColumns({
        "category": F.try_element_at(F.transform("_kinds", lambda k: k["canonical"]), F.lit(1)),
        "brands": F.array_distinct(F.transform(F.filter("_brands", lambda b: ~refused(b)), lambda b: b["canonical"])),
        "excluded": F.array_distinct(F.transform(F.filter("_brands", refused), lambda b: b["canonical"])),
        "in_stock": in_stock, "sort": F.col("_sort.name"), "query": query_of(blanked(F.col("_p.rest"), spans)),
        "_near": F.exists(F.concat("_brands", "_kinds"), lambda b: b["fuzzy"]),
    })
    asks = F.regexp_like("_t", F.lit(pattern(words.search))) | F.regexp_like("_t", F.lit(r"^(?:หา|find|search(?: for)?)\s+\S")) | (F.col("_t") == "มีอะไรบ้าง")
    model = F.regexp_like("_t", F.lit(r"(?<![a-z0-9-])(?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*[0-9])[a-z0-9-]{3,}(?![a-z0-9-])"))
    kinds = [F.col("category").isNotNull(), F.size("brands") > 0, F.size("excluded") > 0, F.col("_p.low").isNotNull() | F.col("_p.high").isNotNull(), F.col("in_stock").isNotNull(), F.col("sort").isNotNull()]
    entity = reduce(lambda a, b: a | b, kinds)
    evidence = reduce(lambda a, b: a + b, [k.cast("int") for k in [*kinds, asks, F.col("query") != ""]])
    has = lambda phrases: F.regexp_like("_t", F.lit(pattern(phrases)))
    intent = F.lit("unknown")
    for name, phrases in reversed(words.last.items()):
        intent = F.when(has(phrases), name).otherwise(intent)
    intent = F.when(entity | asks | model, "search").otherwise(intent)
    for name, phrases in reversed(words.first.items()):
        hit = has(phrases) | F.regexp_like("_t", F.lit(r"^refresh(?: please)?$")) if name == "refresh" else has(phrases)
        intent = F.when(hit, name).otherwise(intent)
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    told = ready.withColumn("intent", intent)
    confidence = F.when(F.col("_t") == "", 0.0).when(F.col("intent") == "search", F.least(F.lit(0.99), 0.72 + 0.045 * evidence - F.when(F.col("_near"), 0.05).otherwise(0.0))).otherwise(F.try_element_at(sure, "intent"))
    own = lambda c: F.when(F.col("intent") == "search", F.col(c))
    listed = lambda c: F.when(F.col("intent") == "search", F.col(c)).otherwise(F.array().cast("array<string>"))
    return told.select(
        F.col("_id").alias(key), "intent", F.round(confidence, 6).alias("confidence"), own("category").alias("category"), listed("brands").alias("brands"), listed("excluded").alias("excluded"),
        *[own(f"_p.{c}").alias(c) for c in ("low", "high", "low_inclusive", "high_inclusive")], own("in_stock").alias("in_stock"), own("sort").alias("sort"), F.coalesce(own("query"), F.lit("")).alias("query"),
    )
