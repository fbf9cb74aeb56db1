"""Entries of a content store: JSON trees of no fixed schema whose parts point at other entries and at assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions import udfs
from corvane.operators.stored import Tables

#: The patterns of an amount of money, sign first, sign last, and with a dash for no cents.
PRICE = r"(?i)(?:฿|THB[ \t]*|บาท[ \t]*)([0-9][0-9,]*(?:[.][0-9]{1,2})?)|([0-9][0-9,]*(?:[.][0-9]{1,2})?)[ \t]*(?:บาท|฿)|([0-9][0-9,]*)[ \t]*[.][ \t]*-"
#: Words of a promotion's days and dates.
DAYS, DATES = "ใช้ได้: ", "ช่วงโปรโมชัน: {} ถึง {}"


def leaves(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, kind, value: every scalar of each row's JSON text, at whatever depth; positions in lists are [i] from 0.

    Null and broken texts and empty objects and lists have no row; a JSON null has kind null. Each level is written before the next is
    taken, so a plan stays small however deep the trees are, and only what is still nested goes on.
    """
    spark = rows.sparkSession
    space = Tables(spark, "trees")
    level = spark.sql(f"SELECT `{key}` AS _key, '$' AS path, v, schema_of_variant(v) AS _s FROM (SELECT `{key}`, try_parse_json(`{body}`) AS v FROM {{rows}}) WHERE v IS NOT NULL", rows=rows.select(key, F.col(body).cast("string").alias(body)))
    nested = F.col("_s").startswith("OBJECT") | F.col("_s").startswith("ARRAY")
    out, depth = [], 0
    while True:
        kept = space.save(level.select("_key", "path", F.col("v"), "_s"), f"level{depth}")
        kind = F.lower(F.regexp_replace("_s", r"\(.*", ""))
        out.append(kept.where(~nested).select(F.col("_key").alias(key), "path", F.when(kind == "void", "null").otherwise(kind).alias("kind"), F.expr("try_variant_get(v, '$', 'string')").alias("value")))
        inner = kept.where(nested)
        if inner.isEmpty():
            break
        level = spark.sql("SELECT _key, concat(path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) AS path, e.value AS v, schema_of_variant(e.value) AS _s FROM {inner}, LATERAL variant_explode(v) AS e", inner=inner)
        depth += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole


def price(text: Column) -> Column:
    """The first amount of money as ฿1,234.00; empty where there is none."""
    digits = F.coalesce(*[F.nullif(F.regexp_extract(text, PRICE, i), F.lit("")) for i in (1, 2, 3)])
    return F.coalesce(F.concat(F.lit("฿"), F.format_number(F.replace(digits, F.lit(","), F.lit("")).cast("double"), 2)), F.lit(""))


def public_url(url: Column) -> Column:
    """http(s) addresses without query and fragment; empty for all else."""
    return F.when(F.regexp_like(url, F.lit(r"^https?://[^/?#]+")), F.regexp_replace(url, r"[?#].*$", "")).otherwise(F.lit(""))


def links(entries: DataFrame, field: str) -> DataFrame:
    """entry_id, pos, target: the entries or assets that a field of the body (parsed: ``tree``) points at, in order.

    A field holds one link or a list of them: {"sys": {"id": ...}}. Other things in it point nowhere.
    """
    # one link is a list of one
    listed = F.expr(f"coalesce(try_variant_get(tree, '$.fields.{field}', 'array<variant>'), array(try_variant_get(tree, '$.fields.{field}', 'variant')))")
    each = entries.select("entry_id", F.posexplode(listed).alias("pos", "_l"))
    return each.select("entry_id", "pos", F.expr("try_variant_get(_l, '$.sys.id', 'string')").alias("target")).where("target is not null")


def records(entries: DataFrame, assets: DataFrame, known: dict[str, tuple[str, list[str]]], now: Column, menu_url: str, promotion_url: str, site: str) -> DataFrame:
    """entry_id, id, kind, name, price, description, aliases, components, image_url, url of each entry that is a record.

    entries: (entry_id, type, body), ids unique, body a JSON text; assets: (asset_id, url). Types:
    ``page``: rich text in fields.body; a menu item if it shows a price; the first segment is the name, the others without that price the
    description. ``item``: a menu item if its fields.itemName, without a note in brackets at the end, is in ``known`` (lower case: name and
    aliases) and it has a description. ``promotion``: needs a headline or displayTitle and ``now`` within its dates; open ends hold.
    Components are the named entries that fields.components points at, once each in order; the image is the first asset of fields.image.
    Broken bodies, other types and nulls give no row; links that point nowhere are left out. Links meet entries and assets by key.
    """
    spark = entries.sparkSession
    space = Tables(spark, "cms")
    parsed = space.save(spark.sql("SELECT entry_id, type, try_parse_json(body) AS tree FROM {e} WHERE entry_id IS NOT NULL", e=entries.select(F.col("entry_id").cast("string").alias("entry_id"), "type", "body")).where("tree is not null"), "parsed")
    own = lambda name: t.clean(F.coalesce(F.expr(f"try_variant_get(tree, '$.fields.{name}', 'string')"), F.lit("")))
    either = lambda *names: F.coalesce(*[F.nullif(own(n), F.lit("")) for n in names], F.lit(""))
    titles = parsed.select(F.col("entry_id").alias("target"), either("headline", "displayTitle", "itemName", "name").alias("_title")).where("_title != ''")
    met = links(parsed, "components").join(titles, "target").groupBy("entry_id", "_title").agg(F.min("pos").alias("pos"))
    parts = met.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_title"))), lambda x: x["_title"]).alias("components"))
    pictures = assets.select(F.col("asset_id").cast("string").alias("target"), public_url(F.col("url")).alias("_url")).where("_url != ''")
    images = links(parsed, "image").join(pictures, "target").groupBy("entry_id").agg(F.min_by("_url", "pos").alias("image_url"))

    # pages
    spoken = F.filter(F.transform(udfs.rich_text(F.expr("to_json(try_variant_get(tree, '$.fields.body', 'variant'))")), lambda x: t.clean(x)), lambda x: x != "")
    pages = parsed.where("type = 'page'").select("entry_id", "tree", spoken.alias("_s")).where("size(_s) > 0").withColumn("price", price(F.array_join("_s", " "))).where("price != ''")
    rest = F.filter(F.slice(F.col("_s"), 2, F.size("_s")), lambda x: price(x) != F.col("price"))
    menu = pages.select("entry_id", F.lit("menu").alias("kind"), F.col("_s")[0].alias("name"), "price", F.array_join(rest, "\n").alias("description"), F.array(own("name"), F.col("_s")[0]).alias("aliases"), F.lit(menu_url).alias("url"))

    # items that are known by another name
    table = F.create_map(*[x for k, (name, aliases) in known.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, aliases)).cast("array<string>").alias("aliases")))])
    named = parsed.where("type = 'item'").select("entry_id", own("itemName").alias("_n"), either("longDescription", "shortDescription").alias("description"))
    named = named.withColumn("_k", F.try_element_at(table, F.lower(F.regexp_replace("_n", r"\s*\([^)]*\)\s*$", "")))).where("_k is not null and description != ''")
    items = named.select("entry_id", F.lit("menu"), "_k.name", F.lit(""), "description", F.concat(F.array("_n"), F.col("_k.aliases")), F.lit(menu_url))

    # promotions of the day
    start, end = own("startDate"), own("endDate")
    moment = lambda c: F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    within = F.coalesce(moment(start) <= now, F.lit(True)) & F.coalesce(moment(end) >= now, F.lit(True))
    days = F.expr("try_variant_get(tree, '$.fields.applicableDays', 'array<string>')")
    before, middle = DATES.split("{}")[:2]
    shown = lambda c: F.when(c == "", "-").otherwise(c)
    told = F.array(own("subHeadline"), own("description"), own("noteLine"), F.when(F.size(days) > 0, F.concat(F.lit(DAYS), F.array_join(days, ", "))), F.when((start != "") | (end != ""), F.concat(F.lit(before), shown(start), F.lit(middle), shown(end))))
    goal = own("onClick")
    address = F.when(goal == "", F.lit(promotion_url)).when(F.regexp_like(goal, F.lit("^https?://")), goal).otherwise(F.concat(F.lit(site.rstrip("/") + "/"), F.ltrim(goal, F.lit("/"))))
    offers = parsed.where("type = 'promotion'").where(within).select("entry_id", either("headline", "displayTitle").alias("name"), F.array_join(F.filter(told, lambda x: F.coalesce(x, F.lit("")) != ""), "\n").alias("description"), own("subHeadline").alias("_sub"), address.alias("url")).where("name != ''")
    promotions = offers.select("entry_id", F.lit("promotion"), "name", price(F.concat_ws(" ", "name", "description")), "description", F.array("name", "_sub"), "url")

    both = menu.unionAll(items).unionAll(promotions).join(parts, "entry_id", "left").join(images, "entry_id", "left")
    whole = both.withColumn("components", F.coalesce("components", F.array().cast("array<string>"))).withColumn("image_url", F.coalesce("image_url", F.lit("")))
    aliases = F.array_distinct(F.filter("aliases", lambda x: F.coalesce(x, F.lit("")) != ""))
    identity = F.substring(F.sha1(F.concat_ws("\x1f", "kind", "name", "description", "url", F.to_json("components"))), 1, 16)
    return whole.select("entry_id", identity.alias("id"), "kind", "name", "price", "description", aliases.alias("aliases"), "components", "image_url", "url")
