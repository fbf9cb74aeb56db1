"""Catalogue search: predicates, sort modes, facets, refinements and merges of product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(category_prefix: list[str] | None = None, brands: list[str] | None = None, excluded: list[str] | None = None, low: float | None = None, high: float | None = None, low_inclusive: bool = True, high_inclusive: bool = True, in_stock: bool | None = None, groups: list[list[str]] | None = None, path: str = "path", brand: str = "brand", price: str = "price", stock: str = "in_stock", text: str = "name") -> Column:
    """The conjunction of all given constraints. A null price fails a bound; unknown stock fails a demand for stock.

    groups: each must have one of its terms in the text.
    """
    out = F.lit(True)
    if category_prefix:
        out = out & F.coalesce(F.slice(F.transform(path, F.lower), 1, len(category_prefix)) == F.array(*[F.lit(p.lower()) for p in category_prefix]), F.lit(False))
    if brands:
        out = out & F.coalesce(F.lower(brand).isin([b.lower() for b in brands]), F.lit(False))
    if excluded:
        out = out & ~F.coalesce(F.lower(brand).isin([b.lower() for b in excluded]), F.lit(False))
    if low is not None:
        out = out & F.coalesce((F.col(price) >= low) if low_inclusive else (F.col(price) > low), F.lit(False))
    if high is not None:
        out = out & F.coalesce((F.col(price) <= high) if high_inclusive else (F.col(price) < high), F.lit(False))
    if in_stock is not None:
        out = out & F.coalesce(F.col(stock) == in_stock, F.lit(False))
    for group in groups or []:
        hit = F.lit(False)
        for term in group:
            hit = hit | F.lower(F.coalesce(text, F.lit(""))).contains(term.lower())
        out = out & hit
    return out


SORTS = ("relevance", "price_asc", "price_desc", "rating", "newest")


def order_by(mode: str, price: str = "price", score: str = "score", rating: str = "rating", updated: str = "updated", name: str = "name", key: str = "id") -> list[Column]:
    """Columns to sort by: nulls last in every mode, then name, then id."""
    head = {
        "relevance": [F.col(score).desc_nulls_last()],
        "price_asc": [F.col(price).asc_nulls_last()],
        "price_desc": [F.col(price).desc_nulls_last()],
        "rating": [F.col(rating).desc_nulls_last(), F.col(score).desc_nulls_last()],
        "newest": [F.col(updated).desc_nulls_last()],
    }[mode]
    return [*head, F.lower(F.col(name)).asc(), F.col(key).asc()]


def facets(products: DataFrame, prefix: list[str], path: str = "path", key: str = "id") -> DataFrame:
    """The next level under a prefix: name, products, has_children; by falling count, then name."""
    depth = len(prefix)
    at = F.slice(F.transform(path, F.lower), 1, depth) == F.array(*[F.lit(p.lower()) for p in prefix]).cast("array<string>") if depth else F.lit(True)
    rows = products.where(at & (F.size(path) > depth)).select(F.col(path)[depth].alias("name"), (F.size(path) > depth + 1).alias("more"), F.col(key).alias("key"))
    grouped = rows.groupBy(F.lower("name").alias("_low")).agg(F.min("name").alias("name"), F.count_distinct("key").alias("products"), F.bool_or("more").alias("has_children"))
    return grouped.drop("_low").orderBy(F.desc("products"), "name")


def distinct_values(products: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values ignoring case, the first spelling of each, sorted."""
    kept = products.where(F.col(column).isNotNull() & (F.trim(column) != ""))
    return kept.groupBy(F.lower(column).alias("low")).agg(F.min_by(column, order).alias("value")).orderBy("low").select("value")


def discount(price: Column, original: Column) -> Column:
    """Share off the original price; 0 where there is none."""
    return F.when((original > 0) & (price < original), 1 - price / original).otherwise(0.0)


def cheaper(products: DataFrame, shown: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """Products strictly cheaper than the cheapest shown one of their group."""
    bound = shown.groupBy(*by).agg(F.min(price).alias("_bound"))
    return products.join(bound, by).where(F.col(price) < F.col("_bound")).drop("_bound")


def alternatives(products: DataFrame, chosen: DataFrame, by: str, k: int, price: str = "price", key: str = "id") -> DataFrame:
    """For each chosen product the k cheapest strictly cheaper ones of its group: chosen_id, key, price, rank.

    Whatever is among the k cheapest of those below a price is among the k cheapest of the group, so
    only k rows of each group meet the chosen ones.
    """
    low = products.where(F.col(price).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(price, key))).where(F.col("rank") <= k)
    mine = products.select(F.col(key).alias("_id"), F.col(by).alias("_by"), F.col(price).alias("_price")).join(chosen.select(F.col(key).alias("chosen_id")), F.col("_id") == F.col("chosen_id"))
    return mine.join(low, (F.col("_by") == F.col(by)) & (F.col(price) < F.col("_price"))).select("chosen_id", key, price, "rank")


def recommended(products: DataFrame, group: list[str], order: list[Column], k: int, seed: int, key: str = "id", pool: tuple[int, int] = (15, 50)) -> DataFrame:
    """k of each group's best pool (at least k, 15 and at most 50), by a seeded hash; shown in rank order."""
    size = min(max(k, pool[0]), pool[1])
    best = products.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= size)
    drawn = best.withColumn("_draw", F.row_number().over(Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)))
    return drawn.where(F.col("_draw") <= k).drop("_draw")


def carried_forward(current: DataFrame, previous: DataFrame, key: str, detail: list[str]) -> DataFrame:
    """Current rows; a detail column that is null or empty takes the previous snapshot's value."""
    old = previous.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in detail])
    joined = current.join(old, current[key] == old["_key"], "left")
    value = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return joined.select(*[F.coalesce(value(c), F.col(f"_{c}")).alias(c) if c in detail else F.col(c) for c in current.columns])


def retried(existing: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Rows of the retry in place of the existing ones of the same key; unknown ones are added."""
    return existing.join(retry.select(key), key, "left_anti").unionByName(retry)


def first_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
