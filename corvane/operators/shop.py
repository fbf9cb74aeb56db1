"""Rules of a catalogue assistant: kinds by alias tables, brands, fallback keys, nested menus, cascades, fair draws.

Alias tables are parameters (kind -> aliases) and become expressions, so a row is judged in its own task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.functions import udfs


def held(text: Column, aliases: list[str]) -> Column:
    """Whether a text holds any alias: Latin ones as words, others anywhere. False for a null text."""
    out = F.lit(False)
    for alias in aliases:
        out = out | (t.mentions(text, F.lit(alias)) if alias.isascii() else F.contains(F.lower(text), F.lit(alias.lower())))
    return F.coalesce(out, F.lit(False))


def kinds(text: Column, table: dict[str, list[str]]) -> Column:
    """The kinds of which a text holds the name or an alias, in the table's order."""
    return F.filter(F.array(*[F.when(held(text, [k, *v]), F.lit(k)) for k, v in table.items()]), lambda k: k.isNotNull())


def category_matches(leaf: Column, name: Column, request: Column, table: dict[str, list[str]]) -> Column:
    """A leaf of a requested kind matches; a leaf of other known kinds doesn't; else the name decides. Requests without a kind match all."""
    wanted, own = kinds(request, table), kinds(leaf, table)
    return F.when(F.size(wanted) == 0, True).when(F.arrays_overlap(own, wanted), True).when(F.size(own) > 0, False).otherwise(F.arrays_overlap(kinds(name, table), wanted))


def subtype_matches(name: Column, request: Column, table: dict[str, list[str]]) -> Column:
    """A request that names a subtype takes only products whose own name has it."""
    wanted = kinds(request, table)
    return (F.size(wanted) == 0) | F.arrays_overlap(kinds(name, table), wanted)


def accessory_matches(name: Column, request: Column, asked: dict[str, list[str]], made: dict[str, list[str]]) -> Column:
    """A request for an accessory takes its kind alone; any other request takes no accessory."""
    wanted, own = kinds(request, asked), kinds(name, made)
    return F.when(F.size(wanted) > 0, F.arrays_overlap(own, wanted)).otherwise(F.size(own) == 0)


def base_identity(leaf: Column, name: Column, prefixes: list[str], denied: list[str]) -> Column:
    """A leaf with one of the prefixes, and none of the denied words in the name."""
    starts = F.lit(False)
    for prefix in prefixes:
        starts = starts | F.lower(leaf).startswith(prefix)
    return starts & ~held(name, denied)


def judged_once(rows: DataFrame, columns: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``judge`` of rows, where it looks at ``columns`` only: if there are few different values (QUERIES_SENT), each is judged once and joined back."""
    from .ranking import QUERIES_SENT

    texts = rows.select(*columns).distinct()
    if texts.limit(QUERIES_SENT + 1).count() > QUERIES_SENT:
        return judge(rows)
    judged = judge(texts).withColumnsRenamed({c: f"_{c}" for c in columns})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return rows.join(F.broadcast(judged), same).drop(*[f"_{c}" for c in columns])


def brand_matches(brand: Column, wanted: Column, aliases: dict[str, list[str]], fuzzy: float | None = 0.84, least: int = 5) -> Column:
    """Whether a brand is the wanted one or one of its aliases: equal, or one within the other, or alike if both have ``least`` letters.

    All are compared in lower case without anything but letters and digits; an empty brand matches nothing.
    """
    own, target = t.compact(brand), t.compact(wanted)
    groups = [[k, *v] for k, v in aliases.items()]
    names = F.array(target)
    for group in groups:
        squeezed = F.array(*[t.compact(F.lit(x)) for x in group])
        names = F.when(F.array_contains(squeezed, target), squeezed).otherwise(names)
    hit = F.exists(names, lambda n: (n != "") & (F.contains(own, n) | F.contains(n, own)))
    if fuzzy is not None:
        alike = F.lit(False)
        for i in range(1 + max((len(g) for g in groups), default=0)):
            n = F.get(names, F.lit(i))
            alike = alike | ((F.least(F.length(own), F.length(n)) >= least) & (udfs.sequence_ratio(own, n) >= fuzzy))
        hit = hit | F.coalesce(alike, F.lit(False))
    return F.coalesce((own != "") & hit, F.lit(False))


def query_groups(text: Column, table: dict[str, list[str]], soft: list[str]) -> Column:
    """Groups of alternatives that a product must each meet: alias groups first, then every other word that isn't soft."""
    left = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    groups = []
    for name, aliases in table.items():
        hit = F.lit(None).cast("string")
        for alias in reversed([name, *aliases]):
            hit = F.when(t.mentions(left, F.lit(alias)), F.lit(alias)).otherwise(hit)
        groups.append(F.when(hit.isNotNull(), F.array(*map(F.lit, [name, *aliases]))))
        left = F.when(hit.isNotNull(), F.replace(left, hit, F.lit(" "))).otherwise(left)
    words = F.filter(F.array_distinct(t.tokens(left)), lambda w: ~w.isin(soft) & (F.length(w) >= 2))
    return F.concat(F.filter(F.array(*groups), lambda g: g.isNotNull()), F.transform(words, lambda w: F.array(w)))


def meets(groups: Column, text: Column) -> Column:
    """Whether a text holds one of each group."""
    low = F.lower(text)
    return F.forall(groups, lambda g: F.exists(g, lambda w: F.contains(low, w)))


def claimed(text: Column, pattern: str) -> Column:
    """The text with all matches of a pattern blanked, so that no later rule reads them."""
    return F.regexp_replace(text, pattern, " ")


def residual(text: Column, fillers: list[str], rounds: int = 8) -> Column:
    """What is left without fillers, which may form anew when others go; white space squeezed."""
    either = "|".join(sorted(fillers, key=lambda f: -len(f)))
    step = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, rf"(^|[^a-z])(?:{either})(?=[^a-z]|$)", "$1"), " +", " "))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), step(F.lower(text)), lambda acc, _: step(acc))


def phonetic(text: Column, finals: dict[str, str], marks: str, leading: str) -> Column:
    """Without marks, and the last letter of each word by its sound, unless a leading vowel stands before it."""
    table = F.create_map(*[F.lit(x) for kv in finals.items() for x in kv])

    def word(w: Column) -> Column:
        last, before = F.right(w, F.lit(1)), F.substring(w, -2, 1)
        kept = (F.length(w) > 1) & F.contains(F.lit(leading), before)
        return F.when((F.length(w) == 0) | kept, w).otherwise(F.concat(F.left(w, F.length(w) - 1), F.coalesce(F.try_element_at(table, last), last)))

    return F.array_join(F.transform(F.split(F.translate(F.lower(text), marks, ""), " "), word), " ")


def lexical_score(query: Column, name: Column, document: Column, sound=lambda c: c) -> Column:
    """The best of six rules: ratios, n-gram overlap, containment by spelling and by ``sound``, fragments alike."""
    low, title, body = F.lower(query), F.lower(name), F.lower(document)
    overlap = t.jaccard(t.character_ngrams(low), t.character_ngrams(body))
    blended = F.greatest(udfs.sequence_ratio(low, title), 0.65 * udfs.sequence_ratio(low, body) + 0.35 * overlap)
    spelled = F.when(F.contains(title, low), 0.98).when(F.contains(body, low), 0.76).otherwise(0.0)
    long = F.length(F.replace(sound(low), F.lit(" "), F.lit(""))) >= 4
    heard = F.when(long & F.contains(sound(title), sound(low)), 0.94).when(long & F.contains(sound(body), sound(low)), 0.74).otherwise(0.0)
    by_name, by_part = udfs.fragment_ratio(low, title), udfs.fragment_ratio(low, body)
    fragment = F.when(by_name >= 0.86, 0.72 + 0.24 * by_name).when(by_part >= 0.90, 0.52 + 0.24 * by_part).otherwise(0.0)
    return F.when(F.length(low) > 0, F.greatest(blended, spelled, heard, fragment)).otherwise(0.0)


def cascade(branches: list[tuple[str, Column, Column]], otherwise: str) -> Column:
    """struct(branch, answer) of the first branch that holds and has an answer."""
    out = F.struct(F.lit("none").alias("branch"), F.lit(otherwise).alias("answer"))
    for name, when, answer in reversed(branches):
        out = F.when(F.coalesce(when, F.lit(False)) & answer.isNotNull(), F.struct(F.lit(name).alias("branch"), answer.alias("answer"))).otherwise(out)
    return out


def field_answer(question: Column, fields: list[tuple[list[str], Column]], otherwise: Column) -> Column:
    """The field whose keywords the question holds, in order; a null field says so by ``otherwise``."""
    out = otherwise
    for words, value in reversed(fields):
        out = F.when(held(question, words), F.coalesce(value.cast("string"), otherwise)).otherwise(out)
    return out


def fallback_join(left: DataFrame, right: DataFrame, full: list[str], less: list[str], fill: list[str]) -> DataFrame:
    """Left rows with matched (full, less or null) and ``fill`` columns where theirs are null or empty.

    A key counts only where one right row has it; rows without a match by all fields are tried by fewer.
    """
    def unique(keys: list[str], name: str) -> DataFrame:
        one = right.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"), F.first(F.struct(*fill)).alias(name))
        return one.where("_n = 1").drop("_n")

    out = left
    for keys, name in ((full, "_full"), (less, "_less")):
        own = unique(keys, name)
        on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
        out = out.join(own, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    found = lambda c: F.coalesce(F.col(f"_full.{c}"), F.col(f"_less.{c}"))
    matched = F.when(F.col("_full").isNotNull(), "full").when(F.col("_less").isNotNull(), "less")
    kept = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c)).otherwise(found(c))
    return out.select(*[kept(c).alias(c) if c in fill else F.col(c) for c in left.columns], matched.alias("matched"))


def split_choices(groups: Column) -> tuple[Column, Column]:
    """Of an array of struct(name, options): names with one option are components, the others choices."""
    one = F.transform(F.filter(groups, lambda g: F.size(g["options"]) == 1), lambda g: g["options"][0])
    many = F.transform(F.filter(groups, lambda g: F.size(g["options"]) > 1), lambda g: F.concat(g["name"], F.lit(": "), F.array_join(g["options"], "/")))
    return one, many


def flattened(menus: DataFrame, menu: str, items: str) -> DataFrame:
    """Items of nested menus: visible ones with a name and a price, the first of each id of a menu."""
    listed = menus.select(menu, F.posexplode(items).alias("_at", "i")).select(menu, "_at", "i.*").where("visible and name is not null and name != '' and price is not null")
    return listed.withColumn("_n", F.row_number().over(Window.partitionBy(menu, "id").orderBy("_at"))).where("_n = 1").drop("_n", "_at")


def rating(text: Column) -> Column:
    """struct(rating, reviews, recommended) from a rendered line; null parts where it lacks them."""
    part = lambda pattern: F.regexp_extract(text, pattern, 1)
    return F.struct(part(r"([0-9](?:\.[0-9])?) */ *5").try_cast("double").alias("rating"), F.replace(part(r"([0-9,]+) reviews?"), F.lit(","), F.lit("")).try_cast("int").alias("reviews"), part(r"([0-9]+)% recommend").try_cast("int").alias("recommended"))


def enriched(rows: DataFrame, structured: DataFrame, rendered: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with value and origin: the structured record's, else the rendered one's, else null."""
    first = structured.select(key, F.col(value).alias("_s")).where("_s is not null")
    rest = rendered.join(first, key, "left_anti").select(key, F.col(value).alias("_r"))
    out = rows.join(first, key, "left").join(rest, key, "left")
    return out.withColumn(value, F.coalesce("_s", "_r")).withColumn("origin", F.when(F.col("_s").isNotNull(), "structured").when(F.col("_r").isNotNull(), "rendered")).drop("_s", "_r")


def fair_draw(pool: DataFrame, history: DataFrame, group: list[str], rank: str, key: str, k: int, seed: int, keep: int = 20) -> DataFrame:
    """k rows of each group's pool, least shown first and by a seeded hash, shown in rank order: group, key, rank, shown.

    history: group, at, ids (an array), the last ``keep`` records of each group count. If the drawn set was shown
    before, its most shown row gives way to the least shown row outside, when that makes a new set.
    """
    recent = history.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("at")))).where(F.col("_n") <= keep)
    shown = recent.select(*group, F.explode("ids").alias(key)).groupBy(*group, key).agg(F.count("*").alias("shown"))
    rows = pool.join(shown, [*group, key], "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    over = Window.partitionBy(*group)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = rows.withColumn("_place", F.row_number().over(over.orderBy("shown", draw, key)))
    # a pool is at most some tens of rows, so its ids fit one row
    inside = F.array_sort(F.collect_list(F.when(F.col("_place") <= k, F.col(key))))
    leaving = F.max_by(key, F.when(F.col("_place") <= k, F.struct("shown", (-F.col(key)).alias("_id"))))
    coming = F.min_by(key, F.when(F.col("_place") > k, F.struct("shown", key)))
    per = rows.groupBy(*group).agg(inside.alias("_set"), leaving.alias("_out"), coming.alias("_in"))
    sets = recent.groupBy(*group).agg(F.collect_set(F.array_sort("ids")).alias("_sets"))
    per = per.join(sets, group, "left")
    other = F.array_sort(F.concat(F.filter("_set", lambda x: x != F.col("_out")), F.array("_in")))
    again = lambda ids: F.coalesce(F.array_contains("_sets", ids), F.lit(False))
    swap = again(F.col("_set")) & F.col("_in").isNotNull() & ~again(other)
    chosen = per.select(*group, F.explode(F.when(swap, other).otherwise(F.col("_set"))).alias(key))
    return rows.join(chosen, [*group, key]).select(*group, key, rank, "shown")


def softmax(values: Column, temperature: float) -> Column:
    """Shares of an array of scores; the largest score is taken off first."""
    top = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp((v - top) / temperature))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """The share of rectangle a (left, top, right, bottom) that lies in b; 0 for an empty one."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, wide * high / area).otherwise(0.0)
