"""Commands and questions: aliases, expansion, intents, sections by number, named products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from corvane.functions import text as t
from corvane.functions import udfs

from . import dictionary
from .folds import folded
from .similar import similar


def alias_matches(queries: DataFrame, aliases: DataFrame, query: str = "query_id", text: str = "text", fuzzy: float | None = None) -> DataFrame:
    """query, canonical, alias, score: the longest alias of each canonical name that a text mentions.

    aliases: alias, canonical. Latin aliases need word bounds, others are found anywhere; an automaton finds all of them in one pass.
    With ``fuzzy``, texts without any exact match take the best one at least that similar to a part of the text.
    """
    from .ranking import sent

    lowered = queries.select(query, F.lower(text).alias("_t"))
    names = aliases.select(F.lower("alias").alias("alias"), "canonical").distinct()
    exact = dictionary.found(lowered, names, query, "_t", "alias").join(names, F.col("term") == F.col("alias")).select(query, "alias", "canonical", F.lit(1.0).alias("score"))
    if fuzzy is not None:
        rest = lowered.join(exact.select(query).distinct(), query, "left_anti").crossJoin(sent(names)).withColumn("score", udfs.fragment_ratio("alias", "_t"))
        best = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(F.length("alias")), "alias")
        exact = exact.unionByName(rest.where(F.col("score") >= fuzzy).withColumn("_n", F.row_number().over(best)).where("_n = 1").select(query, "alias", "canonical", "score"))
    longest = Window.partitionBy(query, "canonical").orderBy(F.desc("score"), F.desc(F.length("alias")), "alias")
    return exact.withColumn("_n", F.row_number().over(longest)).where("_n = 1").select(query, "canonical", "alias", "score")


def typo_matches(queries: DataFrame, aliases: DataFrame, least: float = 0.84, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, canonical, alias, word, start, score: aliases that words of a text nearly are, besides those it mentions as they are.

    aliases: alias, canonical and ``place``, their order. A word of four letters or more that isn't a number takes the most similar one-word alias
    with the same first letter, at most two letters longer or shorter, and a ratio of ``least`` or more; of equal ones the first by place. A canonical name is
    taken once: not if the text mentions it, nor after an earlier word has taken it.
    """
    from .ranking import top_k

    lowered = queries.select(query, F.lower(text).alias("_t"))
    names = aliases.select(F.lower("alias").alias("alias"), "canonical", "place")
    exact = dictionary.found(lowered, names, query, "_t", "alias").join(names, F.col("term") == F.col("alias")).select(query, "canonical").distinct()
    words = lowered.select(query, F.posexplode(F.regexp_extract_all("_t", F.lit(r"([a-z0-9\u0E01-\u0E59]+)"))).alias("start", "word"))
    words = words.where(~F.regexp_like("word", F.lit("^[0-9]+$")) & (F.length("word") >= 4))
    short = names.where((F.length("alias") >= 4) & ~F.contains(F.col("alias"), F.lit(" ")))
    near = similar(words.select(F.col("word").alias("text")), short.select(F.col("alias").alias("text")), least, apart=2, initial=True)
    # of a word's near canonical names a text asks for one, besides those it mentions and those its other words take
    best = top_k(near.join(short, F.col("b") == F.col("alias")), ["a", "canonical"], [F.desc("ratio"), F.asc("place"), F.asc("alias")], 1, "_n").drop("_n")
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("ratio"), "place", "canonical", "alias")))
    mentions = exact.groupBy(query).agg(F.count("*").alias("_mentions"))
    asked = words.withColumn("_words", F.count("*").over(Window.partitionBy(query))).join(mentions, query, "left")
    enough = F.col("_n") <= F.col("_words") + F.coalesce("_mentions", F.lit(0))
    met = asked.join(best, (F.col("word") == F.col("a")) & enough).join(exact, [query, "canonical"], "left_anti")
    # what a word may take, best first; as few as there are aliases that near
    offers = met.groupBy(query, "start", "word").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("far"), "place", "canonical", "alias"))).alias("offers"))

    def take(seen: set | None, given: list) -> tuple[set, dict | None]:
        seen = seen or set()
        for offer in given:
            if offer["canonical"] not in seen:
                seen.add(offer["canonical"])
                return seen, {"canonical": offer["canonical"], "alias": offer["alias"], "score": -offer["far"]}
        return seen, None

    kind = StructType([StructField("canonical", StringType()), StructField("alias", StringType()), StructField("score", DoubleType())])
    return folded(offers, [query], ["start"], ["offers"], take, None, "_taken", kind).where("_taken is not null").select(query, "_taken.canonical", "_taken.alias", "word", "start", "_taken.score")


def expanded(question: Column, triggers: dict[str, list[str]]) -> Column:
    """The question with the terms of every trigger it contains, once each."""
    parts = [F.when(F.lower(question).contains(k.lower()), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in triggers.items()]
    added = F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")
    return F.when(F.size(added) > 0, F.concat(question, F.lit(" "), F.array_join(added, " "))).otherwise(question)


def intent(message: Column, rules: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """The first intent whose pattern the message has, in order of priority."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.regexp_like(F.lower(message), F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def confidence(evidence: Column, fuzzy: Column) -> Column:
    """0.72 and 0.045 for each piece of evidence, less 0.05 for each fuzzy one; 0.99 at most."""
    return F.least(F.lit(0.99), 0.72 + 0.045 * evidence - 0.05 * fuzzy)


def guarded(label: Column, message: Column, domain: str, fallback: str) -> Column:
    """A model's label only where the message is in the domain."""
    return F.when(F.regexp_like(F.lower(message), F.lit(domain)), label).otherwise(F.lit(fallback))


def numbered_sections(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """key, order, section: headings "n.m title" count only if they follow the last one: n.(m+1) or (n+1).1.

    Whether a heading counts depends on the last that did, so it is a fold over a key's ordered lines.
    """
    numbers = F.regexp_extract(line, r"^\s*([0-9]+\.[0-9]+)\s+\S", 1)
    part = lambda i: F.split_part(numbers, F.lit("."), F.lit(i)).try_cast("int")
    rows = lines.select(key, order, part(1).alias("_a"), part(2).alias("_b"))

    def step(last: tuple | None, a: int | None, b: int | None) -> tuple[tuple | None, str | None]:
        if a is not None and b is not None and (last is None or (a, b) in ((last[0], last[1] + 1), (last[0] + 1, 1))):
            last = (a, b)
        return last, None if last is None else f"{last[0]}.{last[1]}"

    return folded(rows, [key], [order, "_a", "_b"], ["_a", "_b"], step, None, "section", StringType()).select(key, order, "section")


def shared_budget(rows: DataFrame, group: list[str], order: str, size: str, budget: int, header: int) -> DataFrame:
    """Adds allowed: each row in turn gets an equal share of what is left, less its header, and leaves the rest to the next."""
    total = rows.groupBy(*group).agg(F.count("*").alias("_total"))
    sized = rows.select(*group, order, F.col(size).cast("long").alias("_n")).join(total, group)

    def step(state: tuple | None, n: int | None, turns: int) -> tuple[tuple, int]:
        left, done = state or (budget, 0)
        used = min(max(0, left // (turns - done) - header), n or 0)
        return (left - (used + header if used > 0 else 0), done + 1), used

    return folded(sized, group, [order, "_n"], ["_n", "_total"], step, None, "allowed", LongType()).select(*group, order, "allowed")


#: Names of more distinct tokens meet queries by their rarest tokens, one by one; those of fewer by classes of names that a query may hold.
CLASSED = 8


def parts_of(lengths: list[int]):
    """(query, part): the distinct parts of each text that have one of the lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                for n in lengths:
                    found = list({text[i : i + n] for i in range(len(text) - n + 1)})
                    for at in range(0, len(found), 10_000):
                        own = found[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(own))), batch.column(1).take(pa.array([row] * len(own))), pa.array(own, pa.string())], [*batch.schema.names, "part"])

    return run


def named_product(products: DataFrame, queries: DataFrame, key: str = "id", name: str = "name", query: str = "query_id", text: str = "text") -> DataFrame:
    """query, id, score: the one product a query names; none where several tie with different names.

    A contained name scores 2 and its length's share of the query; else at least three quarters of its
    tokens must be there.

    No product is compared with each query. Contained names are equal to a part of the query. The others meet by what a query may hold of
    them: every choice of three quarters or more of a name's asked tokens, on which all names of as many tokens that leave the same choice are
    one row (their number of names, one or more, and least id). Such a row meets the queries by its least asked token. Names of over CLASSED tokens, whose choices
    are too many, meet by their least asked tokens, as many as can't all be missing.
    """
    from .ranking import TERMS_SENT, sent

    asked = queries.select(query, F.lower(text).alias("_q"), F.array_distinct(t.tokens(F.col(text))).alias("_qt")).where("_q is not null")
    names = products.where(F.col(name).isNotNull()).select(F.col(key).alias("_id"), F.lower(name).alias("_n"), t.tokens(F.col(name)).alias("_nt")).groupBy("_n").agg(F.min("_id").alias("_id"), F.array_distinct(F.first("_nt")).alias("_nt"))
    lengths = [r[0] for r in names.select(F.length("_n")).distinct().collect()]  # a number a length
    kind = StructType([*asked.select(query, "_q").schema.fields, StructField("part", StringType())])
    cut = asked.select(query, "_q").where("_q != ''").mapInArrow(parts_of(sorted(lengths)), kind)
    score = F.round(2 + F.length("_n") / F.length("_q"), 6)
    held = cut.join(names, F.col("part") == F.col("_n")).select(query, score.alias("score"), F.col("_n").alias("low"), F.col("_n").alias("high"), "_id")
    # how many queries have a token; names keep those that any has
    tokens = asked.select(query, F.explode("_qt").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    wide = names.select("_n", "_id", F.size("_nt").alias("d"), F.explode("_nt").alias("token")).join(sent(often, TERMS_SENT), "token")
    kept = wide.groupBy("_n", "_id", "d").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("k")).where(F.size("k") / F.col("d") >= 0.75)
    chosen = F.expr("filter(sequence(1, shiftleft(1, size(k)) - 1), m -> bit_count(m) / d >= 0.75)")
    some = kept.where(F.col("d") <= CLASSED).select("_n", "_id", "d", "k", F.explode(chosen).alias("m"))
    classes = some.select("_n", "_id", "d", F.expr("transform(filter(k, (x, i) -> (shiftright(m, i) & 1) = 1), x -> x.token)").alias("c"))
    classes = classes.groupBy("c", "d").agg(F.min("_n").alias("low"), F.max("_n").alias("high"), F.min("_id").alias("_id")).withColumn("token", F.col("c")[0])
    # the least asked tokens of a long name: of those kept, all but the number needed less one
    need = F.ceil(0.75 * F.col("d") - 1e-9)
    first = F.slice("k", F.lit(1), (F.size("k") - need + 1).cast("int"))
    long = kept.where(F.col("d") > CLASSED).select(F.col("k")["token"].alias("c"), "d", F.col("_n").alias("low"), F.col("_n").alias("high"), "_id", F.explode(F.transform(first, lambda x: x["token"])).alias("token"))
    met = classes.select("c", "d", "low", "high", "_id", "token").unionAll(long).join(tokens.join(asked.select(query, "_qt"), query), "token")
    share = F.size(F.array_intersect("c", "_qt")) / F.col("d")
    whole = (F.size("c") == F.size(F.array_intersect("c", "_qt"))) | (F.col("d") > CLASSED)
    shared = met.where(whole).select(query, F.round(share, 6).alias("score"), "low", "high", "_id", share.alias("_s")).where("_s >= 0.75").drop("_s")
    best = held.unionAll(shared).groupBy(query, "score").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("_id").alias("_id"))
    top = best.groupBy(query).agg(F.max(F.struct("score", "low", "high", "_id")).alias("m"))
    return top.where("m.low = m.high").select(query, F.col("m._id").alias(key), F.col("m.score").alias("score"))


def reconciled_brand(brand: Column, name: Column, url: Column, known: list[str]) -> Column:
    """The one known brand that both name and address hold as a word; else the given brand."""
    brands = F.array(*[F.lit(b) for b in known]).cast("array<string>")
    both = F.filter(brands, lambda b: t.mentions(name, b) & t.mentions(F.regexp_replace(url, "[-_/]", " "), b))
    return F.when(F.size(both) == 1, both[0]).otherwise(brand)


def localised(values: Column, language: str) -> Column:
    """Of an array of structs (lang, value), the value of a language, else the first that isn't empty."""
    filled = F.filter(values, lambda v: F.trim(v["value"]) != "")
    own = F.filter(filled, lambda v: v["lang"] == language)
    return F.coalesce(F.try_element_at(own, F.lit(1))["value"], F.try_element_at(filled, F.lit(1))["value"])


def minor_price(values: Column) -> Column:
    """The first positive amount of an array in minor units, as major ones."""
    return F.try_element_at(F.filter(values, lambda v: v > 0), F.lit(1)) / 100.0


def looked_up(asked: DataFrame, catalogue: DataFrame, query: str = "query_id", text: str = "text", key: str = "id", name: str = "name", aliases: str | None = None) -> DataFrame:
    """query, id, by: the item that a text names by its id, else by a normalised or compact name or alias; no row where none does.

    An id goes before a name, and of several items of a name the smallest id is taken. Names and texts meet by equal keys, so nothing is compared in pairs.
    """
    label = F.explode(F.concat(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>"))) if aliases else F.array(name))
    names = catalogue.select(F.col(key).alias("_id"), label.alias("_l")).where("_l is not null")
    ways = lambda c: F.array(F.struct(F.lit("name").alias("by"), t.normalised(c).alias("k")), F.struct(F.lit("compact").alias("by"), t.unspaced(c).alias("k")))
    keys = names.select("_id", F.explode(ways(F.col("_l"))).alias("w")).select("_id", "w.by", "w.k").where("k != ''")
    keys = keys.unionAll(catalogue.select(F.col(key).alias("_id"), F.lit("id"), F.trim(F.col(key).cast("string")))).groupBy("by", "k").agg(F.min("_id").alias("_id"))
    wanted = asked.where(F.col(text).isNotNull()).select(query, F.explode(F.concat(F.array(F.struct(F.lit("id").alias("by"), F.trim(text).alias("k"))), ways(F.col(text)))).alias("w"))
    found = wanted.select(query, "w.by", "w.k").where("k != ''").join(keys, ["by", "k"])
    # name and compact are one step: the smaller id of either
    order = F.struct((F.col("by") != "id").alias("later"), "_id", (F.col("by") == "compact").alias("loose"), "by")
    return found.groupBy(query).agg(F.min(order).alias("_m")).select(query, F.col("_m._id").alias(key), F.col("_m.by").alias("by"))


def conversation_key(parts: list[Column]) -> Column:
    """A hash of the parts that scope a conversation; null where one is missing or empty."""
    whole = F.lit(True)
    for part in parts:
        whole &= F.coalesce(F.trim(part.cast("string")) != "", F.lit(False))
    return F.when(whole, F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256))


#: Names that stand for a class of things, not for one.
GENERIC = ["malware", "tool", "tools", "technique", "techniques", "mitigation", "mitigations", "group", "groups", "threat actor"]
CODE = re.compile(r"[a-z]\d{4}(?:\.\d{3})?")


def spoken(text: str, begin: int, end: int) -> bool:
    """Terms stand between other signs than letters, digits and underscores; a code is no part of a longer code."""
    word = lambda c: c.isalnum() or c == "_"
    before, after = text[begin - 1 : begin] if begin else "", text[end : end + 1]
    if CODE.fullmatch(text, begin, end):
        return not (before and (word(before) or before == ".")) and not (after and word(after)) and not (after == "." and text[end + 1 : end + 2].isdigit())
    return not (before and word(before)) and not (after and word(after))


def seeds(questions: DataFrame, catalogue: DataFrame, hits: DataFrame, query: str = "query_id", text: str = "text", key: str = "id", terms: str = "terms", explicit: str | None = None) -> DataFrame:
    """query, id, source: the entities a question names ("mention"), or, where it names none, those its vector search found ("vector"), each once.

    catalogue: (id, terms), terms an array of names, codes and aliases; hits: (query, id). Terms under three letters and generic ones aren't
    looked for. ``explicit``: a column of the questions with the name asked for; where it is given only an equal term counts, and vector hits
    don't stand in for it. Case never matters; null questions name nothing. Names are found by an automaton, so nothing is compared in pairs.
    """
    own = catalogue.select(F.col(key).alias("_id"), F.explode(terms).alias("_l")).select("_id", F.lower("_l").alias("term")).where("term is not null").distinct()
    usable = own.where((F.length("term") >= 3) & ~F.col("term").isin(GENERIC))
    given = F.lower(explicit) if explicit else F.lit(None).cast("string")
    asked = questions.select(query, F.lower(text).alias("_t"), given.alias("_given"))
    free = asked.where("_given is null")
    met = dictionary.found(free.select(query, "_t"), usable, query, "_t", "term", spoken).join(usable, "term").select(query, "_id")
    named = met.unionAll(asked.where("_given is not null").join(own, F.col("_given") == F.col("term")).select(query, "_id")).distinct()
    rest = hits.select(query, F.col(key).alias("_id")).distinct().join(free.select(query).distinct(), query, "left_semi").join(named.select(query).distinct(), query, "left_anti")
    return named.withColumn("source", F.lit("mention")).unionAll(rest.withColumn("source", F.lit("vector"))).select(query, F.col("_id").alias(key), "source")


def label_matches(asked: DataFrame, catalogue: DataFrame, query: str = "query_id", text: str = "text", key: str = "id", labels: str = "labels", near: float | None = None) -> DataFrame:
    """query, id, by: items one of whose labels contains the text, spacing, signs and case aside ("part"); texts under two signs match nothing.

    labels: an array. With ``near`` (over 2/3), texts that no label contains take the items that have a label of at least that sequence ratio ("near").
    Texts are the dictionary that each label is searched for, and both are compared once however often they repeat.
    """
    from .ranking import TERMS_SENT, sent

    wanted = asked.select(query, t.compact(F.col(text)).alias("_q")).where(F.length("_q") >= 2)
    owned = catalogue.select(F.col(key).alias("_id"), F.explode(labels).alias("_l")).select("_id", t.compact(F.col("_l")).alias("_l")).where("_l != ''").distinct()
    met = dictionary.found(owned.select("_l").distinct().withColumn("_k", F.col("_l")), wanted, "_k", "_l", "_q", dictionary.anywhere)
    texts = met.select(F.col("_k").alias("_l"), F.col("term").alias("_q"), F.lit("part").alias("by"))
    if near is not None:
        rest = wanted.select("_q").distinct().join(texts.select("_q").distinct(), "_q", "left_anti")
        alike = similar(rest.select(F.col("_q").alias("text")), owned.select(F.col("_l").alias("text")), near)
        texts = texts.unionAll(alike.select(F.col("b").alias("_l"), F.col("a").alias("_q"), F.lit("near").alias("by")))
    # items and texts meet once; what is left are result rows, which no shuffle sees but those of queries of several texts
    met = texts.join(owned, "_l").select("_q", F.col("_id").alias(key), "by").distinct()
    once = wanted.distinct()
    several = once.groupBy(query).agg(F.count("*").alias("_n")).where("_n > 1").select(query)
    alone, more = once.join(several, query, "left_anti"), once.join(several, query, "left_semi")
    return met.join(sent(alone, TERMS_SENT), "_q").select(query, key, "by").unionAll(met.join(sent(more, TERMS_SENT), "_q").select(query, key, "by").distinct())
