"""Retrieval, classification and text-overlap metrics, and percentiles by each convention in use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Tables

#: Brackets that are broadcast at most; beyond that they are joined by key.
MANY = 100_000
#: Bins of a histogram of a group, and the accuracy of its ends.
BINS, ACCURACY = 500, 5000


def target_ranks(ranked: DataFrame, gold: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, rank): the best rank of a gold item of each query; null where none was found."""
    hits = ranked.join(gold.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.min("rank").alias("rank"))
    return gold.select(query).distinct().join(hits, query, "left")


def hit_and_mrr(ranks: DataFrame, k: int) -> DataFrame:
    """One row: hit_at_1, hit_at_k, mrr_at_k over all queries, mean_rank over those found."""
    found = F.coalesce(F.col("rank") <= k, F.lit(False))
    return ranks.agg(
        F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("hit_at_1"),
        F.round(F.avg(F.when(found, 1.0).otherwise(0.0)), 6).alias("hit_at_k"),
        F.round(F.avg(F.when(found, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_at_k"),
        F.round(F.avg("rank"), 6).alias("mean_rank"),
        F.count("*").alias("queries"),
    )


def recall_of_evaluable(ranks: DataFrame, gold: DataFrame, index: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """One row: recall over the queries whose gold is in the index, and how many those are."""
    able = gold.join(index.select(item).distinct(), item, "left_semi").select(query).distinct()
    return ranks.join(able, query, "left_semi").agg(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("recall"), F.count("*").alias("evaluable"))


def token_overlap(pairs: DataFrame, key: str, answer: Column, reference: Column) -> DataFrame:
    """key, precision, recall, f1 over the multisets of tokens (arrays); 0 where they share none."""
    a = pairs.select(key, F.explode(answer).alias("t")).groupBy(key, "t").agg(F.count("*").alias("x"))
    b = pairs.select(key, F.explode(reference).alias("t")).groupBy(key, "t").agg(F.count("*").alias("y"))
    shared = a.join(b, [key, "t"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("_shared"))
    sized = pairs.select(key, F.size(answer).alias("_a"), F.size(reference).alias("_b")).join(shared, key, "left").withColumn("_shared", F.coalesce("_shared", F.lit(0)))
    p = F.when(F.col("_a") > 0, F.col("_shared") / F.col("_a")).otherwise(0.0)
    r = F.when(F.col("_b") > 0, F.col("_shared") / F.col("_b")).otherwise(0.0)
    return sized.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.when(F.col(actual).eqNullSafe(F.col(predicted)), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("n"))


def multilabel(df: DataFrame, sample: str, label: str, actual: str, predicted: str) -> DataFrame:
    """One row of multi-label metrics from (sample, label, actual, predicted) with 0/1 values of every cell."""
    t, p = F.col(actual), F.col(predicted)
    cells = df.select(sample, label, (t * p).alias("tp"), (p * (1 - t)).alias("fp"), (t * (1 - p)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    micro = cells.agg(*sums, F.avg(F.col("fp") + F.col("fn")).alias("hamming")).select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("micro_p"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("micro_r"), f1.alias("micro_f1"), "hamming")
    macro = cells.groupBy(label).agg(*sums).agg(F.avg(f1).alias("macro_f1"))
    each = cells.groupBy(sample).agg(*sums)
    jaccard = ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
    samples = each.agg(F.avg(f1).alias("samples_f1"), F.avg(jaccard).alias("jaccard"), F.avg(F.when(F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0)).alias("exact_match"))
    one = micro.crossJoin(F.broadcast(macro)).crossJoin(F.broadcast(samples))  # one row each
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def threshold_search(df: DataFrame, label: str, actual: str, probability: str, low: float = 0.15, high: float = 0.75, step: float = 0.05) -> DataFrame:
    """label, threshold, f1: the first best threshold of each label on a grid of a fixed number of steps."""
    count = round((high - low) / step)
    grid = F.explode(F.array(*[F.lit(round(low + i * step, 10)) for i in range(count + 1)]))
    judged = df.select(label, F.col(actual).alias("t"), F.col(probability).alias("p"), grid.alias("threshold"))
    hit = (F.col("p") >= F.col("threshold")).cast("int")
    sums = judged.groupBy(label, "threshold").agg(F.sum(F.col("t") * hit).alias("tp"), F.sum(hit).alias("called"), F.sum("t").alias("real"))
    f1 = F.when(F.col("called") + F.col("real") > 0, 2 * F.col("tp") / (F.col("called") + F.col("real"))).otherwise(0.0)
    scored = sums.select(label, "threshold", F.round(f1, 6).alias("f1"))
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("f1"), "threshold"))).where("_n = 1").drop("_n")


def binarised(df: DataFrame, sample: str, label: str, probability: str, threshold: str) -> DataFrame:
    """Adds predicted: over the threshold, or the sample's best label where none is."""
    over = Window.partitionBy(sample)
    hit = F.col(probability) >= F.col(threshold)
    best = F.row_number().over(over.orderBy(F.desc(probability), label))
    some = F.max(hit).over(over)
    return df.withColumn("predicted", F.when(some, hit).otherwise(best == 1).cast("int"))


def joint(df: DataFrame, intent: str, guess: str, gold: str, found: str, gate: float) -> DataFrame:
    """One row: intent accuracy, precision, recall and F1 of atoms (1 where there are none), both right at once, passed."""
    same = F.col(intent) == F.col(guess)
    s = df.agg(
        F.avg(same.cast("int")).alias("i"),
        F.sum(F.size(F.array_intersect(gold, found))).alias("hit"),
        F.sum(F.size(found)).alias("f"),
        F.sum(F.size(gold)).alias("g"),
        F.avg((same & (F.array_sort(gold) == F.array_sort(found))).cast("int")).alias("j"),
    )
    s = s.withColumn("p", F.when(F.col("f") == 0, 1.0).otherwise(F.col("hit") / F.col("f"))).withColumn("r", F.when(F.col("g") == 0, 1.0).otherwise(F.col("hit") / F.col("g")))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return s.select(F.round("i", 6).alias("intent_accuracy"), F.round("p", 6).alias("atom_precision"), F.round("r", 6).alias("atom_recall"), F.round(f1, 6).alias("atom_f1"), F.round("j", 6).alias("joint_accuracy"), ((F.col("i") > gate) & (F.col("j") > gate)).alias("passed"))


def markdown_row(*cells: Column) -> Column:
    """``| a | b |``."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def _met(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """Values inside the brackets of their group (_g, open interval _lo to _hi, null for no end), with the bracket's columns."""
    near = F.broadcast(brackets) if brackets.count() <= MANY else brackets
    inside = (F.col("b._lo").isNull() | (F.col("_v") > F.col("b._lo"))) & (F.col("b._hi").isNull() | (F.col("_v") < F.col("b._hi")))
    return values.alias("v").join(near.alias("b"), F.col("v._g").eqNullSafe(F.col("b._g")) & inside).select("_v", *[F.col(f"b.{c}").alias(c) for c in brackets.columns])


def _narrowed(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """The ranks with their bracket cut by a histogram of about equal bins, or with the value they have (_found).

    The histogram only proposes two ends around the ranks; values before, at, between and after them are counted, so a rank's new bracket
    is right whatever the histogram's error, and each round leaves out at least the two ends.
    """
    brackets = ranks.groupBy("_g", "_lo", "_hi", "_under", "_n").agg(F.min("_rank").alias("_from"), F.max("_rank").alias("_to"))
    key = brackets.columns
    parts = _met(values, brackets).groupBy(*key).agg(F.percentile_approx("_v", [i / BINS for i in range(BINS + 1)], ACCURACY).alias("_s"))
    place = lambda rank, step: F.least(F.lit(BINS), F.greatest(F.lit(0), (F.floor((F.col(rank) - F.col("_under")) * BINS / F.col("_n")) + step))).cast("int")
    ends = parts.select(*key, F.get("_s", place("_from", -1)).alias("_a"), F.get("_s", place("_to", 2)).alias("_b"))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counted = _met(values, ends).groupBy(*ends.columns).agg(F.count_if(v < a).alias("_n0"), F.count_if(v == a).alias("_n1"), F.count_if((v > a) & (v < b)).alias("_n2"), F.count_if((v == b) & (v > a)).alias("_n3"), F.count_if(v > b).alias("_n4"))
    same = F.col("r._g").eqNullSafe(F.col("c._g")) & F.col("r._lo").eqNullSafe(F.col("c._lo")) & F.col("r._hi").eqNullSafe(F.col("c._hi"))
    both = ranks.alias("r").join(counted.alias("c"), same).select("r.*", *[F.col(f"c.{c}").alias(c) for c in ("_a", "_b", "_n0", "_n1", "_n2", "_n3", "_n4")])
    upto = [F.col("_under")]
    for i in range(4):
        upto.append(upto[-1] + F.col(f"_n{i}"))
    none = F.lit(None).cast("double")
    place = lambda lo, hi, under, n, found: F.struct(lo.alias("_lo"), hi.alias("_hi"), under.alias("_under"), n.alias("_n"), found.alias("_found"))
    nothing = F.lit(0).cast("long")
    cut = (
        F.when(F.col("_rank") <= upto[1], place(F.col("_lo"), a, upto[0], F.col("_n0"), none))
        .when(F.col("_rank") <= upto[2], place(none, none, nothing, nothing, a))
        .when(F.col("_rank") <= upto[3], place(a, b, upto[2], F.col("_n2"), none))
        .when(F.col("_rank") <= upto[4], place(none, none, nothing, nothing, b))
        .otherwise(place(b, F.col("_hi"), upto[4], F.col("_n4"), none))
    )
    return both.select("_g", "_rank", cut.alias("_c")).select("_g", "_rank", "_c.*")


def selected(values: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """_g, _rank, _found: the value of each wanted rank (from 1) of each group, exactly. values: (_g, _v); ranks: (_g, _rank, _n), a stored table, _n the group's size.

    Groups of more than ``most`` values are narrowed by rounds of histograms, whose rows aren't shuffled, until no bracket holds more; so no
    task orders more than ``most`` values of a group. Equal values are counted before they are ordered.
    """
    space = Tables(values.sparkSession, "ranks")
    none = F.lit(None).cast("double")
    state = ranks.select("_g", F.col("_rank").cast("long").alias("_rank"), none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_under"), "_n", none.alias("_found"))
    found, turn = [], 0
    while True:
        found.append(_ranked(values, state.where(F.col("_found").isNull() & (F.col("_n") <= most))))
        if turn:
            found.append(state.where(F.col("_found").isNotNull()).select("_g", "_rank", "_found"))
        wide = state.where(F.col("_found").isNull() & (F.col("_n") > most))
        if wide.isEmpty():
            return reduce(DataFrame.unionAll, found)
        turn += 1
        state = space.save(_narrowed(values, wide), f"ranks{turn}")
        left = state.where(F.col("_found").isNull()).groupBy("_g").agg(F.min(F.struct(F.col("_lo").isNotNull(), "_lo"))["_lo"].alias("_lo"), F.max(F.struct(F.col("_hi").isNull(), "_hi"))["_hi"].alias("_hi"))
        values = space.save(_met(values, left).select("_g", "_v"), f"values{turn}")


def _ranked(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """_g, _rank, _found by ordering the distinct values of each bracket."""
    key = ["_g", "_lo", "_hi", "_under"]
    counts = _met(values, ranks.select(*key).distinct()).groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*key).orderBy("_v")
    placed = counts.withColumn("_r", F.col("_under") + F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("p._g").eqNullSafe(F.col("r._g")) & F.col("p._lo").eqNullSafe(F.col("r._lo")) & F.col("p._hi").eqNullSafe(F.col("r._hi"))
    holds = (F.col("_rank") <= F.col("p._r")) & (F.col("_rank") > F.col("p._r") - F.col("p._c"))
    return placed.alias("p").join(ranks.alias("r"), same & holds).select("r._g", "_rank", F.col("_v").alias("_found"))


def percentiles(df: DataFrame, group: str, value: str, q: float, most: int = 200_000) -> DataFrame:
    """group, linear, nearest_rank, rounded_index: three conventions for one quantile, exact at every size. Null values don't count; null groups are one.

    Few large groups are narrowed by histograms first (``selected``): no task orders more than ``most`` values of a group.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    place = F.lit(q) * (F.col("_n") - 1)
    sized = values.groupBy("_g").agg(F.count("*").alias("_n")).select("_g", "_n", F.floor(place).alias("_low"), F.ceil(place).alias("_high"), (F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n"))) - 1).alias("_near"), F.bround(place).cast("long").alias("_round"))
    sized = Tables(df.sparkSession, "sizes").save(sized, "sizes")
    ranks = sized.select("_g", "_n", F.explode(F.array_distinct(F.array("_low", "_high", "_near", "_round"))).alias("_r")).select("_g", (F.col("_r") + 1).alias("_rank"), "_n")
    found = selected(values, ranks, most)
    at = lambda c: F.max(F.when(F.col("_rank") == F.col(c) + 1, F.col("_found")))
    both = sized.alias("s").join(found.alias("f"), F.col("s._g").eqNullSafe(F.col("f._g"))).groupBy(F.col("s._g").alias(group), "_n").agg(at("_low").alias("_a"), at("_high").alias("_b"), at("_near").alias("nearest_rank"), at("_round").alias("rounded_index"))
    return both.select(group, F.round(F.col("_a") + (place - F.floor(place)) * (F.col("_b") - F.col("_a")), 6).alias("linear"), "nearest_rank", "rounded_index")


def hash_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds valid: the first max(1, round(n * share)) rows in a seeded hash order. Keys are unique.

    Rows are counted by the first digits of their draw; a running sum over those counts names the digits that are
    taken whole, and only the rows of the one bin on the border are ordered.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    drawn = df.withColumn("_d", draw).withColumn("_bin", F.substring("_d", 1, 4))
    want = df.agg(F.greatest(F.lit(1), F.round(F.count("*") * share)).cast("long").alias("n")).first()["n"]
    held, border = 0, None
    for r in drawn.groupBy("_bin").agg(F.count("*").alias("n")).orderBy("_bin").collect():  # 65,536 bins at most
        if held + r["n"] > want:
            border = r["_bin"]
            break
        held += r["n"]
    if border is None:
        return drawn.withColumn("valid", F.lit(True)).drop("_d", "_bin")
    near = drawn.where(F.col("_bin") == border).select(F.col(key).alias("_k"), "_d").orderBy("_d", "_k").limit(want - held).select(F.col("_k"), F.lit(True).alias("_v"))
    return drawn.join(near, drawn[key] == near["_k"], "left").withColumn("valid", (F.col("_bin") < border) | F.coalesce("_v", F.lit(False))).drop("_k", "_v", "_d", "_bin")


def gram_counts(texts: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """gram, n, df: how often each gram stands in all texts, and how many ids have it. Rows of one id are gathered first, so no task holds pairs of a gram and an id."""
    whole = texts.select(F.col(id_col).alias("id"), grams.alias("g")).groupBy("id").agg(F.flatten(F.collect_list("g")).alias("g"))
    each = whole.select("id", "g", F.explode(F.array_distinct("g")).alias("gram"))
    times = F.size(F.filter("g", lambda x: x == F.col("gram")))
    return each.select("id", "gram", times.cast("long").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), F.count("id").alias("df"))


def full_ranks(scored: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """Adds rank: the place of every item of each query by score, ties to the larger item; a null score comes last."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), F.col(item).desc())))


def section_scores(ranked: DataFrame, targets: DataFrame, k: int, query: str = "query_id", section: str = "section", rank: str = "rank") -> DataFrame:
    """query, precision, recall, f1, mrr, hit_at_1, sections of each target's query, over the first k different sections of its ranking.

    ranked: (query, section, rank); a section counts where it comes first. targets: (query, section), one a query. Null sections are none.
    A query without a ranking scores zero.
    """
    firsts = ranked.where(F.col(section).isNotNull()).groupBy(query, section).agg(F.min(rank).alias("_first"))
    placed = firsts.withColumn("_place", F.row_number().over(Window.partitionBy(query).orderBy("_first", section))).where(F.col("_place") <= k)
    wanted = targets.select(query, F.col(section).alias("_target"))
    met = wanted.join(placed, query, "left").groupBy(query).agg(F.count("_place").alias("sections"), F.min(F.when(F.col(section) == F.col("_target"), F.col("_place"))).alias("_at"))
    hit = F.col("_at").isNotNull().cast("double")
    precision = F.when(F.col("sections") > 0, hit / F.col("sections")).otherwise(0.0)
    return met.select(
        query, F.round(precision, 6).alias("precision"), hit.alias("recall"), F.round(F.when(hit > 0, 2 * precision / (precision + 1)).otherwise(0.0), 6).alias("f1"),
        F.round(F.coalesce(1.0 / F.col("_at"), F.lit(0.0)), 6).alias("mrr"), F.coalesce(F.col("_at") == 1, F.lit(False)).cast("double").alias("hit_at_1"), "sections",
    )


def recall_of_codes(ranked: DataFrame, expected: DataFrame, k: int, query: str = "query_id", code: str = "code", rank: str = "rank") -> DataFrame:
    """query, recall: the share of a query's distinct expected codes among the first k of its ranking; without any expected code the query has no row."""
    near = ranked.where(F.col(rank) <= k).select(query, code).distinct().withColumn("_found", F.lit(1))
    return expected.select(query, code).where(F.col(code).isNotNull()).distinct().join(near, [query, code], "left").groupBy(query).agg(F.round(F.avg(F.coalesce("_found", F.lit(0))), 6).alias("recall"))


def faithfulness(answer: Column, evidence: Column, source_mark: str = "s") -> Column:
    """Share of an answer's distinct tokens (arrays) that the evidence has; tokens that begin with the mark of sources don't count. 0 without any."""
    own = F.filter(F.array_distinct(answer), lambda t: ~F.startswith(t, F.lit(source_mark)))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, evidence)) / F.size(own)).otherwise(0.0)


def containing_rate(rows: DataFrame, by: list[str], answer: Column, expected: Column) -> DataFrame:
    """by, rate, n: how often an answer contains what is expected, whatever the case; an empty expectation is in none."""
    held = (F.coalesce(expected, F.lit("")) != "") & F.contains(F.lower(answer), F.lower(expected))
    return rows.groupBy(*by).agg(F.round(F.avg(F.coalesce(held, F.lit(False)).cast("double")), 6).alias("rate"), F.count("*").alias("n"))
