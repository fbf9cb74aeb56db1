"""Steps that compared all pairs or held a whole side in one task: their plans, and their results against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import metrics, nlp, ranking, shop, vectorindex
from corvane.plans import registry

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["intent_maxsim", "knn_identity_check", "support_ratio", "all_ranks"])
def test_vectors_meet_in_blocks(spark, name):
    plan = planned(registry.QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_largest_by_label_is_that_of_all_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=5)], None if i % 7 == 0 else i % 3) for i in range(60)] + [(60, None, 1), (61, [0.0] * 5, 2)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>, label int").repartition(5)
    queries = items.where("item_id % 10 < 2").withColumnRenamed("item_id", "query_id")
    for value in (vectorindex.products, vectorindex.cosines, vectorindex.gaps):
        got = {(x["query_id"], x["label"]): x["best"] for x in vectorindex.largest(queries, items, value, "label", itself=False).collect()}
        want = {}
        for q, v, _ in rows:
            for i, w, label in rows:
                if q % 10 < 2 and v and w and i != q:
                    one = float(value(np.array([v]), np.array([w]))[0, 0])
                    want[q, label] = max(one, want.get((q, label), -np.inf))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("sent", [200_000, 40])
def test_bm25_shuffles_no_pairs_and_is_that_of_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(ranking, "TERMS_SENT", sent)
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 83, " ".join(r.choices(words, weights=range(1, 31), k=r.randint(0, 20)))) for i in range(90)] + [(200, None)]
    rows = [(i, " ".join(t for d, t in rows if d == i and t).strip() if i != 200 else None) for i in sorted({d for d, _ in rows})]
    asked = [(q, " ".join(r.choices(words, k=6))) for q in range(20)] + [(50, "none"), (51, "")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(asked, "query_id long, q string")
    found = ranking.bm25(docs, queries, text.tokens(F.coalesce("text", F.lit(""))), text.tokens(F.col("q")), 7)
    tokens = {i: (t or "").split() for i, t in rows}
    df = {w: sum(w in t for t in tokens.values()) for w in words}
    df = {w: c for w, c in df.items() if c}
    idf = {w: np.log(len(tokens) - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    low, mean = 0.25 * np.mean(list(idf.values())), np.mean([len(t) for t in tokens.values()])
    want = {}
    for q, t in asked:
        all_ = []
        for i, d in tokens.items():
            if set(t.split()) & set(d):
                part = [(low if idf[w] < 0 else idf[w]) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in t.split() if w in d]
                all_.append((-round(sum(part), 6), i))
        want |= {(q, i): (n, -s) for n, (s, i) in enumerate(sorted(all_)[:7], 1)}
    got = {(x["query_id"], x["doc_id"]): (x["rank"], x["score"]) for x in found.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert "query_id" not in "".join(line for line in planned(found).splitlines() if "hashpartitioning" in line)


def test_bm25_takes_rows_of_one_id_as_one_document(spark):
    docs = spark.createDataFrame([(1, "red ring"), (1, "red rod"), (2, "blue rod"), (None, "red"), (3, "x")], "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([("a", "red rod")], "query_id string, q string")
    got = [x["doc_id"] for x in ranking.bm25(docs, queries, text.tokens(F.col("text")), text.tokens(F.col("q")), 5).collect()]
    assert sorted(got, key=str) == [1, 2, None]


def test_compact_names_meet_however_they_are_spaced(spark):
    catalogue = spark.createDataFrame([(1, "Tjoo Ortan"), (2, "Mo Oona"), (3, "Anna Lee")], "id long, name string")
    asked = spark.createDataFrame([(7, "TjooOrtan"), (8, "MoOona"), (9, "annalee"), (10, "TJOO  ORTAN .")], "query_id long, text string")
    assert sorted(tuple(x) for x in nlp.looked_up(asked, catalogue).collect()) == [(7, 1, "compact"), (8, 2, "compact"), (9, 3, "compact"), (10, 1, "name")]


def test_result_pairs_of_labels_are_not_shuffled(spark):
    asked = spark.createDataFrame([(1, "an"), (2, "an"), (3, "ring"), (4, "an"), (4, "ring"), (4, "ring")], "query_id long, text string")
    catalogue = spark.createDataFrame([(7, ["Anna", "an ring"]), (8, ["Ring", None]), (9, ["x"])], "id long, labels array<string>")
    found = nlp.label_matches(asked, catalogue)
    assert sorted(tuple(x) for x in found.collect()) == [(1, 7, "part"), (2, 7, "part"), (3, 7, "part"), (3, 8, "part"), (4, 7, "part"), (4, 8, "part")]
    plan = nlp.label_matches(asked.where("query_id < 4"), catalogue)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.splitlines()[1:3]  # of the union: result rows straight from a join
    assert "Project [query_id" in first[0] and "Join Inner, (_q" in first[1]


def test_equal_texts_are_judged_once(spark):
    rows = spark.createDataFrame([(i, ["ring", "rod", None][i % 3]) for i in range(30)], "id long, name string")
    seen = []
    got = shop.judged_once(rows, ["name"], lambda texts: (seen.append(texts.count()), texts.withColumn("long", F.length("name")))[1])
    assert seen == [3] and {x["id"]: x["long"] for x in got.collect()} == {i: [4, 3, None][i % 3] for i in range(30)}


def test_grams_of_rows_of_one_id_count_once(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (2, ["b"]), (3, None), (None, ["b"])], "id long, g array<string>")
    found = metrics.gram_counts(rows, "id", F.col("g"))
    assert sorted(tuple(x) for x in found.collect()) == [("a", 3, 1), ("b", 3, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(gram#\d+L?, id|id#\d+L?, gram)", plan)


def test_named_products_are_those_of_all_pairs_without_comparing_all(spark):
    r = random.Random(4)
    words = ["old", "new", "ring", "rod", "gear", "mark", "x1", "x2", "x3", "hot", "red", "tin"]
    names = [(i, " ".join(r.sample(words, r.choice([1, 2, 3, 4, 6, 10, 11])))) for i in range(120)] + [(200, ""), (201, None), (202, "..."), (203, "Old ring")]
    asked = [(q, " ".join(r.sample(words, r.choice([1, 3, 5, 10, 11])))) for q in range(80)] + [(90, ""), (91, None), (92, "any... thing"), (93, "oldring"), (94, "an OLD ring")]
    token = lambda s: set(re.findall("[a-z0-9]+", s.lower()))
    want = set()
    for q, text_ in asked:
        found = []
        for i, n in names:
            if n is None or not text_:
                continue
            share = len(token(n) & token(text_)) / max(1, len(token(n)))
            if n.lower() in text_.lower():
                found.append((round(2 + len(n) / len(text_), 6), n.lower(), i))
            elif share >= 0.75:
                found.append((round(share, 6), n.lower(), i))
        best = [x for x in found if x[0] == max(found)[0]]
        if best and len({x[1] for x in best}) == 1:
            want.add((q, min(x[2] for x in best), best[0][0]))
    products, queries = spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(asked, "query_id long, text string")
    found = nlp.named_product(products, queries)
    assert {tuple(x) for x in found.collect()} == want and len(want) > 40
    assert "NestedLoop" not in planned(found) and "Cartesian" not in planned(found)


def test_pairs_are_all_and_null_without_a_vector(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.5, 0.0]), (3, [1.0])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    got = vectorindex.pairs(items.withColumnRenamed("item_id", "query_id"), items, vectorindex.products).collect()
    ok = {0: [1.0, 2.0], 2: [0.5, 0.0]}
    assert {(x[0], x[1]): x[2] for x in got} == {(q, i): float(np.dot(ok[q], ok[i])) if q in ok and i in ok else None for q in range(4) for i in range(4)} and len(got) == 16
