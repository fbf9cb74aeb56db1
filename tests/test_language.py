"""Commands, facts, hierarchies and text models on small frames."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import facts, learning, nlp


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def one(spark, column, given=""):
    return spark.createDataFrame([(given,)], "t string").select(column.alias("x")).first()["x"]


def test_aliases_are_longest_first_exact_before_fuzzy(spark):
    aliases = spark.createDataFrame([("note", "phone"), ("galaxy note", "phone"), ("desk", "desk"), ("หูฟัง", "headset")], "alias string, canonical string")
    queries = spark.createDataFrame([(1, "a Galaxy Note please"), (2, "notebook"), (3, "ขอหูฟังดีๆ"), (4, "a dsek")], "query_id int, text string")
    assert sorted(values(nlp.alias_matches(queries, aliases), "query_id", "alias")) == [(1, "galaxy note"), (3, "หูฟัง")]
    fuzzy = dict(values(nlp.alias_matches(queries, aliases, fuzzy=0.7), "query_id", "canonical"))
    assert fuzzy[1] == "phone" and fuzzy[4] == "desk"


def test_command_columns(spark):
    c = F.col("t")
    rules = [("order", "order|buy"), ("search", "find|buy me")]
    assert one(spark, nlp.intent(c, rules), "Buy me a lamp") == "order" and one(spark, nlp.intent(c, rules), "hm") == "unknown"
    assert one(spark, nlp.expanded(c, {"refund": ["return", "money"], "late": ["delay"]}), "Refund?") == "Refund? return money" and one(spark, nlp.expanded(c, {"x": ["y"]}), "a") == "a"
    assert one(spark, nlp.guarded(F.lit("graph"), c, "plant|crop", "chat"), "my crop") == "graph" and one(spark, nlp.guarded(F.lit("graph"), c, "plant|crop", "chat"), "hi") == "chat"
    assert one(spark, nlp.confidence(F.lit(2), F.lit(1))) == pytest.approx(0.76) and one(spark, nlp.confidence(F.lit(20), F.lit(0))) == 0.99
    assert one(spark, nlp.reconciled_brand(F.lit("Other"), F.lit("Acme chair"), F.lit("https://x/acme-chair"), ["Acme", "Zed"])) == "Acme"
    assert one(spark, nlp.reconciled_brand(F.lit("Other"), F.lit("Acme chair"), F.lit("https://x/chair"), ["Acme"])) == "Other"
    assert one(spark, nlp.minor_price(F.array(F.lit(0), F.lit(1250)))) == 12.5
    told = F.array(F.struct(F.lit("en").alias("lang"), F.lit("lamp").alias("value")), F.struct(F.lit("th").alias("lang"), F.lit(" ").alias("value")))
    assert one(spark, nlp.localised(told, "th")) == "lamp" and one(spark, nlp.localised(told, "en")) == "lamp"


def test_sections_follow_their_order(spark):
    lines = ["1.1 First", "text", "1.3 Not next", "1.2 Second", "3.1 Not next", "2.1 Third", "more"]
    got = nlp.numbered_sections(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, o int, l string"), "d", "o", "l")
    assert [s for _, s in sorted(values(got, "o", "section"))] == ["1.1", "1.1", "1.1", "1.2", "1.2", "2.1", "2.1"]


def test_budget_is_shared_and_passed_on(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 1, 500), (1, 2, 500)], "q int, o int, n int")
    got = dict(values(nlp.shared_budget(rows, ["q"], "o", "n", 300, 10), "o", "allowed"))
    assert got == {0: 10, 1: 130, 2: 130}


def test_named_product_needs_one_name(spark):
    products = spark.createDataFrame([(1, "Desk Lamp"), (2, "Desk"), (3, "Chair One"), (4, "chair one"), (5, None)], "id int, name string")
    queries = spark.createDataFrame([(1, "price of desk lamp"), (2, "chair one"), (3, "nothing")], "query_id int, text string")
    assert sorted(values(nlp.named_product(products, queries), "query_id", "id")) == [(1, 1), (2, 3)]


def test_facts_are_accepted_or_refused_with_a_reason(spark):
    schema = "fact_id int, subject string, subject_type string, relation string, object string, object_type string, evidence string, page int"
    rows = [(1, "Rust", "disease", "HAS", "spots", "symptom", "Rust has spots", 1), (2, "rust", "disease", "HAS", "Spots", "symptom", "Rust  has\nspots", 1), (3, "Rust", "disease", "LIKES", "spots", "symptom", "Rust has spots", 1), (4, "Rust", "crop", "HAS", "spots", "symptom", "Rust has spots", 1), (5, "Rust", "disease", "HAS", "holes", "symptom", "Rust has holes", 1), (6, "Rust", "disease", "HAS", "spots", "symptom", "Rust has spots", 9)]
    pages = spark.createDataFrame([(1, "Here Rust has spots on leaves.")], "page int, text string")
    allowed = spark.createDataFrame([("disease", "HAS", "symptom")], "subject_type string, relation string, object_type string")
    got = dict(values(facts.accepted(spark.createDataFrame(rows, schema), pages, allowed, ["HAS"]), "fact_id", "reason"))
    assert got == {1: "accepted", 2: "duplicate", 3: "unknown relation", 4: "wrong types", 5: "ungrounded", 6: "ungrounded"}


def test_review_replace_and_pending(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    assert sorted(values(facts.reviewed(a, a.where("k = 1"), spark.createDataFrame([(3, "z")], "k int, s string"), "k"), "k", "origin")) == [(2, "extracted"), (3, "review")]
    assert sorted(values(facts.replaced_source(a, spark.createDataFrame([(9, "x")], "k int, s string"), "s"), "k")) == [2, 9]
    done = a.select("k", F.sha2("s", 256).alias("sha"), F.lit("v1").alias("version"))
    assert values(facts.pending(a, done, "k", F.col("s"), "v1"), "k") == [] and len(values(facts.pending(a, done, "k", F.col("s"), "v2"), "k")) == 2


def test_evidence_is_repaired_from_one_neighbour_only(spark):
    lines = spark.createDataFrame([(1, 1, "abc"), (1, 2, "x"), (1, 3, "abc"), (1, 7, "def")], "page int, line_no int, line string")
    rows = spark.createDataFrame([(1, 1, 1, "abc"), (2, 1, 2, "abc"), (3, 1, 6, "d e f"), (4, 1, 20, "abc")], "k int, page int, at int, evidence string")
    assert dict(values(facts.neighbour_repair(rows, lines, "k", "page", "at", "evidence"), "k", "found_at")) == {1: 1, 2: None, 3: 7, 4: None}


def test_hierarchy_similarity(spark):
    tree = spark.createDataFrame([("cat", "animal"), ("dog", "animal"), ("animal", "thing"), ("rock", "thing")], "node string, parent string")
    pairs = spark.createDataFrame([("cat", "dog"), ("cat", "rock"), ("cat", "cat"), ("cat", "none")], "a string, b string")
    got = {(r["a"], r["b"]): (r["similarity"], r["meets"]) for r in facts.path_similarity(tree, pairs, 4).collect()}
    assert got == {("cat", "dog"): (0.333333, "animal"), ("cat", "rock"): (0.25, "thing"), ("cat", "cat"): (1.0, "cat"), ("cat", "none"): (0.0, None)}


def test_rerank_keeps_fused_order_without_a_finite_score(spark):
    ranked = spark.createDataFrame([(1, "red lamp", "a desk", 1), (1, "red lamp", "a red lamp", 2), (1, "red lamp", None, 3), (1, "red lamp", "red lamp", 4)], "q int, query string, text string, rank int")
    assert [r for _, r in sorted(values(facts.reranked(ranked, learning.overlap_scorer, ["q"], "query", "text", "rank", 3, 3), "position", "rank"))] == [2, 1, 3]
    broken = lambda q, t: F.lit(float("nan"))
    assert [r for _, r in sorted(values(facts.reranked(ranked, broken, ["q"], "query", "text", "rank", 3, 2), "position", "rank"))] == [1, 2]


def test_reviewed_rows_find_their_candidates(spark):
    have = spark.createDataFrame([("s1", "Owner A"), ("s1", "a"), ("s2", "b")], "section string, name string")
    want = spark.createDataFrame([("s1", "A"), ("s2", "c")], "section string, name string")
    assert sorted(values(facts.bipartite_matches(have, want, ["section"], {"owner a": "a"}, "name"), "name", "found", "candidates")) == [("A", True, 2), ("c", False, 0)]


def test_text_models(spark):
    rows = [(f"good fine nice {i % 3}", 1.0) for i in range(12)] + [(f"bad poor awful {i % 3}", 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "text string, label double")
    for kind in ("logistic", "bayes"):
        assert learning.area_under_curve(learning.classifier(df, "text", "label", kind, ngrams=1).transform(df), "label") > 0.99
    encode = learning.encoder(learning.hashing_encoder(16))
    got = values(df.limit(2).select(encode("text").alias("v")), "v")
    assert len(got[0]) == 16 and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    assert learning.topics(df, "text", 2, iterations=2).transform(df).select("topicDistribution").count() == 24
