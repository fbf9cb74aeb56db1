"""Seeds of questions, matches of labels, edges across groups and kept word breaks: small cases with what they must give."""

import difflib

from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import graph, nlp


def seeds(spark, rows, explicit=None):
    catalogue = spark.createDataFrame([(1, ["APT29", "Cozy Bear"]), (2, ["PowerShell", "T1059.001"]), (3, ["Command", "T1059"]), (4, ["tool"]), (5, ["ab", None]), (6, None)], "id long, terms array<string>")
    hits = spark.createDataFrame([(q, i) for q in range(1, 12) for i in (4, 5, 5)], "query_id long, id long")
    asked = spark.createDataFrame([(i, x, explicit) for i, x in enumerate(rows, 1)], "query_id long, text string, wanted string")
    got = nlp.seeds(asked, catalogue, hits, explicit="wanted" if explicit else None).collect()
    return sorted((r["query_id"], r["id"], r["source"]) for r in got if r["query_id"] <= len(rows))


def test_mentions_go_before_vector_hits(spark):
    rows = ["What does apt29. do?", "uses T1059.001", "uses T1059, then", "a tool ab", "xAPT29 apt29_", None, "cozy bear and COMMAND"]
    assert seeds(spark, rows) == [(1, 1, "mention"), (2, 2, "mention"), (3, 3, "mention"), (4, 4, "vector"), (4, 5, "vector"), (5, 4, "vector"), (5, 5, "vector"), (6, 4, "vector"), (6, 5, "vector"), (7, 1, "mention"), (7, 3, "mention")]


def test_an_explicit_entity_is_taken_alone(spark):
    assert seeds(spark, ["apt29", "none"], "COMMAND") == [(1, 3, "mention"), (2, 3, "mention")]
    assert seeds(spark, ["apt29"], "unheard of") == []


def test_labels_that_contain_a_text_or_are_near_it(spark):
    labels = {1: ["Big Bucket", "bucket-xl"], 2: ["Zinger Burger"], 3: [], 4: ["ไก่ทอด"], 5: [None, "Big bucket"]}
    asked = [(1, "BIG b"), (2, "zinger burgr"), (3, "x"), (4, None), (5, "ไก่"), (6, "bucket xl"), (7, "..")]
    catalogue = spark.createDataFrame(list(labels.items()), "id long, labels array<string>")
    got = nlp.label_matches(spark.createDataFrame(asked, "query_id long, text string"), catalogue, near=0.7).collect()
    assert sorted((r["query_id"], r["id"], r["by"]) for r in got) == [(1, 1, "part"), (1, 5, "part"), (2, 2, "near"), (5, 4, "part"), (6, 1, "part")]
    assert difflib.SequenceMatcher(None, "zingerburgr", "zingerburger").ratio() >= 0.7


def test_edges_between_groups(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "n long, g string")
    edges = spark.createDataFrame([(1, 2, "x"), (1, 4, "y"), (2, 3, "z"), (4, 2, None), (2, 9, "w"), (None, 2, "v")], "s long, t long, _g string")
    got = graph.crossing(edges, nodes, "n", "g", "s", "t").collect()
    assert sorted((r["s"], r["t"], r["from_group"], r["to_group"]) for r in got) == [(1, 2, "a", "b"), (4, 2, "a", "b")]


def test_word_breaks_are_kept(spark):
    cases = {"a‌b‍c​d﻿": "a​b​c​d", " x \t y \n \n\n\n z ": "x y\n\nz", "é": "é", "": "", None: None}
    got = spark.createDataFrame([(x,) for x in cases], "text string").select("text", t.broken(F.col("text")).alias("made")).collect()
    assert {r["text"]: r["made"] for r in got} == cases
