"""Similarity join, dictionary matching and vector search against all pairs."""

import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dictionary, folds, nlp, similar, vectorindex
from corvane.plans import shop


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def edited(r, text):
    w = list(text)
    for _ in range(r.randint(0, 3)):
        i = r.randrange(len(w) + 1)
        w[i : i + r.choice([0, 1])] = [r.choice("abcé1 ")] * r.choice([0, 1])
    return "".join(w)


@pytest.mark.parametrize("least", [0.68, 0.75, 0.84, 0.95, 1.0])
def test_similar_texts_are_those_of_all_pairs(spark, least):
    r = random.Random(11)
    base = ["".join(r.choices("abcdefé1 ", k=r.choice([1, 2, 3, 4, 6, 9, 14, 30]))) for _ in range(70)]
    texts = sorted({*base, *(edited(r, t) for t in base for _ in range(2)), "a", "aa", "aaa", "aaaaaaaa", "abab", "baba"} - {""})
    left = spark.createDataFrame([(t,) for t in [*texts, *texts[:20], None, ""]], "text string")
    got = {(x["a"], x["b"]): x["ratio"] for x in similar.similar(left, None, least).collect()}
    assert got == {(a, b): v for a in texts for b in texts if a < b and (v := ratio(a, b)) >= least}
    some, rest = texts[::2], texts[::3]
    both = similar.similar(spark.createDataFrame([(t,) for t in some], "text string"), spark.createDataFrame([(t,) for t in rest], "text string"), least)
    assert {(x["a"], x["b"]) for x in both.collect()} == {(a, b) for a in some for b in rest if ratio(a, b) >= least}


def test_shared_pairs_is_a_lower_bound():
    r = random.Random(2)
    for _ in range(4000):
        a = "".join(r.choices("ab", k=r.randint(1, 9)))
        b = edited(r, a)
        if not b:
            continue
        least = r.choice([0.7, 0.8, 0.9])
        if ratio(a, b) >= least:
            pairs = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
            shared = sum(min(pairs(a).count(g), pairs(b).count(g)) for g in set(pairs(a)))
            assert shared >= max(similar.shared_pairs(len(a), least), similar.shared_pairs(len(b), least))


@pytest.mark.parametrize("dearer", [0, 10**9])
def test_texts_that_meet_by_tokens_and_in_blocks_are_the_same(spark, monkeypatch, dearer):
    monkeypatch.setattr(similar, "DEARER", dearer)
    monkeypatch.setattr(similar, "SIDE", 40)
    r = random.Random(7)
    base = ["".join(r.choices("abcdefé1 😀", k=r.choice([1, 2, 5, 9, 14, 30, 70, 130]))) for _ in range(60)]
    texts = sorted({*base, *(edited(r, t) for t in base for _ in range(2)), "aaa", "aaaaaaaa"} - {""})
    some, rest = texts[::2], texts[::3]
    for least in (0.7, 0.84):
        left = spark.createDataFrame([(t,) for t in [*texts, *texts[:9], None, ""]], "text string")
        got = [tuple(x) for x in similar.similar(left, None, least).collect()]
        assert sorted(got) == [(a, b, v) for a in texts for b in texts if a < b and (v := ratio(a, b)) >= least]
        both = similar.similar(spark.createDataFrame([(t,) for t in some], "text string"), spark.createDataFrame([(t,) for t in rest], "text string"), least, apart=2, initial=True)
        assert sorted(tuple(x) for x in both.collect()) == [(a, b, v) for a in some for b in rest if a[0] == b[0] and abs(len(a) - len(b)) <= 2 and (v := ratio(a, b)) >= least]


def test_names_of_common_syllables_are_not_joined_by_tokens(spark):
    r = random.Random(3)
    syllables = ["ber", "dal", "ez", "gu", "ham", "ko", "ley", "lo", "ma", "ni", "or", "ren", "son", "tan", "vic"]
    names = sorted({"".join(r.choices(syllables, k=6)) for _ in range(400)})
    found = similar.similar(spark.createDataFrame([(t,) for t in names], "text string"), None, 0.84)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(x) for x in found.collect()) == [(a, b, v) for a in names for b in names if a < b and (v := ratio(a, b)) >= 0.84]


def common_names(r, n):
    syllables = ["ber", "dal", "ez", "gu", "ham", "ko", "ley", "lo", "ma", "ni", "or", "ren", "son", "tan", "vic", "ström"]
    return sorted({"".join(r.choices(["an", "el", "jo", "lu", "mé", "ri", "vi"], k=r.choice([2, 3]))) + " " + "".join(r.choices(syllables, k=4)) for _ in range(n)})


def test_few_pairs_of_common_names_are_aligned(monkeypatch):
    names = common_names(random.Random(4), 3000)
    aligned = []
    common = similar.common
    monkeypatch.setattr(similar, "common", lambda *args: aligned.append(len(found := common(*args))) or found)
    found = list(similar.compared(names, None, True, 0.84, None, False))
    assert found and 0 < sum(aligned) < len(names) ** 2 / 2 / 100


@pytest.mark.parametrize("run, least", [(0, 0.7), (0, 0.84), (10**9, 0.84)])
def test_blocks_of_near_letter_counts_hold_all_similar_texts(spark, monkeypatch, run, least):
    for name, value in {"DEARER": 10**9, "RUN": run, "SIDE": 60, "CELLS": 8, "ASKED": 100, "DEALT": 7}.items():
        monkeypatch.setattr(similar, name, value)
    r = random.Random(9)
    base = [*common_names(r, 70), *("".join(r.choices("abcdefé1 😀", k=r.choice([1, 2, 5, 30, 70, 130]))) for _ in range(20)), "ab" * 1200, "ab" * 1190]
    texts = sorted({*base, *(edited(r, t) for t in base for _ in range(2))} - {""})
    want = [(a, b, v) for a in texts for b in texts if a < b and (v := ratio(a, b)) >= least]
    assert sorted(tuple(x) for x in similar.similar(spark.createDataFrame([(t,) for t in texts], "text string"), None, least).collect()) == want
    texts = ["".join(t) for t in itertools.permutations("abcde")]  # of equal counts, more than a block holds
    want = [(a, b, v) for a in texts for b in texts if a < b and (v := ratio(a, b)) >= least]
    assert sorted(tuple(x) for x in similar.similar(spark.createDataFrame([(t,) for t in texts], "text string"), None, least).collect()) == sorted(want)


def test_matched_letters_are_those_of_sequence_matcher():
    r = random.Random(8)
    pairs = [("".join(r.choices("abc", k=r.randint(1, 64))), "".join(r.choices("abcd", k=r.randint(1, 20)))) for _ in range(3000)]
    code = lambda texts: np.array([[ord(c) for c in t] + [-1] * (max(map(len, texts)) - len(t)) for t in texts], np.int32)
    a, b = zip(*pairs)
    got = similar.gestalt(code(a), code(b), np.array([len(t) for t in a]), np.array([len(t) for t in b]))
    assert got.tolist() == [sum(x.size for x in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks()) for p, q in pairs]


def test_joins_of_names_are_those_of_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    clients = spark.read.parquet(f"{d}/clients.parquet").collect()
    names = sorted({c["name"].lower() for c in clients if c["name"]})
    want = sorted((a, b, round(v, 6)) for a in names for b in names if a < b and (v := ratio(a, b)) >= 0.84)
    assert want and sorted(tuple(x) for x in shop.similar_names(spark, d).collect()) == want
    place: dict = {}
    for v in spark.read.parquet(f"{d}/vendors.parquet").collect():
        alias = v["name"].lower().split(" ")[-1]
        place[alias] = min(v["vendor_id"], place.get(alias, v["vendor_id"]))
    assert sorted(tuple(x) for x in shop.typo_names(spark, d).collect()) == sorted(plain_typos([(c["client_id"], c["name"]) for c in clients], [(p, a, a.capitalize()) for a, p in place.items()], 0.7))


@pytest.mark.parametrize("dearer", [0, 10**9])
def test_a_word_is_offered_no_more_names_than_its_text_can_take(spark, monkeypatch, dearer):
    monkeypatch.setattr(similar, "DEARER", dearer)
    r = random.Random(5)
    aliases = [(i, a, a[:5].capitalize()) for i, a in enumerate(sorted({"".join(r.choices(["ber", "dal", "gu", "ham"], k=3)) for _ in range(60)}))]
    texts = [" ".join(edited(r, r.choice(aliases)[1]) if r.random() < 0.8 else r.choice(aliases)[1] for _ in range(r.randint(1, 5))) for _ in range(60)]
    given = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), spark.createDataFrame(aliases, "place int, alias string, canonical string")
    seen = []
    monkeypatch.setattr(nlp, "folded", lambda rows, *rest: seen.append(rows) or folds.folded(rows, *rest))
    got = [(x["query_id"], x["canonical"], x["word"], x["start"], round(x["score"], 6)) for x in nlp.typo_matches(*given, 0.7).collect()]
    assert got and sorted(got) == sorted(plain_typos(list(enumerate(texts)), aliases, 0.7))
    mentioned = lambda text: len({c for _, a, c in aliases if re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", text)})
    assert all(len(x["offers"]) <= len(texts[x["query_id"]].split()) + len(re.findall("[^a-z0-9 ]", texts[x["query_id"]])) + mentioned(texts[x["query_id"]]) for x in seen[0].collect())


def plain_typos(queries, aliases, least):
    """aliases: (place, alias, canonical)."""
    out = []
    for key, text in queries:
        text = (text or "").lower()
        seen = {c for _, a, c in aliases if re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", text)} if all(re.fullmatch("[a-z0-9 .&-]+", a) for _, a, _ in aliases) else {c for _, a, c in aliases if (re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", text) if re.fullmatch("[a-z0-9 .&-]+", a) else a in text)}
        for at, word in enumerate(re.findall("[a-z0-9ก-๙]+", text)):
            if len(word) < 4 or word.isdigit():
                continue
            best = None
            for _, alias, canonical in sorted(aliases):
                if canonical in seen or len(alias) < 4 or " " in alias or abs(len(word) - len(alias)) > 2 or word[0] != alias[0]:
                    continue
                if (v := ratio(word, alias)) >= least and (best is None or v > best[0]):
                    best = (v, canonical)
            if best:
                seen.add(best[1])
                out.append((key, best[1], word, at, round(best[0], 6)))
    return out


def test_a_name_is_taken_once_and_exact_mentions_go_first(spark):
    aliases = [(0, "samsung", "Samsung"), (1, "samson", "Samson"), (2, "sony", "Sony"), (3, "soundbar", "Soundbar"), (4, "หูฟัง", "Headphones"), (5, "air pods", "AirPods")]
    queries = [(1, "samsvng samsumg tv"), (2, "samsung samsumg"), (3, "sonny 1234 soundbr"), (4, "อยากได้หูฟัง sonyy"), (5, None), (6, ""), (7, "airpods")]
    found = nlp.typo_matches(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(aliases, "place int, alias string, canonical string"), 0.7)
    got = sorted((x["query_id"], x["canonical"], x["word"], x["start"], round(x["score"], 6)) for x in found.collect())
    assert got == sorted(plain_typos(queries, aliases, 0.7)) and (2, "Samson") in {x[:2] for x in got}


def test_terms_are_those_of_plain_search(spark, monkeypatch):
    r = random.Random(6)
    terms = ["ab", "abc", "b", "c.1", "é", "a b", "ring", "หู", *("".join(r.choices("abc1", k=3)) for _ in range(60))]
    texts = [(i, "".join(r.choices("abc1 .é-", k=r.choice([0, 5, 80])))) for i in range(200)] + [(900, None), (901, "ring.5"), (902, "ring."), (903, "a ring, rings"), (904, "หูฟัง")]
    plain = lambda t, term: next((m.start() for m in re.finditer(f"(?={re.escape(term)})", t) if dictionary.bounded(t, m.start(), m.start() + len(term))), None)
    want = {(i, term, at) for i, t in texts for term in set(terms) if (at := plain(t or "", term)) is not None}
    table, words = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in [*terms, None, "", "ab"]], "w string")
    whole = dictionary.found(table, words, "id", "text", "w")
    assert {tuple(x) for x in whole.collect()} == want
    assert not [x for x in want if x[0] == 901] and "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dictionary, "PART", 9)  # several automata
    assert {tuple(x) for x in dictionary.found(table, words, "id", "text", "w").collect()} == want
    assert dictionary.found(table, words.where("false"), "id", "text", "w").count() == 0


def vectors(spark, seed, n, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 3
    rows = [(int(i), [float(x) for x in centres[rng.integers(12)] + rng.normal(size=width) * 0.3]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)]  # ties
    odd = [(5000, None), (5001, []), (5002, [1.0] * (width - 1)), (5003, [float("nan")] * width), (5004, [0.0] * width)]
    return rows, spark.createDataFrame([*rows, *odd], "item_id long, embedding array<double>")


def plain_nearest(rows, queries, k, metric):
    out = set()
    x = np.array([v for _, v in rows])
    for q, v in queries:
        v = np.array(v)
        with np.errstate(invalid="ignore", divide="ignore"):
            s = {"ip": lambda: -(x @ v), "cosine": lambda: -np.nan_to_num((x @ v) / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))), "l2": lambda: np.sqrt(((x - v) ** 2).sum(1))}[metric]()
        for rank, (score, i) in enumerate(sorted((round(float(a), 6), i) for a, (i, _) in zip(s, rows))[:k], 1):
            out.add((q, i, abs(score) if score == 0 else score if metric == "l2" else -score, rank))
    return out


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_blocks_and_index_find_what_all_pairs_do(spark, monkeypatch, metric):
    rows, items = vectors(spark, 3, 900)
    rows = [*rows, (5004, [0.0] * 8)]
    queries = [(i, v) for i, v in rows if i % 90 == 0]
    asked = spark.createDataFrame([*queries, (7777, None)], "query_id long, embedding array<double>")
    want = plain_nearest(rows, queries, 7, metric)
    as_set = lambda df: {(x["query_id"], x["item_id"], x["score"], x["rank"]) for x in df.collect()}
    counter = spark.sparkContext.accumulator(0)
    assert as_set(vectorindex.nearest(asked, items, 7, metric, counter=counter)) == want
    assert counter.value == len(rows) * len(queries)
    if metric != "ip":
        counter = spark.sparkContext.accumulator(0)
        index = vectorindex.Index(items, 24, metric, sample=300)
        assert as_set(index.search(asked, 7, probing=2, counter=counter)) == want
        assert 0 < counter.value < len(rows) * len(queries) / 2  # most pairs are never scored
        assert as_set(index.search(asked.where("false"), 7)) == set()
        monkeypatch.setattr(vectorindex, "BLOCK", 4)
        assert as_set(index.search(asked, 7, probing=1)) == want
        assert as_set(vectorindex.Index(items.where("false"), 4, metric).search(asked, 3)) == set()
    monkeypatch.setattr(vectorindex, "BLOCK", 3)
    monkeypatch.setattr(vectorindex, "CELLS", 500)
    assert as_set(vectorindex.nearest(asked, items, 7, metric)) == want
    assert vectorindex.nearest(asked.where("false"), items, 7, metric).count() == 0
    assert vectorindex.nearest(asked, items.where("false"), 7, metric).count() == 0


def test_a_limit_beyond_the_items_gives_all(spark):
    rows, items = vectors(spark, 5, 30)
    asked = spark.createDataFrame([(1, rows[0][1])], "query_id long, embedding array<double>")
    assert vectorindex.nearest(asked, items, 1000, "l2").count() == vectorindex.Index(items, 5).search(asked, 1000).count() == 51


def test_the_index_finds_what_all_pairs_of_the_table_do(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    asked = items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    counter = spark.sparkContext.accumulator(0)
    index = vectorindex.Index(items, 32)
    exact = {tuple(x) for x in vectorindex.nearest(asked, items, 10, "l2").collect()}
    assert {tuple(x) for x in index.search(asked, 10, counter=counter).collect()} == exact
    assert counter.value <= items.count() * asked.count()  # these vectors lie so evenly that bounds leave out little
