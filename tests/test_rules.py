"""Rules that SQL can't state, against plain versions, and edges of the others."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import udfs
from corvane.operators import folds, metrics, ranking, shop


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def ratio(a: str, b: str) -> float:
    """Matching characters by the longest common block, leftmost in both, and the same on either side."""

    def matches(a: str, b: str) -> int:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        return n + matches(a[:i], b[:j]) + matches(a[i + n :], b[j + n :]) if n else 0

    return 2 * matches(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_ratios_are_those_of_matching_blocks(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abc ", k=rng.randint(0, 9))), "".join(rng.choices("abc ", k=rng.randint(0, 9)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", udfs.sequence_ratio("a", "b").alias("r"), udfs.fragment_ratio("a", "b").alias("f")).collect()
    for r in got:
        assert abs(r["r"] - ratio(r["a"], r["b"])) < 1e-9
        a, b = r["a"], r["b"]
        parts = [b[i : i + w] for w in range(len(a), len(a) + 3) for i in range(max(1, len(b) - w + 1))]
        want = 0.0 if not a or not b else 1.0 if a in b else max(ratio(a, p) for p in parts)
        assert abs(r["f"] - want) < 1e-9


@pytest.mark.parametrize("size", [5, 12, 40])
def test_recursive_parts_join_to_the_text_and_cut_coarsely(size):
    rng = random.Random(size)
    for _ in range(300):
        text = "".join(rng.choices(["ab", "cde", " ", ". ", "\n", "\n\n"], k=rng.randint(0, 30)))
        parts = udfs.recursive_parts(text, size)
        assert "".join(parts) == text and all(0 < len(p) <= size for p in parts)
        # two neighbours of one text without a coarser cut never fit one part
        plain = text.replace("\n", "").replace(". ", "").replace(" ", "")
        assert not (plain and len(text) <= size) or parts == [text]


def test_prices_of_texts():
    cases = {"between 1k and 2,500": (1000, 2500, True, True), "1-2k": (1000, 2000, True, True), "1,000-2k": (1000, 2000, True, True), "under 300": (None, 300, None, False), "at least 5 up to 9": (5, 9, True, True), "over 7.5k": (7500, None, False, None), "no price": (None,) * 4, "": (None,) * 4}
    cases |= {"iphone 15 and 16 under 20k": (None, 20000, None, False), "iphone 15": (None,) * 4, "inch 24-27": (None,) * 4, "24-27 inch": (None,) * 4, "mouse 500-1500": (500, 1500, True, True), "ตั้งแต่ 2พัน ถึง 3หมื่น": (2000, 30000, True, True), "900 บาท": (None, 900, None, True), "5000 บาทขึ้นไป": (5000, None, True, None), "budget 3,000 over 1k": (1000, 3000, False, True)}
    assert {k: udfs.price_bounds(k) for k in cases} == cases


def test_lexical_score_takes_the_best_rule(spark):
    def score(q, n, d):
        return round(one(spark, shop.lexical_score(F.col("q"), F.col("n"), F.col("d"), lambda c: F.replace(c, F.lit("ph"), F.lit("f"))), q=q, n=n, d=d), 6)

    assert score("zinger", "Zinger Box", "a meal") == 0.98 and score("meal", "Zinger", "a meal") == 0.76
    assert score("phone", "my fone x", "y") == 0.94 and score("phone", "y", "my fone x") == 0.74
    assert score("zinget", "zinger", "zz") == round(max(0.72 + 0.24 * 0, ratio("zinget", "zinger")), 6)
    assert score("zingerbux", "zingerbox deluxe meal", "q") == round(0.72 + 0.24 * ratio("zingerbux", "zingerbox"), 6)
    assert score("", "a", "b") == 0.0


def test_brands_are_alike(spark):
    same = lambda brand, wanted: one(spark, shop.brand_matches(F.col("b"), F.col("w"), {"Logitech": ["logi", "โลจิเทค"]}), b=brand, w=wanted)
    assert same("Logitech G", "logi") and same("Logitec", "Logitech") and same("Logotech", "Logitech") and same("โลจิเทค", "logitech")
    assert not same("", "logi") and not same("Razer", "Logitech") and not same("Sonu", "Sony") and not one(spark, shop.brand_matches(F.lit(None).cast("string"), F.col("w"), {}), w="a")


def test_categories_veto_and_fall_back(spark):
    table = {"mouse": ["mice"], "speaker": ["soundbar"], "หูฟัง": ["headset"]}
    match = lambda leaf, name, request: one(spark, shop.category_matches(F.col("l"), F.col("n"), F.col("r"), table), l=leaf, n=name, r=request)
    assert match("Mice", "x", "gaming mouse") and not match("soundbar", "with mouse", "mouse") and match("other", "a mouse", "mouse")
    assert match("other", "x", "anything") and match("ชุดหูฟังดี", "x", "headset") and not match("mousepad", "x", "mouse")


def test_a_fair_draw_swaps_a_set_that_was_shown(spark):
    pool = spark.createDataFrame([("g", i, i) for i in range(1, 5)], "g string, id int, rank int")
    history = spark.createDataFrame([("g", 1, [1, 2]), ("g", 2, [3, 4])], "g string, at int, ids array<int>")
    got = sorted(r["id"] for r in shop.fair_draw(pool, history, ["g"], "rank", "id", 2, 1).collect())
    assert len(got) == 2 and got not in ([1, 2], [3, 4])
    assert sorted(r["id"] for r in shop.fair_draw(pool, history.limit(0), ["g"], "rank", "id", 9, 1).collect()) == [1, 2, 3, 4]


def test_folds_stream_through_keys_in_order(spark):
    rows = spark.createDataFrame([(None if i % 5 == 0 else i % 3, i, i) for i in range(200)], "k int, o int, v int").repartition(7)
    got = folds.folded(rows, ["k"], ["o"], ["v"], lambda s, v: (s + v, s + v), 0, "run", rows.schema["v"].dataType).collect()
    total: dict = {}
    for r in sorted(got, key=lambda r: r["o"]):
        total[r["k"]] = total.get(r["k"], 0) + r["v"]
        assert r["run"] == total[r["k"]]
    assert len(got) == 200


def test_searches_in_blocks_are_those_of_one(spark, monkeypatch):
    rng = random.Random(1)
    items = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "item_id long, embedding array<double>")
    asked = items.where("item_id < 20").withColumnRenamed("item_id", "query_id")
    whole = sorted(map(tuple, ranking.nearest(asked, items, 5).collect()))
    monkeypatch.setattr(ranking, "QUERIES_SENT", 6)
    assert sorted(map(tuple, ranking.nearest(asked, items, 5).collect())) == whole


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_splits_take_the_first_draws(spark, share):
    import hashlib

    df = spark.range(501).withColumnRenamed("id", "k")
    order = sorted(range(501), key=lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k))
    want = max(1, int(501 * share + 0.5))
    assert {r["k"] for r in metrics.hash_split(df, "k", share, 3).where("valid").collect()} == set(order[:want])
