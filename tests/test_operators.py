"""Operators of the library proper on small frames: rules, nulls, ties, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import text, udfs, vectors
from corvane.operators import catalog, chunking, graph, metrics, ranking, state
from corvane.sources import files, html
from corvane.streaming import live


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def one(spark, column, schema="t string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("length, want", [(951, [500, 500, 51]), (500, [500]), (501, [500, 51]), (1, [1]), (0, [])])
def test_windows_reconstruct_the_text(spark, length, want):
    whole = "".join(chr(97 + i % 26) for i in range(length))
    got = chunking.windows(spark.createDataFrame([(1, whole), (2, None)], "d long, t string"), "t", 500, 50).where("d = 1").orderBy("start").collect()
    assert [len(r["chunk"]) for r in got] == want and (got[0]["chunk"] if got else "") + "".join(r["chunk"][50:] for r in got[1:]) == whole
    with pytest.raises(ValueError):
        chunking.windows(spark.range(1), "id", 50, 50)


def test_parent_blocks_break_at_sections_and_size(spark):
    units = spark.createDataFrame([(1, 0, "a", 40), (1, 1, "a", 40), (1, 2, "a", 40), (1, 3, "b", 10), (1, 4, None, 5), (1, 5, None, 500)], "d int, o int, s string, n int")
    assert sorted(values(chunking.parent_blocks(units, "d", "o", "s", "n", 100), "o", "parent")) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_text_functions(spark):
    c = F.col("t")
    for column, given, want in [
        (text.clean(c), "  a  b\n\tc ", "a b c"),
        (text.clean(c, 3), "abcdef", "abc"),
        (text.scrub(c), "a​b https://x.y/z  c", "ab c"),
        (text.tokens(c), "Abc ไทย-12", ["abc", "ไทย", "12"]),
        (text.compact(c), "A b-ก1", "abก1"),
        (text.normalised(c), "ราคา ๑,๐๐๐ sooooo – x", "ราคา 1000 so - x"),
        (text.character_ngrams(c), "abab", ["ab", "ba"]),
        (text.character_ngrams(c), "a", ["a"]),
        (text.sentences(c), "First one here. No. Second one!\nThird one now", ["First one here.", "Second one!", "Third one now"]),
        (text.first_phrase(c, ["red", "redder", "blue"]), "a redder blue", "redder"),
        (text.comparison(c), "phone A vs phone B", ["phone A", "phone B"]),
        (text.comparison(c), "phone A", None),
        (text.citations(c), "x [S2] y [S1] [S2]", ["S2", "S1"]),
        (text.https_url(c), "http://Ex.COM/a/?q=1#f", "https://ex.com/a"),
        (text.https_url(c), "ftp://x", None),
        (text.tag_list(c), "['a', 'b']", ["a", "b"]),
        (text.tag_list(c), "a | b||", ["a", "b"]),
        (text.fenced_json(c), '```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'),
        (text.key_text(c), "2106.0", "2106"),
        (text.key_text(c), " x1 ", "x1"),
        (text.number(c), "THB 1,250.50", 1250.5),
        (text.number(c), "none", None),
        (text.amount(c), "2k", 2000.0),
        (text.amount(c), "3 หมื่น", 30000.0),
        (text.boolean(c), "InStock", True),
        (text.boolean(c), "maybe", None),
        (text.path_parts(c, 2), "a > b > c", ["a", "b"]),
        (text.distinct_ignoring_case(F.split(c, ",")), "A,b,a,B", ["A", "b"]),
        (text.mentions(c, F.lit("T1059")), "uses T1059.001 now", False),
        (text.mentions(c, F.lit("APT29")), "by APT290", False),
        (text.mentions(c, F.lit("APT29")), "by APT29.", True),
        (text.without(c, ["please", "the"]), "please show the menu", "show menu"),
        (F.date_format(text.dirty_date(c), "yyyy-MM-dd"), "Jan 5, 2024", "2024-01-05"),
        (F.date_format(text.dirty_date(c), "yyyy-MM-dd"), "31/12/2023", "2023-12-31"),
        (text.dirty_date(c), "soon", None),
        (F.date_format(text.iso_date(c), "yyyy-MM-dd"), "until 2024-02-29T00", "2024-02-29"),
    ]:
        assert one(spark, column, row=(given,)) == want, (given, want)
    assert one(spark, text.jaccard(F.split(F.lit("a b c"), " "), F.split(F.lit("b c d"), " "))) == 0.5
    assert one(spark, text.stable_id(F.lit("a"), F.lit(None), length=8)) == one(spark, F.substring(F.sha2(F.lit("a|"), 256), 1, 8))


def test_udfs(spark):
    df = spark.createDataFrame([("abcd", "bcde", "a  b\nc", "abc"), (None, "x", None, None)], "a string, b string, t string, q string")
    assert values(df.select(udfs.sequence_ratio("a", "b").alias("r")), "r") == [0.75, None]
    assert values(df.select(udfs.fragment_ratio("q", "t").alias("r")), "r")[1] == 0.0
    assert values(df.select(udfs.source_quote("q", "t").alias("r")), "r") == ["a  b\nc", None]
    assert one(spark, udfs.nfc(F.lit("é"))) == "é"
    assert one(spark, udfs.rich_text(F.lit(json.dumps({"content": [{"value": "a"}, {"content": [{"value": "b"}]}]})))) == ["a", "b"]
    for given, want in [("between 1,000 and 2k", (1000.0, 2000.0, True, True)), ("under 500", (None, 500.0, None, False)), ("at least 3k but below 5000", (3000.0, 5000.0, True, False)), (None, (None,) * 4)]:
        assert udfs.price_bounds(given) == want
    whole = "First part. " * 30 + "\n\n" + "x" * 300
    parts = udfs.recursive_parts(whole, 100)
    assert "".join(parts) == whole and max(map(len, parts)) <= 100
    assert udfs.soft_parts("a" * 70 + "\n" + "b" * 50, 100) == ["a" * 70, "b" * 50] and udfs.soft_parts(None, 5) == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0])], "a array<float>, z array<float>, n array<float>")
    r = df.select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.unit(F.col("z")).alias("u"), vectors.valid(F.col("n"), 2).alias("v"), vectors.squared_distance(F.col("a"), F.col("z")).alias("d")).first()
    assert (r["n"], r["c"], r["u"], r["v"], r["d"]) == (5.0, 0.0, [0.0, 0.0], False, 25.0)


def test_fusion_and_budgets(spark):
    schema = "query_id int, item_id string, rank int"
    dense, sparse = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema), spark.createDataFrame([(1, "c", 1), (1, "b", 2)], schema)
    assert values(ranking.fuse([(dense, 0.55), (sparse, 0.45)], 5).orderBy("rank"), "item_id") == ["b", "a", "c"]
    assert values(ranking.fuse([(dense, 1.0), (sparse.limit(0), 1.0)], 5).orderBy("rank"), "item_id") == ["a", "b"]
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 200), (1, 3, 50)], "q int, r int, n int")
    assert values(ranking.within_budget(rows, ["q"], [F.asc("r")], "n", 1000).orderBy("r"), "r") == [1]
    assert values(ranking.within_budget(rows, ["q"], [F.asc("r")], "n", 500, first_always=True), "r", "used") == [(1, 500)]
    scores = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.5), (2, 0.1)], "q int, s double")
    assert len(values(ranking.gated(scores, ["q"], "s", 0.6), "s")) == 3 and len(values(ranking.near_best(scores, ["q"], "s", 0.6, 0.18), "s")) == 2


def test_bm25_counts_repeated_terms_and_floors_negative_idf(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a d"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "a a"), (3, "b"), (4, "zz")], "query_id long, q string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in ranking.bm25(docs, queries, text.tokens(F.coalesce("text", F.lit(""))), text.tokens(F.col("q")), 10).collect()}
    assert abs(got[2, 1] - 2 * got[1, 1]) < 1e-5 and got[1, 1] > 0 and (3, 1) in got and not any(q == 4 for q, _ in got)


def test_graph_operators(spark):
    versions = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("x", 0, 9), ("y", 3, None)], "id string, o int, v int")
    assert sorted(values(graph.latest(versions, ["id"], [F.col("v")], F.col("o")), "id", "o")) == [("x", 0), ("y", 3)]
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string"), spark.createDataFrame([(2, None, "z"), (3, "c", None)], "k int, p string, q string")
    assert sorted(values(graph.upsert(old, new, "k"), "k", "p", "q"), key=str) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    nodes, edges = spark.createDataFrame([(1,), (2,), (4,)], "n int"), spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert values(graph.retained_edges(edges, nodes, "n", "src", "dst"), "src", "dst") == [(1, 2)] and values(graph.dangling_edges(edges, nodes, "n", "dst"), "dst") == [3] and values(graph.isolated(nodes, edges, "n", ["src", "dst"]), "n") == [4]
    assert sorted(values(graph.within_hops(edges, spark.createDataFrame([(1,)], "seed int"), 2), "node", "hops")) == [(1, 0), (2, 1), (3, 2)]
    records = spark.createDataFrame([(1, "u", "", None), (2, "v", "s", None), (3, "u", "s", "i"), (4, None, "", "i"), (5, "w", None, None)], "r int, url string, sku string, ident string")
    assert sorted(values(graph.resolved(records, "r", ["url", "sku", "ident"]), "node", "component")) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    holes = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "a", "y"), (1, 3, "b", None)], "g int, o int, p string, q string")
    assert values(graph.filled(holes, ["g"], ["o"], ["p", "q"]), "p", "q") == [("a", "x")]
    tags = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate([("New", "B-LOC"), ("York", "I-LOC"), ("is", "O"), ("big", "I-LOC"), ("Ann", "B-PER")])], "d int, o int, w string, t string")
    assert sorted(values(graph.bio_spans(tags, "d", "o", "w", "t"), "label", "text")) == [("LOC", "New York"), ("PER", "Ann")]
    paths = spark.createDataFrame([(["a"],), (["a", "b"],), (["c"],)], "path array<string>")
    assert sorted(values(graph.leaves(paths, "path"), "path")) == [["a", "b"], ["c"]]


def test_components_match_union_find(spark):
    import random

    rng = random.Random(5)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = edges.selectExpr("explode(array(src, dst)) node")
    assert dict(values(graph.components(edges, nodes), "node", "component")) == {x: find(x) for x in root}
    assert values(graph.components(edges.limit(0), spark.createDataFrame([(7,)], "node long")), "node", "component") == [(7, 7)]


def test_catalogue_rules_on_nulls_and_bounds(spark):
    p = spark.createDataFrame([(1, "A", "Red Lamp", ["Home", "Light"], 10.0, True), (2, "b", "Blue lamp", ["home"], None, True), (3, "B", "Desk", ["HOME", "Desk"], 20.0, None), (4, None, None, None, 10.0, False)], "id int, brand string, name string, path array<string>, price double, in_stock boolean")
    ids = lambda **k: sorted(values(p.where(catalog.matches(**k)), "id"))
    assert ids(low=10.0) == [1, 3, 4] and ids(low=10.0, low_inclusive=False) == [3] and ids(high=20.0, high_inclusive=False) == [1, 4]
    assert ids(category_prefix=["home"]) == [1, 2, 3] and ids(brands=["B"]) == [2, 3] and ids(excluded=["b"]) == [1, 4] and ids(in_stock=True) == [1, 2]
    assert ids(groups=[["red", "blue"], ["lamp"]]) == [1, 2]
    rated = p.withColumns({"score": F.lit(1), "rating": F.lit(None).cast("double"), "updated": F.lit(None).cast("date")})
    assert [values(rated.orderBy(*catalog.order_by(m)), "id") for m in ("price_asc", "price_desc")] == [[4, 1, 3, 2], [3, 4, 1, 2]]
    assert values(catalog.facets(p.where("path is not null"), []), "name", "products", "has_children") == [("HOME", 3, True)]
    assert sorted(values(catalog.alternatives(p, p.where("id = 3"), "in_stock", 2), "id")) == []
    drawn = catalog.recommended(rated, ["in_stock"], catalog.order_by("price_asc"), 1, seed=3)
    assert drawn.count() == 3 and values(catalog.recommended(rated, ["in_stock"], catalog.order_by("price_asc"), 1, seed=3), "id") == values(drawn, "id")


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id int, rank int")
    r = metrics.hit_and_mrr(ranks, 3).first()
    assert (r["hit_at_1"], r["hit_at_k"], r["mrr_at_k"], r["mean_rank"], r["queries"]) == (0.333333, 0.333333, 0.333333, 2.5, 3)
    pairs = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], ["a"])], "k int, a array<string>, b array<string>")
    assert sorted(values(metrics.token_overlap(pairs, "k", F.col("a"), F.col("b")), "k", "precision", "recall", "f1")) == [(1, 0.333333, 0.5, 0.4), (2, 0.0, 0.0, 0.0)]
    v = spark.createDataFrame([("g", float(x)) for x in range(1, 5)] + [("g", None)], "g string, v double")
    assert values(metrics.percentiles(v, "g", "v", 0.5), "linear", "nearest_rank", "rounded_index") == [(2.5, 2.0, 3.0)]
    split = metrics.hash_split(spark.range(20), "id", 0.1, 1)
    assert split.where("valid").count() == 2 and metrics.hash_split(spark.range(3), "id", 0.1, 1).where("valid").count() == 1


def test_state(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    events = spark.createDataFrame([(1, "u", 0), (2, "u", 599), (3, "u", 600), (4, "v", 1)], "e int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert dict(values(state.claims(events, ["k"], "ts", 600, "e"), "e", "claimed")) == {1: True, 2: False, 3: True, 4: True}
    assert sorted(values(state.sessions(events, "k", "ts", 300, "e"), "k", "events")) == [("u", 1), ("u", 2), ("v", 1)]
    assert values(state.latest_within(events, "k", "ts", "e", at(600), 600, "e"), "e") in ([3, 4], [4, 3])
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)], "c int, turn int, role string, text string")
    got = {r["turn"]: r["history"] for r in state.history_window(turns, "c", "turn", "role", "text", n=2).collect()}
    assert got[0] == "" and got[4] == "user: t2\nuser: t3"


def test_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "a.json").write_text('[{"id": 2, "x": "b"}, {"id": 1, "x": "a"}]')
    assert values(files.json_records(spark, f"{base}/a.json", ["id", "x"], "id", 1), "x") == ["a"]
    with pytest.raises(files.InvalidSource):
        files.json_records(spark, f"{base}/a.json", ["id", "y"], "id")
    (tmp_path / "q.csv").write_text("﻿key,v\na,1\n ,2\n", encoding="utf-8")
    assert values(files.csv_table(spark, f"{base}/q.csv", ["key"], "key"), "key") == ["a"]
    (tmp_path / "p.txt").write_text("one\ftwo")
    assert sorted(values(files.text_pages(spark, f"{base}/p.txt"), "page", "text")) == [(1, "one"), (2, "two")]
    (tmp_path / "b.json").write_text('{"type": "bundle", "objects": [{"id": "x"}, {"id": "y"}]}')
    assert sorted(values(files.bundle(spark, f"{base}/b.json", "id:string"), "id")) == ["x", "y"] and files.digest(spark, f"{base}/b.json").count() == 1
    for version, n in ((1, 3), (2, 5)):
        files.write_snapshot(spark.range(n), f"{base}/snap", version, {"fingerprint": f"f{version}"})
    assert files.read_snapshot(spark, f"{base}/snap")[0].count() == 5 and not files.needs_rebuild(spark, f"{base}/snap", "f2")
    (tmp_path / "snap/v=3/rows").mkdir(parents=True)  # incomplete: the last good one stands
    assert files.read_snapshot(spark, f"{base}/snap")[1]["version"] == 2 and files.read_snapshot(spark, f"{base}/snap", fingerprint="f1")[1]["version"] == 1
    assert files.needs_rebuild(spark, f"{base}/other", "f")
    files.write_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>"), f"{base}/out")
    assert values(spark.read.csv(f"{base}/out", header=True, escape='"'), "l") == ['["a","b"]']
    nodes, edges = spark.createDataFrame([("a", "x<y")], "id string, label string"), spark.createDataFrame([("a", "a", "t")], "source string, target string, type string")
    assert [r for r in values(files.graphml(nodes, edges), "value") if "x&lt;y" in r]
    site = spark.createDataFrame([("<urlset><url><loc>https://a/b</loc></url><url><loc>https://a/c</loc></url></urlset>",)], "value string")
    assert sorted(values(html.sitemap(site), "loc")) == ["https://a/b", "https://a/c"]


def test_html_records_cascade(spark):
    app = '<script id="x" type="application/json">{"props": {"products": [{"name": " Lamp ", "sale_price": "1,200", "price": 1500, "sold_out": true}]}}</script>'
    linked = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Desk", "offers": {"price": 5, "availability": "https://schema.org/InStock"}}]}</script>'
    card = '<div class="product card"><h3>Chair &amp; co</h3><a href="/c"><img src="i.png"></a><span class="price">99</span></div>'
    pages = spark.createDataFrame([(1, app + linked + card), (2, linked + card), (3, card), (4, "<p>no</p>"), (5, None), (6, '<script type="application/json">{bad</script>')], "page_id long, html string")
    got = sorted(values(html.catalogue(pages, "page_id", "html"), "id", "name", "price", "in_stock", "kind"))
    assert got == [(1, "Lamp", 1200.0, False, "app"), (2, "Desk", 5.0, True, "json-ld"), (3, "Chair & co", 99.0, None, "card")]


def test_streams(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [(1, "a", 0), (1, "a", 10), (2, "b", 20), (1, "a", 30), (3, "b", 4000)]
    spark.createDataFrame(rows, "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{base}/in")
    stream = lambda: live.files(spark, f"{base}/in", "id int, k string, s int, ts timestamp")
    assert sorted(values(live.drained(live.claimed_once(stream(), ["id"], "ts", "1 hour"), "t1", "append", f"{base}/c1"), "id")) == [1, 2, 3]
    assert sorted(values(live.drained(live.windowed_counts(stream(), "ts", "k", "1 hour"), "t2", "complete", f"{base}/c2"), "k", "events")) == [("a", 3), ("b", 1), ("b", 1)]
    assert sorted(values(live.drained(live.session_counts(stream(), "ts", "k", "1 minute"), "t3", "complete", f"{base}/c3"), "k", "events")) == [("a", 3), ("b", 1), ("b", 1)]
    got = values(live.drained(live.recent_values(stream(), "k", "ts", "id", 2, 100_000), "t4", "update", f"{base}/c4"), "k", "values")
    assert sorted(got) == [("a", ["1", "1"]), ("b", ["3"])]
