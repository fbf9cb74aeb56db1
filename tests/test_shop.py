"""First-wins over several keys, bounded claims, paths and frontiers against plain versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, identity, state
from corvane.plans import shop

def plain_first(rows):
    seen, kept = {"a": set(), "b": set(), "c": set()}, []
    for r, *keys in sorted(rows):
        own = {k: v for k, v in zip("abc", keys) if v}
        if any(v in seen[k] for k, v in own.items()):
            continue
        for k, v in own.items():
            seen[k].add(v)
        kept.append(r)
    return kept


def kept(spark, rows, rounds):
    table = spark.createDataFrame(rows, "r long, a string, b string, c string")
    return sorted(x["r"] for x in identity.first_of_keys(table, "r", {"id": F.col("a"), "sku": F.col("b"), "url": F.col("c")}, rounds).collect())


@pytest.mark.parametrize("rounds", [1, 12])
def test_first_wins_is_not_transitive(spark, rounds):
    """a - b by one key, b - c by another: b is refused and blocks nothing, so c stays; components would keep one row of the three."""
    rows = [(1, "x", None, None), (2, "x", "s", None), (3, None, "s", "u"), (4, None, None, "u"), (5, None, "", None), (6, None, None, None)]
    assert kept(spark, rows, rounds) == plain_first(rows) == [1, 3, 5, 6]


@pytest.mark.parametrize("seed,rounds", [(1, 12), (2, 2)])
def test_first_wins_of_random_keys_and_hot_ones(spark, seed, rounds):
    r = random.Random(seed)
    key = lambda p, n: r.choice([None, "", f"{p}{r.randrange(n)}", "hot"]) if r.random() < 0.7 else f"{p}{r.randrange(3 * n)}"
    rows = [(i, key("a", 40), key("b", 60), key("c", 400)) for i in r.sample(range(10_000), 600)]
    assert kept(spark, rows, rounds) == plain_first(rows)


def test_a_long_chain_outlasts_the_rounds(spark):
    """Each row shares a key with the next: every other one stays, though a round settles only one link."""
    rows = [(i, f"k{i // 2}", f"l{(i + 1) // 2}", None) for i in range(300)]
    assert kept(spark, rows, 3) == plain_first(rows)


def plain_claims(rows, ttl, most):
    held, out = {}, {}
    for scope, order, name, t, release in sorted(rows, key=lambda x: (x[3].timestamp() if x[3] else 0.0, x[1])):
        own = held.setdefault(scope, {})
        now = t.timestamp() if t else 0.0
        if release:
            own.pop(name, None)
            out[order] = None
            continue
        for k in [k for k, e in own.items() if e <= now]:
            del own[k]
        if not name:
            out[order] = True
        elif name in own:
            out[order] = False
        else:
            if len(own) >= most:
                del own[min(own, key=lambda k: list(own).index(k))]
            own[name] = now + ttl
            out[order] = True
    return out


def test_claims_expire_are_released_and_give_way(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("x", 1, "e1", at(0), False), ("x", 2, "e1", at(1), False), ("x", 3, "e1", at(2), True), ("x", 4, "e1", at(3), False), ("x", 5, "e1", at(14), False), ("x", 6, "", at(15), False), ("x", 7, None, at(16), None)]
    rows += [("y", 20 + i, f"e{i % 4}", at(i), False) for i in range(12)]
    table = spark.createDataFrame(rows, "scope string, n long, name string, ts timestamp, release boolean")
    got = {r["n"]: r["claimed"] for r in state.bounded_claims(table, "scope", "name", "ts", "release", "n", 10, 3).collect()}
    assert got == plain_claims(rows, 10, 3)
    assert [got[n] for n in range(1, 8)] == [True, False, None, True, True, True, True]
    assert all(got[20 + i] for i in range(12))  # three are held of four in turn: each new one drops the oldest


def test_claims_of_random_events_and_of_none(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, *map(str, range(9))]), r.choice([None, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(600))]), r.choice([True, False, False, None])) for i in range(500)]
    table = spark.createDataFrame(rows, "scope string, n long, name string, ts timestamp, release boolean")
    found = state.bounded_claims(table, "scope", "name", "ts", "release", "n", 60, 5)
    assert {x["n"]: x["claimed"] for x in found.collect()} == plain_claims(rows, 60, 5)
    assert state.bounded_claims(table.where("false"), "scope", "name", "ts", "release", "n", 60, 5).count() == 0


def test_the_stream_gives_what_the_batch_gives(spark):
    d = "/root/testdata/sf0.001"
    batch, stream = rows_of(shop.bounded_claims(spark, d)), rows_of(shop.stream_bounded_claims(spark, d))
    assert batch and sorted(batch, key=str) == sorted(stream, key=str)


def rows_of(df):
    return [(x["kind"], x["click_id"], x["claimed"]) for x in df.collect()]


def plain_paths(edges, seeds, low, high, limit, direction, end=lambda n: True):
    out = {}
    for ask in sorted({a for a, _ in seeds}):
        found = []

        def walk(seed, node, nodes, rels):
            if low <= len(rels) <= high and end(node):
                found.append((rels, seed, nodes))
            if len(rels) < high:
                for i, a, b in edges:
                    if i in rels:
                        continue
                    if direction != "in" and a == node:
                        walk(seed, b, [*nodes, b], [*rels, i])
                    if direction != "out" and b == node and (direction == "in" or a != b):
                        walk(seed, a, [*nodes, a], [*rels, i])

        for seed in sorted({s for a, s in seeds if a == ask}):
            walk(seed, seed, [seed], [])
        out[ask] = ([(s, n, r) for r, s, n in sorted(found)[:limit]], len(found) > limit)
    return out


@pytest.mark.parametrize("direction,low,high,end", [("both", 0, 4, None), ("out", 1, 3, None), ("in", 2, 4, None), ("both", 1, 3, "n3")])
def test_paths_are_those_of_a_plain_walk(spark, direction, low, high, end):
    r = random.Random(7)
    edges = [(i, f"n{r.randrange(9)}", f"n{r.randrange(9)}") for i in range(22)]
    seeds = [(1, "n0"), (1, "n4"), (1, "n4"), (2, "n5"), (3, "lost")]
    table = spark.createDataFrame([*edges, (None, "n0", "n1"), (99, None, "n1")], "id long, src string, dst string")
    for limit in (3, 10_000):
        found = graph.paths(table, spark.createDataFrame(seeds, "ask long, seed string"), low, high, limit, direction, None if end is None else F.col("node") == end)
        got = {}
        for x in found.orderBy("ask", "place").collect():
            got.setdefault(x["ask"], []).append((x["seed"], x["nodes"], x["rels"], x["truncated"]))
        want = plain_paths(edges, seeds, low, high, limit, direction, (lambda n: True) if end is None else (lambda n: n == end))
        assert {a: ([x[:3] for x in v], v[0][3]) for a, v in got.items()} == {a: v for a, v in want.items() if v[0]}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_a_turn_holds_no_earlier_turn(spark):
    """Plans of six hops and of four steps have a few exchanges, whatever came before."""
    edges = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}") for i in range(10)], "id long, src string, dst string")
    reached = graph.within_hops(edges, spark.createDataFrame([("n0",)], "seed string"), 6)
    assert exchanges(reached) == 0 and {(r["node"], r["hops"]) for r in reached.collect()} == {(f"n{i}", i) for i in range(7)}
    assert exchanges(graph.paths(edges, spark.createDataFrame([(1, "n3")], "ask long, seed string"), 0, 4, 5)) < 10
