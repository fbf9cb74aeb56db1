"""Content records, JSON trees and feeds: small cases with what they must give."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import cms
from corvane.sources.feeds import Conflict, Feeds
from corvane.sources.files import InvalidSource


def rich(*texts):
    return {"nodeType": "document", "content": [{"nodeType": "p", "content": [{"nodeType": "text", "value": x}]} for x in texts]}


def link(key):
    return {"sys": {"type": "Link", "id": key}}


ENTRIES = [
    ("p1", "page", {"fields": {"name": "Set one", "body": rich(" Bucket  A ", "6 pieces", "฿1,299", "THB 1299"), "components": [link("i1"), link("gone"), link("i1"), {"x": 1}], "image": link("a2")}}),
    ("p2", "page", {"fields": {"name": "News", "body": rich("We are open")}}),
    ("p3", "page", {"fields": {"body": 7}}),
    ("i1", "item", {"fields": {"itemName": "Zinger (old)", "shortDescription": "hot", "longDescription": "  "}}),
    ("i2", "item", {"fields": {"itemName": "Unknown", "shortDescription": "x"}}),
    ("i3", "item", {"fields": {"itemName": "zinger"}}),
    ("o1", "promotion", {"fields": {"headline": "Now", "startDate": "2024-01-01T00:00:00+07:00", "endDate": "2024-02-01T00:00:00Z", "applicableDays": ["Mon", "Fri"], "onClick": "/d/1", "noteLine": "99 บาท"}}),
    ("o2", "promotion", {"fields": {"headline": "Over", "endDate": "2024-01-09T00:00:00Z"}}),
    ("o3", "promotion", {"fields": {"headline": "Later", "startDate": "2024-01-11"}}),
    ("o4", "promotion", {"fields": {"displayTitle": "Open", "startDate": "soon"}}),
    ("o5", "promotion", {"fields": {"subHeadline": "nameless"}}),
    ("x", "other", {"fields": {"headline": "no"}}),
]


def test_records_of_entries(spark):
    rows = [(k, kind, json.dumps(body), "clash") for k, kind, body in ENTRIES] + [("b1", "page", "{broken", ""), ("b2", "page", None, ""), (None, "page", "{}", ""), ("b3", None, "[]", "")]
    entries = spark.createDataFrame(rows, "entry_id string, type string, body string, tree string")
    assets = spark.createDataFrame([("a1", "ftp://x/1"), ("a2", "https://img.example/2.png?w=3"), ("a3", None)], "asset_id string, url string")
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    got = {r["entry_id"]: r for r in cms.records(entries, assets, {"zinger": ("Spicy", ["z", "z"])}, now, "m", "o", "https://s.example").collect()}
    assert set(got) == {"p1", "i1", "o1", "o4"}
    p = got["p1"]
    assert (p["kind"], p["name"], p["price"], p["description"], p["aliases"], p["components"], p["image_url"], p["url"]) == ("menu", "Bucket A", "฿1,299.00", "6 pieces", ["Set one", "Bucket A"], ["Zinger (old)"], "https://img.example/2.png", "m")
    i = got["i1"]
    assert (i["name"], i["description"], i["aliases"], i["price"], i["image_url"], i["components"]) == ("Spicy", "hot", ["Zinger (old)", "z"], "", "", [])
    o = got["o1"]
    assert (o["price"], o["url"], o["description"]) == ("฿99.00", "https://s.example/d/1", "99 บาท\nใช้ได้: Mon, Fri\nช่วงโปรโมชัน: 2024-01-01T00:00:00+07:00 ถึง 2024-02-01T00:00:00Z")
    assert got["o4"]["name"] == "Open" and got["o4"]["url"] == "o"


def test_no_entries_no_records(spark):
    empty = spark.createDataFrame([], "entry_id string, type string, body string")
    assert cms.records(empty, spark.createDataFrame([], "asset_id string, url string"), {"a": ("b", [])}, F.current_timestamp(), "m", "o", "s").count() == 0


def test_leaves_of_deep_and_broken_trees(spark):
    deep = "x"
    for _ in range(12):
        deep = [deep]
    rows = [(1, json.dumps({"a": [1, {"b": None, "c": True}], "e": {}, "f": []})), (2, json.dumps({"d": deep})), (3, "{"), (4, None), (5, "7"), (1, '"s"')]
    got = cms.leaves(spark.createDataFrame(rows, "k long, body string"), "k", "body")
    assert sorted((r["k"], r["path"], r["kind"], str(r["value"])) for r in got.collect()) == [
        (1, "$", "string", "s"), (1, "$.a[0]", "bigint", "1"), (1, "$.a[1].b", "null", "None"), (1, "$.a[1].c", "boolean", "true"),
        (2, "$.d" + "[0]" * 12, "string", "x"), (5, "$", "bigint", "7"),
    ]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_feeds_are_replaced_whole_and_one_writer_wins(spark, tmp_path):
    store = Feeds(spark, f"file://{tmp_path}/feeds")
    make = lambda *rows: spark.createDataFrame(rows, "feed string, n long")
    with pytest.raises(InvalidSource):
        store.read()
    assert store.replace("a", make(("a", 1), ("a", 2))) == 1
    assert store.replace("b", make(("b", 1))) == 2
    # both look at version 2: the first to finish wins, the other feed's change is taken over
    assert store.replace("a", make(("a", 9)), seen=2) == 3
    with pytest.raises(Conflict):
        store.replace("a", make(("a", 7)), seen=2)
    assert store.replace("b", make(("b", 5)), seen=2) == 4
    assert rows_of(store.read()) == [("a", 9), ("b", 5)]
    assert rows_of(store.read(2)) == [("a", 1), ("a", 2), ("b", 1)]
    with pytest.raises(InvalidSource):
        store.replace("a", spark.createDataFrame([(1,)], "n long"))
    store.replace("a", None)
    assert rows_of(store.read()) == [("b", 5)]
    store.replace("b", make())
    assert rows_of(store.read()) == []


def test_a_killed_writer_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    store = Feeds(spark, f"file://{tmp_path}/feeds")
    store.replace("a", spark.createDataFrame([("a", 1)], "feed string, n long"))

    def killed(version, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_claim", killed)
    with pytest.raises(KeyboardInterrupt):
        store.replace("a", spark.createDataFrame([("a", 2)], "feed string, n long"))
    later = Feeds(spark, f"file://{tmp_path}/feeds")
    assert rows_of(later.read()) == [("a", 1)] and later.version() == 1
    assert later.replace("a", spark.createDataFrame([("a", 3)], "feed string, n long")) == 2


def test_writers_of_one_version_at_once(spark, tmp_path):
    """A version that is there already isn't overwritten."""
    store = Feeds(spark, f"file://{tmp_path}/feeds")
    assert store._claim(1, '{"feeds": {}, "schema": null}') and not store._claim(1, "other")
    assert store.entry(1) == {"feeds": {}, "schema": None}
