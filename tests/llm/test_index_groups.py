"""Benchmarks that need many indexes: one group at a time, with the results of a single index."""

from pyspark.sql import functions as F

from corvane.llm import decontaminate

SF = "/root/testdata/sf0.001"


def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.contaminated(docs, items).collect())
    kept = sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    return hits, kept


def test_many_groups_one_at_a_time(spark, monkeypatch):
    whole = results(spark)
    assert whole[0]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(decontaminate, "PART_BYTES", items.agg(F.sum(F.octet_length("text"))).first()[0] // 12)
    monkeypatch.setattr(decontaminate, "GROUP", 1)
    given, alive = decontaminate.indexes, []
    seen = []

    def watched(*args):
        for group, more in given(*args):
            assert not alive  # the group before was given up
            alive.extend(group)
            seen.append(len(group))
            yield group, more
        alive.clear()

    def ended(group):
        for shared in group:
            alive.remove(shared)
            shared.destroy()

    monkeypatch.setattr(decontaminate, "indexes", watched)
    monkeypatch.setattr(decontaminate, "ended", ended)
    assert results(spark) == whole
    assert len(seen) >= 20 and set(seen) == {1}
