"""The pipeline on the smallest tables, stage by stage against brute force."""

import re

import pyarrow as pa

import corpus_pipeline
from corvane.llm import decontaminate, neardup, packing, queries, secrets

from .test_operators import brute_groups, rows, some

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in rows(docs)}

    kept = stages["language_id"](spark, docs, SF)
    told = {r["doc_id"]: r["text"] for r in rows(kept)}
    assert kept.columns == names and len(told) >= 0.98 * len(before) and all(before[i] == t for i, t in told.items())

    single = stages["near_dedup"](spark, kept, SF)
    groups = brute_groups(list(told.items()), 5, 80, 100)
    assert {r["doc_id"] for r in rows(single)} == {i for i, (_, root) in groups.items() if i == root} and single.columns == names

    clean = stages["decontamination"](spark, single, SF)
    items = {r["item_id"]: r["text"] for r in rows(spark.read.parquet(f"{SF}/benchmark.parquet"))}
    index = decontaminate.build([(i, t.encode()) for i, t in items.items()])
    held = {r["doc_id"]: r["text"] for r in rows(single)}
    assert {r["doc_id"] for r in rows(clean)} == {i for i, t in held.items() if not decontaminate.search(index, decontaminate.split(t.encode()))}
    assert not any(t in r["text"] for r in rows(clean) for t in items.values())

    blank = stages["secret_scans"](spark, clean, SF)
    texts = {r["doc_id"]: r["text"] for r in rows(clean)}
    assert blank.columns == names and blank.count() == len(texts)
    for r in rows(blank):
        assert r["n_chars"] == len(r["text"])
        if r["text"] != texts[r["doc_id"]]:
            assert "[secret]" in r["text"]
        assert not any(len(m.group(g)) >= least for p, g, least in secrets.BASE.values() for m in re.finditer(p, r["text"], re.A))

    pieces = rows(stages["packing"](spark, blank, SF))
    assert {r["doc_id"] for r in pieces} == set(texts) and max(r["offset"] + r["length"] for r in pieces) <= 2048


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_rows_of_null_and_repeated_ids_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base, other, third, fourth = (f"{some(i, 120)} {i}" for i in range(4))
    near = base.replace("river", "rivers", 1)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    held = f"{some(9, 80)} {item} {some(8, 80)}"
    texts = [(None, base), (None, base), (None, near), (None, other), (7, third), (7, third), (7, fourth), (8, fourth), (None, ""), (None, None), (None, None)]
    few = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    got = [(r["doc_id"], r["text"]) for r in rows(stages["near_dedup"](spark, few.repartition(3), SF))]
    alone = [x for x in got if x[1] in (base, near)]
    assert len(alone) == 1 and sorted(got, key=str) == sorted([*alone, (None, other), (7, third), (7, fourth), (None, ""), (None, None), (None, None)], key=str)

    texts = [(None, held), (None, other), (7, held), (7, third), (8, None), (8, None)]
    few = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    got = [(r["doc_id"], r["text"]) for r in rows(stages["decontamination"](spark, few, SF))]
    assert sorted(got, key=str) == sorted([(None, other), (7, third), (8, None), (8, None)], key=str)


def test_a_worker_keeps_no_caches_of_stages_that_are_over(spark):
    packing.tokenizer(queries.VOCABULARY, queries.RANKS).encode("words of a stage before")
    texts = pa.array([f"{some(i, 60)} {i}" for i in range(1200)])
    digests = pa.array([neardup.xxhash.xxh3_128_digest(neardup.shingles(t.as_py().encode(), 5).tobytes()) for t in texts], pa.binary())
    sets = list(neardup.setter(5)(iter([pa.RecordBatch.from_arrays([digests, texts], ["digest", "text"])])))
    assert sum(b.num_rows for b in sets) == 1200 and not neardup.KNOWN and not packing.tokenizer.cache_info().currsize

    def held(batches):  # in the workers, after tasks of the operator
        yield pa.RecordBatch.from_arrays([pa.array([len(neardup.KNOWN)])], ["held"])

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert docs.mapInArrow(neardup.sketcher(5, (80, 100)), neardup.SKETCHED).count() == docs.count()
    assert {r["held"] for r in spark.range(0, 8, 1, 8).mapInArrow(held, "held long").collect()} == {0}
