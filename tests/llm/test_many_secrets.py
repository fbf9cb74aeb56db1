"""Texts of very many secrets: the work grows with the hits of a text, not with their square."""

import hashlib
import random
import re
import time

from corvane.llm import secrets

UNIT = "0123456789abcdef01234567 "


def test_a_hundred_thousand_hits_of_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, UNIT * n), (2, "none here")], "doc_id long, text string")
    began = time.perf_counter()
    found = secrets.ledgered(docs)
    got = {r["doc_id"]: r for r in secrets.digests(*found).collect()}
    want = ",".join(f"hex:{25 * i}:{25 * i + 24}" for i in range(n))
    assert got[1]["n_hex"] == n and got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[2]["spans"] == ""
    assert time.perf_counter() - began < 60
    began = time.perf_counter()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, *found).collect()}
    assert clean == {1: "[secret] " * n, 2: "none here"}
    assert time.perf_counter() - began < 60


def test_parts_over_block_borders_and_overlaps(spark):
    """Spans that begin, end and lie at borders of blocks, letters of two and four bytes, overlapping kinds."""
    r = random.Random(8)
    fill = lambda n: "".join(r.choices(["é", "x ", "\n", "😀", "z."], k=n))
    bits = ["a1" * 14, "password = hunter22", "token: " + "ab12" * 8, "AKIA" + "A1" * 9, "bearer " + "c3" * 15]
    texts = ["".join(fill(r.randrange(900)) + " " + r.choice(bits) + " " for _ in range(12)) for _ in range(12)]
    texts += ["x" * k + " " + bits[0] for k in (1021, 1022, 1023, 1024, 2046, 2047)] + [bits[0], bits[0] + " ", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = {**secrets.BASE, **secrets.MORE}

    def plain(t):
        spans = sorted((m.start(), m.end()) for p, g, least in rules.values() for m in re.finditer(p, t) if len(m.group(g)) >= least)
        out, at = "", 0
        while spans:
            begin, end = spans.pop(0)
            while spans and spans[0][0] < end:
                end = max(end, spans.pop(0)[1])
            out, at = out + t[at:begin] + "[secret]", end
        return out + t[at:]

    got = {x["doc_id"]: x["text"] for x in secrets.redact(docs, *secrets.ledgered(docs)).collect()}
    assert got == {i: t if t is None else plain(t) for i, t in enumerate(texts)}
