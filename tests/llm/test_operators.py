"""Each operator against a brute-force version, and its defined results for odd input."""

import hashlib
import html
import math
import re
import shutil
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import audio, decontaminate, hilbert, hmm, htmltext, langid, neardup, packing, quality, queries, secrets
from corvane.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, blob string, key string, share int"
WORDS = "the of and in stone river bright cold paper window seven letter green under over table singing forest little road".split()


def some(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


def odd_rows() -> list[tuple]:
    base = some(1, 80)
    near = base.replace("river", "rivers", 1)
    texts = [base, near, base, some(2, 120), None, "", "   ", "a", "two words", some(3, 6000), "x" * 50_000, "PASSWORD = hunter22 " + base, "é ß 中文 \u0000 ퟿", "token=abc secret: 'abcdefgh' " + "0123456789abcdef" * 3, "AKIA" + "Z9" * 12]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base, "en", "s0", 1), (None, None, None, None, None)]
    return [(*r, "clash", "clash", "clash", 7) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_scores_match_the_base_and_beat_it_on_held_out_texts(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*t.encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    got = rows(hmm.score(docs))
    assert len(got) == len(texts)
    for r in got:
        tokens = [*texts[r["doc_id"]].encode().lower().split(), b""]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(0)
    k, symbols = 3, 5
    model = hmm.Model(np.full(k, 1 / k), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(symbols), k).T)
    seqs = [np.array([0, 3, 1, 4]), np.array([2, 2]), np.array([1])]
    for s, got in zip(seqs, hmm.likelihoods(model, seqs)):
        total = 0.0
        for path in np.ndindex(*[k] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert abs(math.log10(total) - got) < 1e-4
    start, move, emit, log = hmm.expected(model, seqs)
    assert abs(start.sum() - 3) < 1e-3 and abs(move.sum() - 4) < 1e-3 and abs(emit.sum() - 7) < 1e-3
    assert abs(log / math.log(10) - sum(hmm.likelihoods(model, seqs))) < 1e-4
    # expected counts by summing over all paths
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))]
    for s in seqs:
        paths = {}
        for path in np.ndindex(*[k] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            paths[path] = p
        for path, p in paths.items():
            p /= sum(paths.values())
            want[0][path[0]] += p
            for t, x in enumerate(path):
                want[2][s[t], x] += p
                if t:
                    want[1][path[t - 1], x] += p
    for got, right in zip((start, move, emit), want):
        assert np.allclose(got, right, atol=1e-4)


def test_full_passes_raise_the_likelihood_and_scores_are_the_models(docs):
    fitted = hmm.fit(docs, passes=5)
    assert len(fitted.objectives) == 5 and all(b >= a - 1e-6 * abs(a) for a, b in zip(fitted.objectives, fitted.objectives[1:]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*t.encode().lower().split(), b""])
    single = {w: int(s) for w, s in zip(fitted.hot.words, fitted.hot.symbol) if s < hmm.OWN}
    size, kinds = Counter(), Counter()
    for w, c in train.items():
        if w not in single:
            size[hmm.class_of(w)] += c
            kinds[hmm.class_of(w)] += 1
    assert [w for w, _ in sorted(train.items(), key=lambda x: (-x[1], x[0])) if w][: len(single) - 1] == [w for w in fitted.hot.words if w in single and w]
    model = fitted.model
    for r in rows(hmm.scored(fitted)):
        tokens = [*texts[r["doc_id"]].encode().lower().split(), b""]
        total, now = 0.0, None
        for w in tokens:
            s = single.get(w, hmm.class_of(w))
            now = (model.start if now is None else now @ model.move) * model.emit[s]
            total += math.log10(now.sum())
            now = now / now.sum()
            if w not in single:
                total += math.log10((train[w] + 0.5) / (size[s] + 0.5 * (kinds[s] + 1)))
        assert abs(total - r["score"]) < 1e-7 * abs(total)


def test_frequent_words_are_cut_by_their_counts(spark):
    words = spark.createDataFrame([(bytearray(str(i).encode()), c) for i, c in enumerate([5000, 5000, 4100, 1025, 900, 3, 3, 3, 1])], "word binary, c long")
    for most, least in ((9, 1), (8, 3), (7, 900), (4, 1024), (3, 4096), (0, 1 << 62)):
        got = hmm.frequent(words, most)
        assert words.where(F.col("c") >= got).count() <= most and words.where(F.col("c") >= least).count() == words.where(F.col("c") >= got).count()


def test_scores_of_odd_rows(odd, none):
    got = rows(hmm.score(odd))
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got)[:4] == [1, 1, 1, 1]
    assert rows(hmm.score(none)) == []


def brute_groups(texts: list[tuple], n: int, num: int, den: int) -> dict:
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n, num", [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, docs, n, num):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    extra = []
    for g in range(6):  # chains of small changes, short and long
        words = some(50 + g, 30 + 25 * g).split()
        for step in range(12):
            extra.append((10_000 + 100 * g + step, " ".join(words)))
            words[(step * 7) % len(words)] = f"w{g}{step}"
    both = texts + extra
    got = rows(neardup.group(spark.createDataFrame(both, "doc_id long, text string"), n, (num, 100)))
    want = brute_groups(both, n, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_rows_without_ids_are_met_by_their_sets(spark, monkeypatch):
    base = some(1, 90)
    texts = [base, base, base.replace("river", "rivers", 1), some(2, 90), None]
    few = spark.createDataFrame([(None, t) for t in texts] + [(5, base)], "doc_id long, text string")
    for sent in (neardup.SENT, 0):
        monkeypatch.setattr(neardup, "SENT", sent)
        got = rows(neardup.group(few))
        assert sorted(str(r["component_id"]) for r in got) == ["5", "5", "5", "5", "None", "None"]
    with pytest.raises(ValueError):
        neardup.group(few, threshold=(79, 100))


def exact_components(texts: list[tuple], n: int, num: int, den: int) -> dict:
    """doc_id -> smallest linked doc_id, by lists of each set's rarest values: no pair at the threshold can miss all of those."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    number, sets, root, first, index = {}, {}, {}, {}, defaultdict(list)
    for i, text in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        grams = {tuple(found[k : k + n]) for k in range(max(len(found) - n + 1, 1))} if found else set()
        sets[i], root[i] = frozenset(number.setdefault(g, len(number)) for g in grams), i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def link(i, j):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    for i, held in sets.items():
        if held and first.setdefault(held, i) != i:
            link(i, first[held])
    held_by = Counter(v for held in first for v in held)
    for held, i in sorted(first.items(), key=lambda x: len(x[0])):
        rare = sorted(held, key=lambda v: (held_by[v], v))[: len(held) - -(-len(held) * num // den) + 1]
        for j in {j for v in rare for j in index[v]}:
            if find(i) != find(j) and len(held & sets[j]) * den >= len(held | sets[j]) * num:
                link(i, j)
        for v in rare:
            index[v].append(i)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_groups_of_ten_thousand_documents(spark, n, num):
    rng = np.random.default_rng(n)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    near = []
    for at in range(0, len(texts), 5):  # near copies on both sides of the threshold
        found = (texts[at][1] or "").split()
        for k in rng.integers(0, max(len(found), 1), max(len(found) * int(rng.integers(1, 9)) // 200, 1)):
            if found:
                found[k] = f"changed{k}"
        near.append((1_000_000 + at, " ".join(found)))
    both = texts + near
    got = rows(neardup.group(spark.createDataFrame(both, "doc_id long, text string").repartition(16), n, (num, 100)))
    want = exact_components(both, n, num, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(want) - 500


def test_groups_of_odd_rows(odd, none):
    got = rows(neardup.group(odd, 3, (85, 100)))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == odd.count() and by[1][0]["component_id"] == 0 and by[2][0]["component_id"] == 0
    assert [r["n_shingles"] for i in (4, 5, 6) for r in by[i]] == [0, 0, 0] and by[5][0]["kept"] and len(by[0]) == 2
    assert rows(neardup.group(none)) == []


def test_components_of_a_long_chain(spark):
    space = neardup.Workspace(spark, "t")
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r["node"]: r["root"] for r in rows(neardup.components(space, links, "c"))} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_language_of_held_out_texts(docs):
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    got = rows(langid.identify(docs.where(fold("doc_id", 5) == 0), model))
    assert sum(r["_lang"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert sum(r["_rejected"] for r in got) <= 0.03 * len(got) and all(0 <= r["_score"] <= 1 for r in got)


def test_predictions_are_those_of_plain_sums(docs):
    model = langid.fit(docs, F.lit(True), per_label=40)
    for r in docs.limit(60).collect():
        text = (r["text"] or "").encode()
        kept = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text)
        z, count = np.zeros(len(model.labels)), 0
        line = " " + " ".join(kept.split(" ")).strip() + " "
        line = re.sub(" +", " ", line)
        for n, odd in ((2, 0), (3, 0x9E3779B9), (4, 0x3C6EF372)):
            for at in range(len(line) - n + 1):
                gram = line[at : at + n]
                if n > 2 and " " in gram[1:-1]:
                    continue
                h = 0
                for c in gram:
                    h = (h * 769 + ord(c)) % (1 << 32)
                h = (h + odd) % (1 << 32)
                h = ((h ^ (h >> 15)) * 2654435761 % (1 << 32)) >> (32 - langid.BITS)
                z, count = z + model.table[h], count + 1
        z = (z / max(count, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        label, score, rejected = langid.predict(model, text)
        assert label == model.labels[int(p.argmax())] and abs(score - p.max()) < 1e-9 and rejected == (p.max() < model.bound)


def test_a_hot_id_gives_one_text_of_each_label(spark):
    few = spark.createDataFrame([(1, f"text {i}", "en") for i in range(50)] + [(1, "texte", "fr"), (2, None, "en"), (3, "x", None), (4, "four", "en")], "doc_id long, text string, lang string")
    assert sorted(langid.sample(few, F.lit(True), 10)) == [(1, b"text 0", "en"), (1, b"texte", "fr"), (4, b"four", "en")]
    wide = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"))
    assert Counter(r[2] for r in langid.sample(wide, F.lit(True), 100)) == {"x": 100, "y": 100}


def test_columns_of_the_operators_names_stay(spark):
    few = spark.createDataFrame([(1, "password=abcdef99 and more", "en", "a", "b", "c", "d", "e")], "doc_id long, text string, lang string, _lang string, _rejected string, _blob string, _spans string, _path string")
    got = rows(langid.identify(few, langid.fit(few, F.lit(True))))[0]
    assert (got["_lang"], got["_rejected"]) == ("a", "b") and "_lang_" in got
    clean = rows(secrets.redact(few, *secrets.ledgered(few)))[0]
    assert clean == {**rows(few)[0], "text": "[secret] and more"}


def test_language_of_odd_rows(odd, none):
    got = rows(langid.identify(odd, langid.fit(odd, F.lit(True))))
    assert {r["doc_id"] for r in got if r["_lang"] == "und"} >= {4, 5, 6} and all(r["_rejected"] for r in got if r["_lang"] == "und")
    assert all(r["_lang"] == "und" for r in rows(langid.identify(odd, langid.fit(none, F.lit(True)))))


def test_payload_survives_and_equal_texts_are_equal(odd, none):
    got = rows(audio.features(audio.encode(odd)))
    by_text = defaultdict(set)
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        by_text[raw].add((r["media_sha256"], r["feature"]))
    assert len(got) == odd.count() and all(len(x) == 1 for x in by_text.values())
    assert rows(audio.features(audio.encode(none))) == []


def test_the_pcm_form_is_stored_and_read_back(spark, monkeypatch):
    saved, given = {}, []
    save, drop = audio.Workspace.save, audio.Workspace.drop

    def kept(self, df, name, compression=None):
        out = save(self, df, name, compression)
        if "pcm" in out.columns:
            saved.update({r["doc_id"]: bytes(r["pcm"]) for r in out.collect()})
        return out

    monkeypatch.setattr(audio.Workspace, "save", kept)
    monkeypatch.setattr(audio.Workspace, "drop", lambda self, name: given.append(name) or drop(self, name))
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)] + [(None, "x"), (50, None), (3, "again")], "doc_id long, text string")
    media = audio.kept(docs)
    got = rows(audio.features(media))
    assert len(got) == 43 and len(given) == audio.PARTS and {r["doc_id"] for r in got} == set(saved)
    forms = {(r["doc_id"], audio.store_pcm(bytes(r["media"]))) for r in rows(media)}
    assert all(f in forms for f in saved.items())
    assert {(r["doc_id"], r["pcm_sha256"]) for r in got} == {(i, hashlib.sha256(f).hexdigest()) for i, f in forms}


def test_companding_tables_and_adpcm():
    u, a = audio.mulaw(), audio.alaw()
    assert (u[0xFF], u[0x7F], u[0x00], u[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 40), np.uint8)
    for block, got in zip(blocks, audio.adpcm(blocks)):
        now, index, want = int(block[:2].copy().view("<i2")[0]), min(int(block[2]), 88), []
        want.append(now)
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(audio.STEPS[index])
                size = step >> 3
                size += step if code & 4 else 0
                size += step >> 1 if code & 2 else 0
                size += step >> 2 if code & 1 else 0
                now = max(-32768, min(32767, now - size if code & 8 else now + size))
                index = max(0, min(88, index + int(audio.INDEX[code & 7])))
                want.append(now)
        assert got.tolist() == want


def test_encoded_forms_are_near_their_samples():
    x = (8000 * np.sin(np.arange(5000) / 9) + 300 * np.cos(np.arange(5000))).astype(np.int16)
    for kind, most in ((audio.PCM, 0), (audio.MULAW, 260), (audio.ALAW, 260), (audio.ADPCM, 2500)):
        y, rate = audio.samples(audio.stored(x, kind))
        gap = np.abs(y[: len(x)].astype(int) - x)
        assert rate == audio.RATE and len(y) >= len(x) and gap.max() <= most and gap.mean() <= most / 4
    assert audio.companded(audio.mulaw(), audio.mulaw()).tolist()[1:127] == list(range(1, 127)) and len(audio.adpcm_blocks(x[:0])) == 0
    assert (audio.alaw()[audio.companded(audio.alaw(), audio.alaw())] == audio.alaw()).all()


def test_features_are_those_of_plain_sums(spark):
    few = [(1, "short"), (2, None), (3, some(4, 300) + " é中"), (4, "x" * 1153)]
    for r in rows(audio.features(audio.encode(spark.createDataFrame(few, "doc_id long, text string")))):
        data = (dict(few)[r["doc_id"]] or "").encode()
        data += b"\xff" * (-len(data) % 576 or (0 if data else 576))
        u, a, decoded = [], [], []
        for byte in data:
            code = 255 - byte
            size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33 << 2
            u.append(-size if code & 128 else size)
            code = byte ^ 0x55
            size = (code & 15) * 16 + 8 if code >> 4 & 7 == 0 else ((code & 15) * 16 + 264) << ((code >> 4 & 7) - 1)
            a.append(size if code & 128 else -size)
        for at in range(0, len(data), 576):
            block = data[at : at + 576]
            now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            decoded.append(now)
            for byte in block[4:]:
                for code in (byte & 15, byte >> 4):
                    step = int(audio.STEPS[index])
                    size = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
                    now = max(-32768, min(32767, now - size if code & 8 else now + size))
                    index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                    decoded.append(now)
        pcm = b"".join(x.to_bytes(2, "little", signed=True) for here, ahead in zip(u, [*u[1:], u[-1]]) for x in (here, (here + ahead) // 2))
        crossings = sum((p < 0) != (q < 0) for p, q in zip(u, u[1:]))
        want = f"seconds={len(data) / 8000:.3f};mulaw_power={sum(x * x for x in u) // len(u)};alaw_power={sum(x * x for x in a) // len(a)};crossings={crossings};adpcm_mean={sum(map(abs, decoded)) // len(decoded)};adpcm_peak={max(map(abs, decoded))};pcm_crc32={zlib.crc32(pcm)}"
        form = audio.store_pcm(audio.riff(audio.MULAW, data))
        assert r["feature"] == want and (r["pcm_bytes"], r["pcm_sha256"]) == (len(form), hashlib.sha256(form).hexdigest()) and form.endswith(pcm)


def test_stored_forms_are_read_back(spark):
    data = bytes(range(256)) * 9
    for kind in (audio.MULAW, audio.ALAW, audio.ADPCM, audio.PCM):
        assert audio.opened(audio.riff(kind, data))[3] == data
    media = spark.createDataFrame([(1, bytearray(audio.riff(audio.ALAW, data))), (2, None), (3, bytearray(b"no"))], "pcm_id long, media binary")
    got = {r["pcm_id"]: r["pcm"] for r in rows(audio.decoded(media))}
    pcm, rate = audio.samples(bytes(got[1]))
    assert rate == 16_000 and pcm[::2].tolist() == audio.alaw()[np.frombuffer(data, np.uint8)].tolist() and got[2] is None


def test_pieces_cover_each_document_once(odd, docs, none):
    whole = packing.tokenizer(queries.VOCABULARY, None).whole
    for df in (odd, docs):
        got = rows(packing.pack(df, queries.VOCABULARY, queries.RANKS))
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append(r)
        for runs in sequences.values():
            at = 0
            for offset, length in sorted(runs):
                assert offset == at
                at += length
            assert 0 < at <= 2048
        texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
        for doc_id, text in texts:
            if doc_id is None:
                continue
            ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
            own = pieces[doc_id]
            assert sum(r["length"] for r in own) == texts[doc_id, text] * len(ids) // 4
            for r in own:
                assert r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    total = sum(r["length"] for r in got)
    assert total >= 0.97 * 2048 * len(sequences)
    assert rows(packing.pack(none, queries.VOCABULARY)) == []


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_those_of_the_whole_encoder(seed):
    rng = np.random.default_rng(seed)
    both = packing.Tokenizer(queries.VOCABULARY, queries.RANKS)
    parts = ["a", "bc", "Value", "d'ef", "'s", "'", "42", ".", "é", "中文", " ", " ", " ", "\n", "\n", "  ", "\n\n", "\t", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\x00", *both.special[:2]]
    texts = ["".join(rng.choice(parts, rng.integers(1, 15))) for _ in range(5_000)]
    texts += ["name\tvalue\tunit\n\n\nplain text", "a\n a\t\tbc", "a b\xa0\n\nc"]
    texts += [" ".join(rng.choice(["a", "bc", "d'ef", "42.", "é\x00x", "'s"], 6)) for _ in range(200)]
    for text, want in zip(texts, both.whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(both.encode(text), "<u4").tolist() == want.ids, repr(text)


def test_differencing_balances_and_the_count_rises():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 512, 400).tolist()
    parts = packing.differencing(sizes, 50)
    assert sorted(i for _, t in parts for i in packing.leaves(t)) == list(range(400))
    assert parts[0][0] - parts[-1][0] <= 8
    windows = packing.windows_of([1500] * 10, 2048)  # two don't fit together
    assert len(windows) == 10 and packing.windows_of([], 2048) == []


def test_spans_are_those_of_the_patterns(odd, docs, none):
    for df in (odd, docs):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"] is not None}
        got = rows(secrets.digests(*secrets.ledgered(df)))
        assert len(got) == df.count()
        for r in got:
            if r["doc_id"] is None:
                continue
            found = [(m.start(), k, m.end()) for k, (p, g, least) in enumerate(secrets.BASE.values()) for m in re.finditer(p, texts[r["doc_id"]], re.A) if len(m.group(g)) >= least]
            want = ",".join(f"{list(secrets.BASE)[k]}:{s}:{e}" for s, k, e in sorted(found))
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert rows(secrets.digests(*secrets.ledgered(none))) == []


def test_the_ledger_scans_only_what_is_new(spark, odd, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = rows(secrets.digests(*secrets.ledgered(odd, ledger)))
    seen = spark.read.parquet(f"{ledger}/seen").count()
    again = rows(secrets.digests(*secrets.ledgered(odd, ledger)))
    assert spark.read.parquet(f"{ledger}/seen").count() == seen and sorted(map(str, first)) == sorted(map(str, again))
    secrets.ledgered(odd, ledger, version="2")
    assert spark.read.parquet(f"{ledger}/seen").count() == 2 * seen


def test_a_run_that_died_gives_each_row_once(spark, odd, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = rows(secrets.digests(*secrets.ledgered(odd, ledger)))
    shutil.rmtree(tmp_path / "ledger/seen")  # findings were appended, seen blobs were not
    again = rows(secrets.digests(*secrets.ledgered(odd, ledger)))
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(again) == odd.count()


def test_only_unseen_blobs_are_scanned(spark, docs, tmp_path, monkeypatch):
    ledger = f"file://{tmp_path}/ledger"
    want = sorted(map(str, rows(secrets.digests(*secrets.ledgered(docs)))))
    secrets.ledgered(docs.where("doc_id % 2 = 0"), ledger)
    scanned = []
    plain = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs, *a: (scanned.append(blobs.count()), plain(blobs, *a))[1])
    assert sorted(map(str, rows(secrets.digests(*secrets.ledgered(docs, ledger))))) == want
    texts = {bool(r["doc_id"] % 2 == 0): set() for r in docs.collect()}
    for r in docs.collect():
        if r["text"]:
            texts[r["doc_id"] % 2 == 0].add(r["text"])
    assert scanned == [len(texts[False] - texts[True])]
    monkeypatch.setattr(secrets, "SENT", 0)
    assert sorted(map(str, rows(secrets.digests(*secrets.ledgered(docs))))) == want


def test_redaction_blanks_spans_only(odd):
    got = {r["doc_id"]: r["text"] for r in rows(secrets.redact(odd, *secrets.ledgered(odd)))}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert got[11] == texts[11].replace("PASSWORD = hunter22", "[secret]") and got[14] == "[secret]" and got[9] == texts[9] and got[4] is None
    assert got[13] == "token=abc [secret]' [secret]"


def test_content_is_found_in_a_page(spark):
    body = "".join(f"<p>Paragraph {i} of <b>the</b> text &amp; more<br>here.</p>" for i in range(9))
    clutter = '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad-banner">Buy <div>now</div></div>'
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body>{clutter}<article><h1>Head&nbsp;line</h1>{body[:200]}<aside>no</aside>{body[200:]}<section id=comments><p>Reader says</p></section></article><footer>foot</footer></body></html>"
    want = " ".join(["Head line", *[f"Paragraph {i} of the text & more here." for i in range(9)]])
    bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
    table = spark.createDataFrame([(1, "u", page), (2, None, page), (3, "v", None), (4, "w", ""), (5, "w", "<p>"), (6, "x", "plain words"), (6, "x", "plain words"), (None, None, "<b>1 < 2"), (7, "y", bare)], "page_id long, url string, html string")
    got = rows(htmltext.main_text(table))
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == want and text[7] == want and text[3] == text[4] == text[5] == "" and text[6] == "plain words" and len(got) == 9
    assert all(r["n_chars"] == len(r["text"]) for r in got) and rows(htmltext.main_text(table.limit(0))) == []


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div id='header-and-content'>", "<div class=sidebar>", "<form id=search>", "<section aria-label='Search results'>"])
@pytest.mark.parametrize("region", ["article", "main", "div"])
def test_wrappers_with_marks_keep_the_content(wrapper, region):
    body = "".join(f"<p>Paragraph {i} of the long text, with more words here.</p>" for i in range(9))
    more = "<section class='related-work'><p>Others did this before.</p></section><figure><img src=x><figcaption>A caption.</figcaption></figure><object>In <b>object</b>.</object><dialog>In dialog.</dialog><p>The end of it.</p>"
    junk = "<div class='related-posts'>Read <p>too</p></div><nav>Home</nav><div class=ad>Buy <div>now</div></div><aside>no</aside>"
    name = wrapper[1:].split()[0]
    page = f"<html><body class=sidebar>{junk}{wrapper}<{region}>{body}{junk}{more}</{region}></{name}>{junk}</body></html>"
    want = " ".join([*[f"Paragraph {i} of the long text, with more words here." for i in range(9)], "Others did this before. A caption. In object. In dialog. The end of it."])
    weights = htmltext.learn([f"<body>{junk}<article>{body}</article>{junk}</body>"])
    weights.weights |= {k: -0.05 for k in ("section", "/section", "figure", "/figure", "img", "figcaption", "/figcaption", "object", "/object", "dialog", "/dialog", "b", "/b", "div", "/div")}
    assert htmltext.extract(page, weights) == want


def test_names_are_learned_from_labelled_pages():
    body = "".join(f"<p>Paragraph {i} of the long text, with more words here.</p>" for i in range(9))
    junk = "<div class='teaser-strip'><p>" + "Seen elsewhere in this place today. " * 12 + "</p></div>"
    taught = [f"<html><body>{junk}<article><div class='prose'>{body}</div></article>{junk}</body></html>"] * 30
    model = htmltext.learn(taught)
    want = " ".join(f"Paragraph {i} of the long text, with more words here." for i in range(9))
    # no article element, no name of the list, and more words in the teasers than in the content
    page = f"<html><body>{junk}<div class='prose'>{body}</div>{junk}</body></html>"
    assert htmltext.extract(page, model) == want
    # without what the names say, the run goes on through the teasers
    plain = htmltext.Model({k: w for k, w in model.weights.items() if not k.startswith(".")})
    assert "Seen elsewhere" in htmltext.extract(page, plain)
    # names never seen say nothing, and attributes that only end in these names are none
    other = page.replace("teaser-strip", "unknown").replace("prose", "also-unknown").replace("class=", "data-class=")
    assert htmltext.extract(other, model) == htmltext.extract(other, plain)


def test_words_in_partly_marked_elements_weigh_less():
    short, long = "few words of content here", "a list of more words than the content"
    page = f"<p>{short}</p><hr><p>five other words stand here</p><hr><div class='sidebar-notes'><p>{long}</p></div>"
    model = htmltext.Model({"hr": -9.0})
    assert htmltext.extract(page.replace("sidebar", "plain"), model) == long
    assert htmltext.extract(page, model) == short


def test_content_of_the_given_pages(spark):
    got = rows(queries.op7_html_extraction(spark, "/root/testdata/sf0.001"))
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        inner = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())


@pytest.mark.parametrize("seed", range(5))
def test_best_run_is_the_best_of_all_runs(seed):
    w = np.random.default_rng(seed).normal(0, 1, 40).round(2).tolist()
    begin, end = htmltext.best_run(w)
    assert abs(sum(w[begin:end]) - max([0, *(sum(w[i:j]) for i in range(40) for j in range(i, 41))])) < 1e-9


def test_planted_items_are_met(spark, docs, none):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    planted = [(900_000 + i, some(i, 300) + " " + t.encode().upper().decode().replace(" ", "  ") + " " + some(i + 1, 200)) for i, t in items.items()]
    clean = [(800_000 + i, some(i, 500)) for i in range(5)]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(planted + clean, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(table, bench))}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in r["text"]}
    assert got >= exact | {(900_000 + i, i) for i in items} and not {d for d, _ in got if 800_000 <= d < 900_000}
    assert rows(decontaminate.contaminated(none, bench)) == [] and rows(decontaminate.contaminated(docs, bench.limit(0))) == []


@pytest.mark.parametrize("n", range(1, 6))
def test_edited_copies_of_items_with_short_answers_are_met(n):
    question = "Which harbour town did the seven quiet miners leave before winter came?"
    answer = "Grelmont beside upper vashel lake".split()[:n]
    others = [(i, some(i, 20 + i).encode()) for i in range(30)]
    index = decontaminate.build([*others, (99, f"{question} {' '.join(answer)}.".encode())])

    def met(words: str) -> bool:
        return 99 in decontaminate.search(index, decontaminate.split(f"{some(50, 90)} {words} {some(51, 90)}".encode()))

    changed = [answer[:i] + ["other"] + answer[i + 1 :] for i in range(n)]
    added = [answer[:i] + ["other"] + answer[i:] for i in range(1, n)]
    lost = [answer[:i] + answer[i + 1 :] for i in range(n)]
    for words in [answer, *changed, *added, *lost, []]:
        assert met(f"{question} {' '.join(words)}"), words
    # an edit in the question too; then the answer alone, and other words
    assert met(f"{question.replace('seven', 'six')} {' '.join(changed[n // 2])}")
    assert not met(" ".join(answer)) and not met("Which town did they leave?")


def test_short_items_are_met_with_one_edit():
    others = [(i, some(i, 20 + i).encode()) for i in range(30)]
    for text in ("Who? Tarvel mined pelgrite.", "Name pelgrite finders. Tarvel Moss."):
        words = decontaminate.split(text.encode())
        index = decontaminate.build([*others, (99, text.encode())])
        for i in range(len(words)):
            copy = b" ".join([*decontaminate.split(some(50, 90).encode()), *words[:i], b"other", *words[i + 1 :], *decontaminate.split(some(51, 90).encode())])
            assert 99 in decontaminate.search(index, decontaminate.split(copy)), copy


@pytest.mark.parametrize("part_bytes, group", [(2_000, 2), (400, 3)])
def test_parts_of_the_index_give_the_hits_of_one(spark, docs, monkeypatch, part_bytes, group):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    kept = sorted(r["doc_id"] for r in rows(decontaminate.clean(docs, bench)))
    monkeypatch.setattr(decontaminate, "PART_BYTES", max(part_bytes, sum(len(r["text"] or "") for r in bench.collect()) // 5))
    monkeypatch.setattr(decontaminate, "GROUP", group)
    many = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert one and [m[:2] for m in many] == [o[:2] for o in one] and np.allclose([m[2:] for m in many], [o[2:] for o in one])
    assert sorted(r["doc_id"] for r in rows(decontaminate.clean(docs, bench))) == kept


def test_block_pruning_loses_no_passage(spark):
    items = [(i, some(i, 20 + i).encode()) for i in range(40)]
    index = decontaminate.build(items)
    text = decontaminate.split(" ".join(some(i % 45, 20 + i % 45) for i in range(0, 90, 7)).encode())
    best: dict = {}
    stride = index.longest
    for p in range(-(-len(text) // stride)):
        run = {index.vocabulary.get(w) for w in text[p * stride : (p + 2) * stride]} - {None}
        for n in range(len(items)):
            score = sum(float(index.impact[j]) for t in run for j in range(index.starts[t], index.starts[t + 1]) if index.item[j] == n)
            ids = [index.vocabulary.get(w, -1) for w in text[p * stride : (p + 2) * stride]]
            q, a = (decontaminate.overlap(g, decontaminate.trigrams(ids), frozenset(run)) for g in index.grams(n)[:2])
            if score >= decontaminate.THRESHOLD and q >= decontaminate.QUESTION and a >= decontaminate.ANSWER:
                best[index.items[n]] = max(best.get(index.items[n], 0), score)
    got = decontaminate.search(index, text)
    assert got.keys() == best.keys() and all(abs(got[i][0] - best[i]) < 1e-9 for i in best) and best


def test_quality_on_labels_that_were_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in rows(quality.judge(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 0)))}
    assert len(got) == docs.count()
    told = [r for r in labels.collect() if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0]
    assert sum((got[r["doc_id"]]["posterior"] >= 0.5) == bool(r["quality"]) for r in told) >= 0.93 * len(told) and len(told) > 20
    clean = [got[r["doc_id"]] for r in told if r["quality"] and not r["toxic"]]
    assert sum(r["keep"] for r in clean) >= 0.93 * len(clean)


def test_sites_shrink_toward_their_priors(spark):
    groups = spark.createDataFrame([("a", 1000, 900.0, 850.0), ("b", 1000, 500.0, 300.0), ("c", 1, 0.0, 0.0)], "g string, n long, s double, s2 double").withColumn("prior", F.lit(0.7))
    k = quality.strength(groups, "prior")
    got = {r["g"]: r["m"] for r in groups.select("g", quality.mean(F.col("s"), F.col("n"), k, F.col("prior")).alias("m")).collect()}
    assert abs(got["a"] - 0.9) < 0.02 and abs(got["b"] - 0.5) < 0.02 and got["c"] > 0.2


def test_posteriors_are_those_of_plain_sums(spark):
    rng = np.random.default_rng(5)
    host = [None if i % 7 == 0 else f"h{i % 5}" for i in range(300)]
    path = [None if i % 11 == 0 else f"p{i % 3}" for i in range(300)]
    p = [float(np.clip(rng.normal(0.3 + 0.1 * (i % 5), 0.2), 0, 1)) for i in range(300)]
    found = spark.createDataFrame([(i, host[i], path[i], p[i], 0.0, i % 9 == 0) for i in range(300)], "doc_id long, host string, path string, p double, toxicity double, toxic boolean")
    got = {r["doc_id"]: r for r in rows(quality.posteriors(found, quality.Workspace(spark, "t")))}

    def pseudo(groups, priors):
        n = sum(map(len, groups.values()))
        every = [x for g in groups.values() for x in g]
        within = max(sum(x * x for x in every) / n - (sum(every) / n) ** 2, 1e-6)
        spread = sum(len(g) * (sum(g) / len(g) - priors[name]) ** 2 for name, g in groups.items())
        return min(within / max((spread - len(groups) * within) / n, 1e-6), 1e6)

    top = sum(p) / len(p)
    hosts, sites = defaultdict(list), defaultdict(list)
    for i in range(300):
        hosts[host[i]].append(p[i])
        sites[host[i], path[i]].append(p[i])
    hk = pseudo(hosts, dict.fromkeys(hosts, top))
    pk = pseudo(sites, {site: (sum(hosts[site[0]]) + hk * top) / (len(hosts[site[0]]) + hk) for site in sites})
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for i in range(300):
        h, s = hosts[host[i]], sites[host[i], path[i]]
        host_mean = (sum(h) - p[i] + hk * top) / (len(h) - 1 + hk)
        path_mean = (sum(s) - p[i] + pk * host_mean) / (len(s) - 1 + pk)
        want = 1 / (1 + math.exp(-(logit(p[i]) + logit(path_mean) - logit(top))))
        r = got[i]
        assert abs(r["host_mean"] - host_mean) < 1e-9 and abs(r["path_mean"] - path_mean) < 1e-9 and abs(r["posterior"] - want) < 1e-9
        assert r["keep"] == (want >= 0.5 and i % 9 != 0)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 1), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert len(rows(quality.judge(odd, labels))) == odd.count()
    assert rows(quality.judge(none, labels)) == [] and len(rows(quality.judge(odd, labels.limit(0)))) == odd.count()


def test_shards_hold_the_law(odd, docs, none):
    for df in (odd, docs):
        got = rows(hilbert.shard(df))
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            if r["doc_id"] is not None:
                t = (texts[r["doc_id"]] or "").encode()
                assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        counts = [len(slots[s]) for s in range(8)]
        assert sum(counts) == df.count() and max(counts) - min(counts) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    assert rows(hilbert.shard(none)) == []


def test_shards_are_those_of_the_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op10_sharding"]).fetchdf()
    got = queries.op10_sharding(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    key = ["doc_id", "size", "text_crc32", "shard", "slot", "curve"]
    assert sorted(map(tuple, want[key].to_numpy().tolist())) == sorted(map(tuple, got[key].to_numpy().tolist()))


def test_the_curve_visits_neighbours(spark):
    cells = spark.range(512).select((F.col("id") % 8).cast("int").alias("x"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"), F.floor(F.col("id") / 64).cast("int").alias("z"))
    got = sorted((r["_curve"], r["x"], r["y"], r["z"]) for r in hilbert.with_index(cells, [F.col("x"), F.col("y"), F.col("z")], 3).collect())
    assert [g[0] for g in got] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(got, got[1:]))
