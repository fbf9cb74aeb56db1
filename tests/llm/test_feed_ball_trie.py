"""The leaderboard feed, ball hashing and the prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
import xxhash

from corvane.llm import leaderboard, prefixtrie, simhash

# ---- SimHash


def plain_print(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < n else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_groups(values):
    """Position -> smallest position reachable over pairs of at most three differing bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def odd_texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "ß", "A b"]
    base = [" ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 40, 200]))) for _ in range(60)]
    near = []
    for t in base[:40]:
        w = t.split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = r.choice(vocabulary)
            near.append(" ".join(w))
    long_ = " ".join(r.choices(vocabulary, k=80_000))
    return [*base, *near, *base[:10], None, "", " \t\n", "One", "ONE", long_, long_ + " end"]


def test_prints_are_those_of_plain_counting(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, least int")
    for n in (1, 3, 5):
        want = [plain_print(t, n) for t in texts]
        got = {r["doc_id"]: r for r in simhash.group(rows, n).collect()}
        assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{w:016x}" for w in want]
        assert [got[i]["component_id"] for i in range(len(texts))] == plain_groups(want)
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_balls_link_what_three_bits_link(spark):
    """Clusters around centres, chains, the zero print and its neighbours, all distances from one to six."""
    r = random.Random(5)
    values = {0, 1, 3, 7, 15, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    for _ in range(12):
        centre = r.getrandbits(64)
        values.add(centre)
        for _ in range(25):
            v = centre
            for b in r.sample(range(64), r.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
            if r.random() < 0.2:
                centre = v  # a chain
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    near = simhash.sieved(prints)
    with_link = {signed[i] for i in range(len(values)) for j in range(len(values)) if i != j and (values[i] ^ values[j]).bit_count() <= 3}
    assert with_link <= {r["fp"] for r in near.collect()}
    found = {(r["a"], r["b"]) for r in simhash.links(near).collect()}
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in found)
    place = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == plain_groups(values)


def test_a_large_cluster_gives_few_links(spark):
    """Two thousand prints within two bits of one: links grow with the variants, not with the pairs."""
    flips = [1 << i | 1 << j for i in range(64) for j in range(i)][:2000]
    signed = [v - (1 << 64) if v >> 63 else v for v in flips]
    found = simhash.links(spark.createDataFrame([(v,) for v in [0, *signed]], "fp long"))
    assert found.count() < 60 * len(flips)  # two million pairs


def test_ids_null_repeated_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "p q r s t u"), (9, None), (5, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in simhash.group(rows, 3).collect()), key=str)
    assert got == sorted([(None, 2, False), (4, 2, False), (2, 2, True), (2, 2, True), (None, None, False), (9, 5, False), (5, 5, True)], key=str)
    assert simhash.group(rows.where("false"), 3).count() == 0


# ---- prefix trie


def plain_trie(paths):
    """{sequence: (conv_id, depth, parent, n, children, leaves, saved, ends)} from {conv: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    out = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out[node] = (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, digest)
    return out


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_rows(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=str)


def conversations(seed, convs, pool):
    r = random.Random(seed)
    texts = [None, "", "yes", "No thanks", "a b  c", "x" * 3000, "é ü w"]
    rows = []
    for c in r.sample(range(4 * convs), convs):
        for t in range(r.choice([1, 1, 2, 3, 4, 9])):
            rows.append((c, r.choice([t, t, t, None]) if r.random() < 0.2 else t, r.choice(["user", "assistant", None]), r.choice(texts[:pool])))
    return [*rows, *rows[:5], (None, 0, "user", "lost")]


@pytest.mark.parametrize("seed,convs,pool", [(1, 40, 2), (2, 120, 3), (3, 200, 7), (4, 1, 3)])
def test_nodes_are_those_of_plain_prefixes(spark, seed, convs, pool):
    rows = conversations(seed, convs, pool)
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, path string, name int")
    nodes = prefixtrie.build(prefixtrie.rebuilt(table))
    assert as_rows(nodes) == sorted(plain_trie(plain_rebuilt(rows)).values(), key=str)
    assert nodes.select("node").distinct().count() == nodes.count()


def test_nested_deep_and_equal_conversations(spark):
    """Each conversation a prefix of the next; one of 1200 turns; a hundred equal ones; ids of many digits."""
    line = [("user", f"t {i % 3}") for i in range(1200)]
    paths = {c: line[: 3 * c] for c in range(1, 30)} | {1000 + c: line[:7] for c in range(100)} | {10**15 + 7: line}
    rows = [(c, i, r, t) for c, p in paths.items() for i, (r, t) in enumerate(p)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[d].append(c)
    got = {r["depth"]: r for r in prefixtrie.build(prefixtrie.plain(table)).collect()}
    assert len(got) == 1201 and all(got[d]["n_convs"] == len(members[d]) and got[d]["conv_id"] == min(members[d]) and got[d]["n_leaves"] == 1 for d in got)
    assert [got[d]["saved_tokens"] for d in (0, 1, 7, 1200)] == [sum((len(members[d]) - 1) * 2 for d in range(max(1, b), 1201)) for b in (0, 1, 7, 1200)]
    assert got[7]["ends_sha256"] == hashlib.sha256(",".join(str(1000 + c) for c in range(100)).encode()).hexdigest()


def test_turnless_and_no_conversations(spark):
    """Ids whose own turns are all replaced by an absent opening."""
    ids = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:4]
    rows = [(c, 0, "user", "only") for c in ids]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert as_rows(prefixtrie.build(prefixtrie.rebuilt(table))) == [(ids[0], 0, None, 4, 0, 1, 0, digest)]
    assert prefixtrie.build(prefixtrie.rebuilt(table.where("false"))).count() == 0


# ---- leaderboard


def plain_feed(lines, vendors, items):
    nation, price = {}, {}
    for v, n in vendors:
        if n is not None:
            nation[v] = min(n, nation.get(v, n))
    for i, p in items:
        if i is not None:
            old = price.get(i)
            price[i] = p if old is None else old if p is None else min(p, old)
    cut = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, flag, shipped in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = 19723 + h % 150 if shipped is None else (shipped - datetime(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        if amount is not None:
            cents = float(int((100 * amount + 0.5) // 1))
        else:
            cents = 0.0 if quantity is None or price.get(item) is None else quantity * ((100 * price[item] + 0.5) // 1)
        cut[min(10, 1 + (a - 19723) * 10 // 180)].append((s, a, nation.get(vendor), item if item in price else None, -cents if flag == "swapped" else cents))
    revenue, board, largest, out = defaultdict(lambda: defaultdict(float)), defaultdict(list), None, []
    for batch in sorted(cut):
        for day in sorted({x[1] for x in cut[batch]}):
            touched = set()
            for s, a, n, i, cents in cut[batch]:
                if a == day and n is not None and i is not None and not (largest is not None and s + 3 < largest):
                    revenue[n][i] += cents
                    touched.add(n)
            for n in touched:
                best = [i for _, i in sorted((-r, i) for i, r in revenue[n].items() if r > 0)[:10]]
                for i in {*best, *board[n]}:
                    old = board[n].index(i) + 1 if i in board[n] else None
                    new = best.index(i) + 1 if i in best else None
                    if old != new:
                        out.append((n, day, i, batch, "enter" if old is None else "exit" if new is None else "move", old, new, int(revenue[n][i])))
                board[n] = best
        largest = max([largest or -(10**9), *(x[0] for x in cut[batch])])
    return sorted(out, key=str)


def shop(seed, n, n_items):
    r = random.Random(seed)
    vendors = [(v, r.choice([1, 1, 1, 2, 3, None])) for v in range(12)] + [(3, 2)]
    items = [(i, r.choice([None, 1.25, 10.0, 99.99])) for i in range(n_items)] + [(5, 7.0)]
    lines = []
    for k in range(n):
        shipped = None if r.random() < 0.05 else datetime(2024, 1, 1) + timedelta(days=int(150 * (k / n)) + r.randint(-9, 0) * (r.random() < 0.2)) if k > n // 10 else datetime(2024, 1, 1)
        amount = r.choice([None, 10.0, 10.0, round(r.uniform(-5, 200), 2), 0.005])
        lines.append((r.choice([k, None]), r.choice([1, 2, None]), r.choice([r.randrange(n_items + 2), 7, None]), r.choice([r.randrange(14), 4]), r.choice([None, 2, 9]), amount, r.choice(["kept", "swapped", None]), shipped))
    return lines + lines[:20], vendors, items


@pytest.mark.parametrize("seed,buckets", [(1, 1), (2, 5)])
def test_feed_is_that_of_plain_sums(spark, seed, buckets):
    lines, vendors, items = shop(seed, 700, 40)
    sale_lines = spark.createDataFrame([(*x, 0.1, "clash") for x in lines], "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, nation double, day string")
    rows = leaderboard.lines(sale_lines, spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double"))
    got = leaderboard.feed(rows, buckets)
    assert got.dtypes == [("nation_id", "int"), ("arrival_day", "bigint"), ("item_id", "bigint"), ("batch", "int"), ("change", "string"), ("old_rank", "int"), ("new_rank", "int"), ("revenue", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_feed(lines, vendors, items)


def test_feed_of_no_lines(spark):
    none = spark.createDataFrame([], "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz")
    rows = leaderboard.lines(none, spark.createDataFrame([], "vendor_id long, nation_id int"), spark.createDataFrame([], "item_id long, price double"))
    assert leaderboard.feed(rows).count() == 0


def test_board_skips_stale_entries_and_keeps_its_state():
    r = random.Random(9)
    board, plain = leaderboard.Board({}, []), {}
    for _ in range(400):
        item = r.randrange(60)
        plain[item] = r.choice([plain.get(item, 0.0) + r.randint(-30, 40), -1.0, 5.0])
        board.put(item, plain[item])
        assert board.best() == [i for _, i in sorted((-v, i) for i, v in plain.items() if v > 0)[:10]]
    revenue, ranked = leaderboard.unpacked(leaderboard.packed(board.revenue, board.best()))
    assert revenue == plain and ranked == board.best()
    assert leaderboard.unpacked(leaderboard.packed({}, [])) == ({}, [])
