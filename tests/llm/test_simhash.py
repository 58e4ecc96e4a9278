import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import odd
from vellum.llm import near_copies, simhash
from vellum.llm.components import connected_components, joined


def brute_fingerprint(text, k=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(keys, linked):
    root = {k: k for k in keys}
    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = root[a], root[b]
                if x != y:
                    for k in keys:
                        if root[k] == max(x, y):
                            root[k] = min(x, y)
    return root


def test_components_against_brute_force(spark):
    docs = odd.frame(spark)
    got = simhash.simhash_components(docs).collect()
    data = odd.rows()
    assert len(got) == len(data)
    fps = {(d[0], d[1]): brute_fingerprint(d[1]) for d in data}
    root = brute_roots(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((d[0] is None, d[0] or 0, f"{fps[d[0], d[1]]:016x}", least.get(root[fps[d[0], d[1]]])) for d in data), key=repr)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
    assert simhash.simhash_components(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("slabs", [5, 6, 7, 8])
def test_no_link_is_lost_at_any_number_of_slabs(spark, slabs):
    r = random.Random(slabs)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(r.randint(1, 5)):
                f ^= 1 << r.randrange(64)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r["fp"] % (1 << 64): r["root"] for r in simhash.fingerprint_components(frame, 4, slabs).collect()}
    want = brute_roots(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert set(got) == fps
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_embedding_bounds_the_distance(spark):
    r = random.Random(3)
    pairs = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(300)] + [(0, (1 << 64) - 1)]
    pairs += [(a, a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for a, _ in pairs]
    s = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(s(a), s(b)) for a, b in pairs], "a long, b long")
    a, b = F.col("a"), F.col("b")
    for x in d.select("a", simhash.embedding(a).alias("e"), simhash.manhattan(a, b, 7).alias("m"), simhash.hamming(a, b).alias("h")).collect():
        e, v = x["e"] % (1 << 64), x["a"] % (1 << 64)
        assert all((e >> 2 * i & 3) == (v >> 2 * i & 3).bit_count() for i in range(32))
        assert x["m"] <= x["h"]


def test_components_both_ways(spark):
    r = random.Random(9)
    edges = [(7000, 8000 + i) for i in range(3000)] + [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(120)] + [(5, 5), (None, 7)]
    d = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(x) for x in connected_components(d).collect()}
    assert one == {tuple(x) for x in connected_components(d, one_task=0).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes, least = joined(np.array([a for a, _ in real]), np.array([b for _, b in real]))
    assert one == set(zip(nodes.tolist(), least.tolist()))
    assert connected_components(d.where("a is null")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_go_and_clean_documents_stay(spark):
    r = random.Random(4)
    data, group = [], {}
    for g in range(40):
        w = odd.words(r, r.choice([60, 200, 800])).split()
        for c in range(r.choice([1, 1, 3, 6])):
            x = list(w)
            for _ in range(0 if c == 1 else max(1, len(x) // 250)):
                x[r.randrange(len(x))] = odd.words(r, 1)
            group[len(data)] = g
            data.append((len(data), " ".join(x), "en", "src0", 1))
    order = list(data)
    r.shuffle(order)
    kept = near_copies.without_near_copies(odd.frame(spark, order))
    assert kept.columns == odd.frame(spark, order).columns
    first = {}
    for i, g in group.items():
        first[g] = min(first.get(g, i), i)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(first.values())


def test_near_copies_of_odd_documents(spark):
    kept = [(x["doc_id"], x["text"]) for x in near_copies.without_near_copies(odd.frame(spark)).collect()]
    assert len(kept) == len(set(kept))
    blank = [i for i, t in kept if not (t or "").split()]
    assert blank == [0]  # null, empty and blank are one group
    texts = [t for _, t in kept]
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            x, y = shingles(a), shingles(b)
            assert not (x or y) or len(x & y) / len(x | y) < 0.8
    assert near_copies.without_near_copies(odd.empty(spark)).count() == 0


def test_sketches():
    r = random.Random(2)
    w = odd.words(r, 200).split()
    v = w[:150] + odd.words(r, 50).split()
    a, b = " ".join(w), " ".join(v)
    x, y = shingles(a), shingles(b)
    p, q = (near_copies.profile(t.encode())[2] for t in (a, b))
    assert near_copies.jaccard(p, q) == len(x & y) / len(x | y)
    long = odd.words(r, 5000).split()
    other = long[:4600] + odd.words(r, 400).split()
    p, q = (near_copies.profile(" ".join(t).encode())[2] for t in (long, other))
    x, y = shingles(" ".join(long)), shingles(" ".join(other))
    assert abs(near_copies.jaccard(p, q) - len(x & y) / len(x | y)) < 0.1
    assert near_copies.jaccard(b"", b"") == 1.0


def test_long_texts_are_verified_on_all_shingles():
    r = random.Random(6)
    for n in (300, 900, 3000):
        w = odd.words(r, n).split()
        for m in (0.86, 0.89, 0.92):
            v = w[: int(n * m)] + odd.words(r, n - int(n * m)).split()
            x, y = shingles(" ".join(w)), shingles(" ".join(v))
            p, q = (near_copies.profile(" ".join(t).encode())[2] for t in (w, v))
            assert near_copies.jaccard(p, q) == len(x & y) / len(x | y)


def test_parity_bits_refuse_no_near_copy():
    r = random.Random(8)
    for n in (12, 60, 300, 900):
        for _ in range(60):
            w = odd.words(r, n).split()
            v = list(w) + odd.words(r, r.choice([0, n // 8])).split()
            for _ in range(r.randint(0, max(1, n // 40))):
                v[r.randrange(n)] = odd.words(r, 1)
            (_, a, p, x, u), (_, b, q, y, t) = (near_copies.profile(" ".join(t).encode()) for t in (w, v))
            both = len(set(near_copies.unpacked(p).tolist()) & set(near_copies.unpacked(q).tolist()))
            assert sum(((i ^ j) % (1 << 64)).bit_count() for i, j in zip(x, y)) <= a + b - 2 * both
            assert near_copies.may_be_alike(u, t, a, b, both / (a + b - both))
            far = near_copies.profile(odd.words(r, n).encode())
            assert n < 60 or not near_copies.may_be_alike(u, far[4], a, far[1], 0.8)


def changed(r, w, low, high):
    """A copy of the words whose likeness lies between low and high."""
    whole = shingles(" ".join(w))
    while True:
        v = list(w)
        for _ in range(max(1, round(len(w) * r.uniform(0.015, 0.035)))):
            v[r.randrange(len(v))] = odd.words(r, 1)
        own = shingles(" ".join(v))
        if low <= len(own & whole) / len(own | whole) < high:
            return v


def test_recall_and_precision_around_the_limit(spark):
    r = random.Random(21)
    data, near = [], set()
    for g in range(80):
        w = odd.words(r, [300, 1500][g % 2]).split()
        low, high = [(0.80, 0.82), (0.82, 0.85), (0.77, 0.80), (0.80, 0.85)][g // 2 % 4]
        data += [(2 * g, " ".join(w), "en", "src0", 1), (2 * g + 1, " ".join(changed(r, w, low, high)), "en", "src0", 1)]
        if low >= 0.80:
            near.add(2 * g + 1)
    kept = {x["doc_id"] for x in near_copies.without_near_copies(odd.frame(spark, data)).collect()}
    assert kept == {d[0] for d in data} - near


def test_large_group_of_near_copies_and_a_passage_that_many_share(spark):
    r = random.Random(5)
    base, passage = odd.words(r, 90).split(), odd.words(r, 60)
    texts = []
    for _ in range(250):  # a group in which not each is alike each
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = odd.words(r, 1)
        texts.append(" ".join(w))
    texts += [passage + " " + odd.words(r, r.choice([5, 9, 14, 20, 60])) for _ in range(120)]
    texts += [odd.words(r, 80) for _ in range(60)]
    order = list(range(len(texts)))
    r.shuffle(order)
    data = [(i, texts[k], "en", "src0", 1) for i, k in enumerate(order)]
    sets = {i: shingles(t) for i, t, *_ in data}
    root = brute_roots(set(sets), lambda a, b: 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {x["doc_id"] for x in near_copies.without_near_copies(odd.frame(spark, data)).collect()}
    assert kept == set(root.values()) and len(kept) < 250


def test_hot_cells_go_to_finer_grids(spark):
    r = random.Random(14)
    centre, fps = r.getrandbits(64), set()
    while len(fps) < 700:  # many distinct fingerprints within a few bits of one
        f = centre
        for _ in range(r.randint(1, 6)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(50)}
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_roots(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    for most in (20, 100, 10**6):
        got = {r["fp"] % (1 << 64): r["root"] for r in simhash.fingerprint_components(frame, 4, most=most).collect()}
        assert groups(got) == groups(want)


def test_slabs_are_the_same_up_to_the_sizes_measured_for():
    assert {simhash.slabs_for(n, 4) for n in (0, 100, 50_000, 250_000, 15_000_000)} == {7}
    assert simhash.slabs_for(10**9, 4) > 7


def test_copies_with_blocks_added_cut_and_replaced_go(spark):
    r = random.Random(12)
    data, like = [], lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    for g in range(120):
        n = r.choice([60, 300, 900])
        w, k = odd.words(r, n).split(), int(n * r.uniform(0.04, 0.19))
        at = r.randrange(n - k)
        v = [w + odd.words(r, k).split(), w[: n - k], w[:at] + odd.words(r, k // 2).split() + w[at + k // 2 :]][g % 3]
        data += [(2 * g, " ".join(w), "en", "src0", 1), (2 * g + 1, " ".join(v), "en", "src0", 1)]
    far = [data[i][0] for i in range(1, len(data), 2) if like(data[i - 1][1], data[i][1]) < 0.8]
    assert len(far) < 60
    kept = near_copies.without_near_copies(odd.frame(spark, data))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted([*range(0, len(data), 2), *far])


def test_cells_are_no_broadcast_table(spark, monkeypatch):
    plans = []

    def noted(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return connected_components(edges)

    monkeypatch.setattr(simhash, "connected_components", noted)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id long, text string")
    out = simhash.simhash_components(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)
    assert out.count() == 2
