import random

import xxhash

from weftgraph.llm import simhash
from weftgraph.operators.closure import components


def fp_plain(text, n=3):
    words = text.encode().lower().split() if text else []
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(fps):
    """Smallest index reachable over links of at most two bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_texts_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 2, 3, 50, 300]))) for _ in range(40)]
    texts = base + base[:10] + [t + " End" for t in base[20:]] + [None, "", " \t\n", "ONE", "one", "Nur\xa0eins"] + ["w" * 50000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [fp_plain(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == classes(fps)


def test_crowded_fingerprints_lose_no_link(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:  # a large group of near copies, most beyond what a key pairs up
        x = rng.choice(list(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(300)} | {0, 3, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = [(r["u"], r["v"]) for r in links.collect()]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 2 for a, b in pairs)
    assert len(pairs) < 30 * len(fps)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = classes(fps)
    mine = [roots.get(f, f) for f in signed]
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(want)) == len(set(mine))


def test_edges(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (5, None)], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 7), (0, 7), (5, 5), (7, 7), (7, 7)]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1200)} == {1000}
