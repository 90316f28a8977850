"""Lexical search, near-duplicate embeddings and spelling variants against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from weftgraph.llm import embedding_dups, lexical, spelling

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- lexical search
def ranked(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [Counter(term.findall((t or "").translate(LOWER))) for _, t in docs]
    n, length = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 100 - 90 + 90 * c.total() * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(term.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank + 1, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as n", "2 as score", "3 as terms")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as item", "1 as rank")
    return sorted((tuple(r) for r in lexical.search(a, b, **more).collect()), key=str)


def test_search_against_the_formula(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pool = [f"w{int(i)}" for i in rng.zipf(1.3, 4000) % 300] + ["Äb", "äb", "x_y", "ÀÉ", "naïve", "日本", "it's", "A1b2"]
    text = lambda n: "".join(str(rng.choice(pool)) + str(rng.choice([" ", "\n", ", ", "-", " ", "\t"])) for _ in range(n))
    docs = [(int(i), text(int(rng.integers(0, 60)))) for i in rng.permutation(400)]
    docs += [(7, docs[7][1])] * 30 + [(500 + i, docs[9][1]) for i in range(40)] + [(None, docs[9][1]), (None, None), (901, None), (902, ""), (903, " ,.-"), (904, "w1 " * 5000), (-3, docs[9][1])]
    items = [(i, text(12)) for i in range(12)] + [(3, docs[9][1]), (3, docs[9][1]), (None, "w1"), (20, None), (21, ""), (22, "zzz nowhere"), (23, "W2 w2 w2 äB ÄB"), (24, text(400))]
    want = ranked(docs, items)
    assert searched(spark, docs, items) == want
    for name, value in (("WINDOW", 128), ("HELD", 500), ("PAIRS", 40)):
        monkeypatch.setattr(lexical, name, value)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, k=1) == ranked(docs, items, 1)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")]) == []


def test_only_touched_groups_are_harvested():
    search = lexical._Search([(0, [0]), (1, [1]), (2, [0, 1])], np.array([5, 7]), 4, 4, 2)
    sizes = np.ones(200, np.int64)
    search.window(list(range(200)), np.arange(200), sizes, np.array([1, 0, 0], np.uint32), np.array([150, 3, 70]), np.array([1, 1, 2], np.uint32))
    assert {i: sorted(d for *_, d in h) for i, h in search.heaps.items()} == {0: [3, 70], 1: [150], 2: [70, 150]}
    assert not search.scores.any() and not search.touched.any()


# ---- near-duplicate embeddings
def linked(rows, least=0.98):
    ok = lambda v, lab: lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    use = [i for i, (_, v, lab) in enumerate(rows) if ok(v, lab)]
    for k, i in enumerate(use):
        a = np.array(rows[i][1], np.float64)
        for j in use[:k]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                b = np.array(rows[j][1], np.float64)
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    name = {}
    for i, (vec_id, *_) in enumerate(rows):
        old = name.get(find(i))
        name[find(i)] = old if vec_id is None or (old is not None and old < vec_id) else vec_id
    return sorted(((i, n[k], name[find(k)], i == name[find(k)]) for k, (i, *_) in enumerate(rows)), key=str)


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as row", "1 as key", "2 as v", "3 as h1")
    return sorted((tuple(r) for r in embedding_dups.near_duplicates(df).collect()), key=str)


def test_links_and_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    near = lambda c, spread, n: (c + spread * rng.normal(size=(n, len(c)))).astype(np.float32).tolist()
    vs = [(v, 1) for c in centres[:6] for v in near(c, 0.1, 8)] + [(v, 2) for v in near(centres[0], 0.12, 150)] + [(v, int(rng.integers(1, 4))) for v in rng.normal(size=(200, 24)).astype(np.float32).tolist()]
    vs += [(vs[0][0], 1)] * 40 + [(vs[0][0], 2), (vs[0][0], None), ([3 * x for x in vs[1][0]], 1), ([-x for x in vs[1][0]], 1)]
    vs += [(None, 1), ([], 1), ([0.0] * 24, 1), ([0.0] * 24, 1), ([None] * 24, 1), ([float("nan")] * 24, 1), ([float("inf")] * 24, 1), ([1.0], 1), ([2.0], 1), ([-1.0], 1), ([1.0, 0.0, 0.0], 4), ([1.0, 0.01, 0.0], 4)]
    order = rng.permutation(len(vs))
    rows = [(int(i), v, lab) for i, (v, lab) in zip(order, vs, strict=True)]
    rows += [(rows[60][0], rows[60][1], rows[60][2]), (None, rows[61][1], rows[61][2]), (None, None, None), (None, [9.0, 1.0], 7), (None, [9.0, 1.0], 7)]
    want = linked(rows)
    assert sum(n for _, n, *_ in want) > 3000
    assert grouped(spark, rows) == want
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    monkeypatch.setattr(embedding_dups, "PAIRS", 50)
    assert grouped(spark, rows) == want
    monkeypatch.setattr(embedding_dups, "FEW", 1)
    assert grouped(spark, rows) == want
    assert grouped(spark, []) == []


def test_tables_bring_recall():
    """Pairs at the threshold meet as often as the number of tables promises, at any number of hashes."""
    rng = np.random.default_rng(1)
    for dim, k in ((64, 1), (64, 2), (48, 3)):
        tables = embedding_dups.tables_for(dim, k, 0.98)
        x, g = rng.normal(size=(2, 3000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g -= (g * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
        a, b = (embedding_dups.codes(v, np.ones(3000, np.int64), k, tables) for v in (x, y))
        met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
        assert met.mean() > 0.99
    h = embedding_dups.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


# ---- spelling variants
def variants(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    known = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    rests, near = defaultdict(list), defaultdict(set)
    for w in known:
        for i in range(len(w)):
            rests[i, w[:i] + w[i + 1 :]].append(w)
    for (_, rest), group in rests.items():
        for u in group:
            near[u].update(v for v in group if v != u)
            if rest in known:
                near[u].add(rest)
                near[rest].add(u)
    best = {w: min(near[w], key=lambda v: (-known[v], v)) for w in known if near[w]}
    form = {w: best[w] for w in best if known[best[w]] >= 5 * known[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), known.get(form.get(w))) for w, n in known.items()), key=str)


def spelled(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as key", "3 as form")
    return sorted((tuple(r) for r in spelling.variants(df).collect()), key=str)


def test_spelling_against_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(9)
    stems = ["".join(rng.choice(list("abcdeé÷Àz"), int(rng.integers(6, 9)))) for _ in range(12)] + ["banana", "bananas", "bbanana", "aaaaaa", "aaaaaaa", "aaaaaaaa", "listen", "silent", "silenx", "ÀÀÀÀÀÀ", "àÀÀÀÀÀ"]
    words = []
    for s in stems:
        for c in range(14):
            i, kind = int(rng.integers(len(s))), c % 4
            w = s if c == 0 else s[:i] + s[i + 1 :] if kind == 1 else s[:i] + "abxé"[int(rng.integers(4))] + s[i + (kind == 2) :]
            words += [w.upper() if c == 5 else w] * int(rng.integers(5, 12) if c else rng.choice([6, 60, 400]))
    words += ["gecko's", "geckos"] * 6 + ["geckosx"] * 40 + ["geckosxy"] * 300  # a chain of forms
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::150]) + ", x-y 9banana_") for i in range(150)] + [(3, "banana " * 6)] * 3 + [(None, "listenĀsilent " * 9), (None, None), (200, ""), (201, "a" * 300_000 + " " + "ab" * 150_000)]
    docs += [(300 + i, "q" * 3000 + " " + "q" * 1500 + "r" + "q" * 1499 + " " + "q" * 2999) for i in range(7)]
    want = variants(docs)
    assert sum(w[1] is not None for w in want) > 10 and any(w[1] and w[1] != w[2] for w in want)
    for bucket in (12, 1, 10**6):
        monkeypatch.setattr(spelling, "BUCKET", bucket)
        monkeypatch.setattr(spelling, "HELD", 4096)
        assert spelled(spark, docs) == want
    assert spelled(spark, []) == []


def test_a_letter_goes_where_the_hash_says():
    seen = 0
    for i in range(3000):
        seed = zlib.crc32(f"{i}:".encode())
        h = zlib.crc32(f"{i}:geändert".encode())
        at = h % 8
        assert spelling.altered("geändert", seed) == ("geändert" if h % 199 else "geändert"[:at] + "geändert"[at + 1 :])
        seen += h % 199 == 0
    assert seen > 3


# ---- the registered queries
@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_embedding_dups"])
def test_registered_against_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        want = db.sql(__spark_entry__.oracle_sql()[name])
        names = sorted(want.columns)
        assert sorted(got.columns) == names
        assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.select(*names).fetchall()))


def test_op12_sql_states_the_links(spark):
    """The SQL on vectors that do link, and the query on the same file."""
    rng = np.random.default_rng(3)
    c = rng.normal(size=(4, 16))
    rows = [(i, (c[i % 4] + 0.06 * rng.normal(size=16)).astype(np.float32).tolist(), i % 3) for i in range(90)] + [(90, None, 0), (91, [0.0] * 16, 1), (92, [1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    embeddings = df.toArrow()  # noqa: F841  read by the SQL
    want = duckdb.sql(__spark_entry__.oracle_sql()["op12_embedding_dups"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in embedding_dups.near_duplicates(df).collect()) and sum(r[1] for r in want) > 100


def test_op13_registered(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = __spark_entry__.queries()["op13_spelling"](spark, DATA)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == variants(docs)
