"""The registered queries over the smallest tables, and the pipeline on a small fixture, against plain versions."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_corpus import targets
from test_line_dedup import plain
from test_simhash_text import classes
from weftgraph.llm import language_id, url_filter
from weftgraph.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def ask(spark, name):
    return __spark_entry__.queries()[name](spark, DATA).collect()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, docs):
    words = {d["doc_id"]: [*(d["text"] or "").encode().lower().split(), None] for d in docs}
    counts = Counter(w for i, ws in words.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = ask(spark, "op1_lm_scoring")
    assert sorted(r["doc_id"] for r in rows) == sorted(words)
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"], 7) == 2, len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def test_op2(spark, docs):
    prints = {}
    for d in docs:
        ws = (d["text"] or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in ask(spark, "op2_simhash")} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_op4(spark):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows if r["embedding"]}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    hits, found = 0, defaultdict(list)
    for r in ask(spark, "op4_ann"):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in x if i % 20 == 0}
    for q, got in found.items():
        scores = {i: s for i, s in zip(ids.tolist(), (m @ x[q]).tolist(), strict=True) if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        got.sort()
        assert [k for k, *_ in got] == list(range(1, 21)) and [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in got)
        hits += len(set(best) & {i for _, i, _ in got})
    assert hits >= 0.9 * 20 * len(found)


def test_op6(spark, docs):
    lang = {d["doc_id"]: (d["lang"], d["text"]) for d in docs}
    rows = ask(spark, "op6_language_id")
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    told = [(lang[r["doc_id"]][0], r["lang_pred"]) for r in rows if r["held_out"] and lang[r["doc_id"]][0] and any(c.isalpha() for c in lang[r["doc_id"]][1] or "")]
    assert sum(a == b for a, b in told) >= 0.95 * len(told)


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def test_op7(spark, docs, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"]] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in ask(spark, "op7_bpe")} == want


def test_op8(spark, docs):
    size = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = targets(dict(sizes))
    rows = ask(spark, "op8_mixing")
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_op9(spark, docs):
    text = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    rows, bytes_, slots = ask(spark, "op9_sharding"), Counter(), defaultdict(list)
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        t = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(bytes_) <= set(range(24))
    assert max(bytes_.values()) - min(bytes_[k] for k in range(24)) <= 2 * max(r["size"] for r in rows)


def test_op10_with_links_against_sql(spark):
    rng, hosts = random.Random(2), [f"h{i}.{t}" for i in range(40) for t in ("net", "org", "test")] + ["example.com", "a.example.net"]
    link = lambda h: rng.choice(['<a href="http://%s/x">', "<A HREF = '//%s'>", "<a href=https://%s?q>"]) % rng.choice([h, h.upper()])
    rows = []
    for i in range(400):
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['/', '/fr/a', '/de/b', '/en/', '', '?x'])}"
        rows.append((i, rng.choice([url, url, url, None, "no url"]) if i % 7 == 0 else url, rng.choice([None, "", *["".join(link(h) for h in rng.choices(hosts, k=rng.randint(1, 9)))] * 6])))
    rows += [(1000, "http://huge.test/", "x" * 200_000 + "".join(link(h) for h in hosts) * 50), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(str(tuple(r)) for r in url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    pages = df.toArrow()  # noqa: F841
    con.register("pages", pages)
    assert got == sorted(str(r) for r in con.sql(Q.oracle_sql()["op10_url_filter"]).fetchall())
    assert 20 < sum("'block'" in r for r in got) < len(got) - 20


def test_no_piece_of_the_vocabulary_is_left_out():
    with open(Q.PIECES, "rb") as f:
        assert set(language_id.read_pieces(Q.PIECES)) >= {base64.b64decode(line.split()[0]) for line in f if line.strip()}


def test_long_words_are_summed_in_runs(monkeypatch):
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b" a", b"abcabcabcabcabca"]
    model = language_id.Model(pieces, ["x", "y"], np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 2).T.copy())
    for n, slab in ((3, 1 << 17), (256, 1 << 17), (700, 1 << 17), (3000, 1024)):
        monkeypatch.setattr(language_id, "SLAB", slab)
        word = b" " + bytes(np.random.default_rng(n).choice(list(b"abc"), n))
        whole = language_id.Lattice(model.automaton, model.sizes, [word]).log_probability(model.p)[0]
        assert language_id.long_log_probability(model.automaton, model.sizes, model.p, word) == pytest.approx(whole, rel=1e-9)
    model = language_id.Model([*pieces, b"abc" * 20], ["x", "y"], np.random.default_rng(4).dirichlet(np.ones(len(pieces) + 1), 2).T.copy())
    for word in (b" " + b"abc" * 900, b" " + b"cab" * 15 + b"acb" * 300 + b"abc" * 20, b"a" * 2000):  # a piece of over WIDE bytes is found, or isn't
        whole = language_id.Lattice(model.automaton, model.sizes, [word]).log_probability(model.p)[0]
        assert language_id.long_log_probability(model.automaton, model.sizes, model.p, word) == pytest.approx(whole, rel=1e-9)
    long = "abc" * 1000
    assert model.score([long, long + " ab"])[0] == model.score([long + " " + "ab", long])[0][::-1]


def fixture_docs(docs):
    """Some documents with repeated lines, near and exact copies, several sources, nulls, ties and a long text."""
    rng = random.Random(6)
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in docs[:90]]
    base = [r for r in rows if r[1] and len(r[1].split()) > 60][:6]
    for k, r in enumerate(base):
        for j in range(4):
            words = r[1].split(" ")
            words[rng.randrange(len(words))] = f"edited{j}"
            rows.append((5000 + 10 * k + j, " ".join(words), r[2], rng.choice(["s1", "s2", None]), len(" ".join(words))))
    rows += [(6000 + i, f"{rows[i][1]}\nthis line is found in very many documents\nand so is that one", rows[i][2], "s2", 0) for i in range(30, 50) if rows[i][1]]
    rows += [(7000, None, None, None, None), (7001, "", "en", "s1", 0), (7002, "12 34 !!", "en", "s1", 8), (None, base[0][1], base[0][2], None, 5), rows[2], (7003, base[1][1].replace("\n", " ") * 40, base[1][2], "s1", 1)]
    return rows


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_against_plain_stages(spark, docs, library, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "row", "doc", "whole_row", "lang_pred", "n_dropped"]
    rows = [] if empty else [(*r, "a", 1, "b", "c", 2) for r in fixture_docs(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, doc long, whole_row string, lang_pred string, n_dropped long")
    stages = dict(corpus_pipeline.STAGES)
    seen = {"": df}
    for name, stage in stages.items():
        seen[name] = stage(spark, list(seen.values())[-1], "").cache()
    assert all(seen[k].columns == columns for k in list(seen)[:-1])
    got = {k: [tuple(r) for r in x.collect()] for k, x in seen.items()}
    if empty:
        assert not any(got.values())
        return
    # language: what the learned model says, text by text
    model = language_id.fit(df.where("crc32(coalesce(cast(doc_id as string), '')) % 4 <> 2"), Q.PIECES)
    kept = [r for r in got[""] if (lambda n, s: n != "und" and s >= 0.5)(*[x[0] for x in model.score([r[1]])])]
    assert Counter(got["language_id"]) == Counter(kept) and len(kept) < len(rows)
    # lines: each frequent line where it comes first, documents that lose all go
    texts = Counter((d, t) for d, _, t in plain([(r[0], r[1]) for r in kept], 10, "later"))
    whole = {(r[0], r[1]) for r in kept}
    assert {(r[0], r[1]) for r in got["line_dedup"]} == {(d, t) for d, t in texts if t.split() or (d, t) in whole}
    assert all(r[4] == len(r[1]) or (r[0], r[1]) in whole for r in got["line_dedup"])
    # near copies: of each group the least id
    lined = sorted(set(got["line_dedup"]), key=lambda r: (r[0] is None, r[0] or 0))
    roots = classes([r[1] for r in lined])
    assert sorted(got["near_dedup"], key=str) == sorted((lined[i] for i in set(roots)), key=str) and len(set(roots)) < len(lined) - 15
    # mixing: whole documents, at most three times, each source near its target
    size = lambda r: len((r[1] or "").encode().split())
    sizes, mixed = Counter(), Counter()
    for r in got["near_dedup"]:
        sizes[r[3]] += size(r)
    for r in got["mixing"]:
        mixed[r[3]] += size(r)
    assert set(got["mixing"]) <= set(got["near_dedup"]) and max(Counter(got["mixing"]).values()) <= 3
    largest = {s: max(size(r) for r in got["near_dedup"] if r[3] == s) for s in sizes}
    assert all(abs(mixed[s] - t) <= largest[s] / 2 + 1 for s, t in targets(dict(sizes)).items())
    # tokens: the library's
    want = Counter()
    for r in got["mixing"]:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], r[3], r[2], len(ids), struct.pack(f"<{len(ids)}I", *ids), True] += 1
    assert Counter((*r[:4], bytes(r[4]), r[5]) for r in got["bpe"]) == want
