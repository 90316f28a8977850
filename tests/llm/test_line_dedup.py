import random
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import line_dedup

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, min_docs, mode):
    found = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if key := line.strip(WS).translate(LOW):
                found[key].add(d)
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in (t or "").split("\n"):
            key = line.strip(WS).translate(LOW)
            gone = bool(key) and len(found[key]) >= min_docs
            if gone and mode == "later" and key not in seen:
                seen.add(key)
                gone = False
            if not gone:
                kept.append(line)
        out.append((d, len((t or "").split("\n")), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("mode", ["all", "later"])
@pytest.mark.parametrize("parts", [2, 9])
def test_against_brute_force(spark, monkeypatch, mode, parts):
    monkeypatch.setattr(line_dedup, "HELD", 40)
    rng = random.Random(parts)
    pool = ["", " ", "Same", "same ", "\tSAME\r", "É", "é", "x" * 3000, "rare", "common line"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "common line\n" * 500)] + [(300 + i, "hot line") for i in range(150)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(((r["doc_id"], r["n_lines"], r["text"] or "") for r in line_dedup.drop_lines(df, min_docs=10, mode=mode).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == plain(rows, 10, mode)


@pytest.mark.parametrize("mode", ["all", "later"])
@pytest.mark.parametrize("held", [3, 1000])
def test_stream_in_small_batches(monkeypatch, mode, held):
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = random.Random(7)
    rows = sorted((h, 0, doc, 5, pos, 99) for h in range(6) for doc in range(rng.randint(1, 7)) for pos in range(rng.choice([1, 1, 40])))
    names = ["h1", "h2", "doc", "th", "pos", "n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 4], strict=True)], names=names) for i in range(0, len(rows), 4)]
    got = [r for b in line_dedup._drops(iter(batches), {}, 4, mode) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    want = []
    for h in range(6):
        own = [r for r in rows if r[0] == h]
        if len({r[2] for r in own}) >= 4:
            want += [r[2:] for r in (own if mode == "all" else own[1:])]
    assert sorted(got) == sorted(want)


def test_names_of_the_user(spark):
    df = spark.createDataFrame([(i, "same\nown %d" % i, 777, "k", "r") for i in range(12)], "doc_id long, text string, _doc long, doc string, row string").withColumn("th", F.lit(5)).withColumn("pos", F.lit(6))
    got = line_dedup.drop_lines(df, min_docs=10)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert all((r["_doc"], r["doc"], r["row"], r["th"], r["pos"], r["text"], r["n_dropped"]) == (777, "k", "r", 5, 6, "own %d" % r["doc_id"], 1) for r in got.collect())


def test_edges(spark):
    schema = "doc_id long, text string, n_dropped string, KEEP_BITS long, other int"
    empty = line_dedup.drop_lines(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "other", "n_lines", "n_dropped"]
    rows = [(None, "a\nb", "x", 1, 1)] * 3 + [(1, "a\nb", "x", 1, 1)] * 2
    got = line_dedup.drop_lines(spark.createDataFrame(rows, schema), min_docs=2, mode="later").collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == [(False, ""), (False, ""), (True, "a\nb"), (True, "a\nb"), (True, "a\nb")]
    bits = line_dedup.keep_bitmaps(spark.createDataFrame(rows, schema), min_docs=2, min_chars=2)
    assert bits.count() == 0  # one character is too short a key
