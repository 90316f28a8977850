"""Turtle in pieces against the reader of whole documents, with borders at every kind of place."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.sources.pieces import read_turtle_pieces, tokens, write_turtle_pieces
from weftgraph.sources.store import Store, rows_frame
from weftgraph.sources.turtle import LANG_STRING, STRING, read_turtle

HEAD = "@prefix : <http://x.org/o#> .\n@prefix\n  ex:\n <http://x.org/e/> . # \"\"\" no string\n"
STATEMENTS = (
    ":a{n} :p ex:b.c , ex:d ; a :C .",
    ':a{n} :text """one. two\n :no :no :no .\n# no comment " and ""\n""" ; :more \'\'\'x"""y\n.\'\'\'@en .',
    ':a{n}\n  :num 1.5 , .5 ,\n  2 ; # a comment with """ and \'\'\' and .\n :iri <http://x.org/a.b#c\\u0041> .',
    "[] :p [ :q ( 1 :a{n} [ :r \"a. b\" ] ) ] .",
    "_:b1 :p _:n{n} . _:n{n} :q 'it\\'s. \"\"\" not'^^ex:t.",
    "PREFIX ex: <http://x.org/e{n}/>\nBASE <http://base{n}.org/x>",
    "@prefix z: <z{n}#> . z:s z:p <rel> .",
    ':a{n} :p ex:it\\\'s , ex:a\\#b .\n\n\n# only a comment.\n',
    ':long{n} :p "' + "x. " * 120 + '" ,\n' + " ,\n".join(f"  :o{i}" for i in range(40)) + " .",
    ':esc{n} :p """a\\"""" , "\\\\" , "tab\\t" .',
)


def document(seed: int, n: int) -> str:
    r = random.Random(seed)
    return HEAD + "".join(r.choice(STATEMENTS).replace("{n}", str(i)) + r.choice(("\n", " ", "\n\n")) for i in range(n))


def shapes(rows) -> list:
    """Rows with generated blank nodes replaced by what is said about them."""
    rows = sorted({tuple(r) for r in rows}, key=str)
    colour = {x: "" for r in rows for x in (r[2], r[5]) if "#b~" in x}
    for _ in range(6):
        seen = {}
        for g, _, s, p, _, o, *_ in rows:
            if s in colour:
                seen.setdefault(s, []).append(f">{p} {colour.get(o, o)}")
            if o in colour:
                seen.setdefault(o, []).append(f"<{p} {colour.get(s, s)}")
        colour = {x: str(hash(tuple(sorted(seen[x])))) for x in colour}
    return sorted((str((g, sk, colour.get(s, s), p, ok, colour.get(o, o), dt, lang)) for g, sk, s, p, ok, o, dt, lang in rows))


@pytest.fixture
def splits(spark):
    def of(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("seed", "size", "n"), [(1, 300, 25), (2, 900, 60), (3, 4000, 200), (4, 60, 6), (5, 1 << 20, 40)])
def test_pieces_equal_the_whole(spark, tmp_path, splits, monkeypatch, seed, size, n):
    monkeypatch.setattr("weftgraph.sources.pieces.PIECE", 7)
    text = document(seed, n)
    (tmp_path / "d.ttl").write_text(text)
    splits(size)
    quads, notes = read_turtle_pieces(spark, str(tmp_path / "d.ttl"), "g", "http://base.org/")
    assert spark.read.text(str(tmp_path / "d.ttl")).rdd.getNumPartitions() >= min(20, len(text) // size)
    assert notes.collect() == []
    assert shapes(quads.collect()) == shapes(read_turtle(text, "g", "http://base.org/", "d.ttl"))


def test_bad_statements_are_reported_and_others_kept(spark, tmp_path, splits):
    lines = [f":s{i} :p :o{i} ." if i % 50 else f":s{i} :p unknown:x{i} ." for i in range(400)]
    (tmp_path / "d.ttl").write_text(HEAD + "\n".join(lines))
    splits(1000)
    quads, notes = read_turtle_pieces(spark, str(tmp_path / "d.ttl"), "g")
    assert quads.count() == 392
    found = notes.collect()
    assert len(found) == 8 and all("unknown prefix" in r["message"] and r["severity"] == "Critical" for r in found)


@pytest.mark.parametrize("text", ["", "\n\n", "# only a comment", "﻿" + HEAD, HEAD + ':a :p "no end'])
def test_edges_of_documents(spark, tmp_path, splits, text):
    (tmp_path / "d.ttl").write_text(text)
    splits(20)
    quads, notes = read_turtle_pieces(spark, str(tmp_path / "d.ttl"), "g")
    assert quads.count() == 0 and notes.count() == ("no end" in text)


def test_several_documents_have_their_own_prefixes(spark, tmp_path, splits):
    for i in range(3):
        (tmp_path / f"d{i}.ttl").write_text(f'@prefix : <http://d{i}.org/> .\n:s :p """\n\n"""@en , _:x .\n' + "\n".join(f":s :q {k} ." for k in range(30)))
    splits(100)
    quads, notes = read_turtle_pieces(spark, str(tmp_path), "g")
    assert notes.count() == 0 and quads.count() == 3 * 32
    assert sorted(r["o"] for r in quads.where("o_kind = 'B'").collect()) == [f"d{i}.ttl#x" for i in range(3)]
    assert quads.where(F.col("s").startswith("http://d1.org/")).count() == 32


def test_line_states():
    assert tokens('a """ b', "")[1] == '"""' and tokens('x """ . \'\'\'', '"""') == ([(6, 7, "op", ".")], "'''")
    assert tokens('# """', "")[1] == "" and tokens("'\"\"\"' .", "")[1] == "" and tokens('\\""" x', '"""')[1] == '"""'
    assert [t[3] for t in tokens("ex:a.b. 1.5.", "")[0]] == ["ex:a.b", ".", "1.5", "."]


def test_written_by_tasks_and_read_again(spark, tmp_path, splits):
    odd = 'quote " back\\slash\nline\ttab . """ \r é \U0001f600'
    rows = [("g", "I", "http://www.w3.org/2002/07/owl#Thing", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "I", "http://x.org/a b<c>", None, None)]
    rows += [("g", "B", "f.ttl#b~1", "urn:p", "L", odd, STRING, None), ("g", "B", "f.ttl#b_1", "urn:p", "L", odd, LANG_STRING, "en"), ("g", "I", "urn:s", "urn:p", "B", "f.ttl#b~1", None, None)]
    rows += [("g", "I", "urn:hot", f"urn:p{i % 3}", "L", str(i), "http://www.w3.org/2001/XMLSchema#integer", None) for i in range(5000)]
    path = str(tmp_path / "out")
    write_turtle_pieces(rows_frame(spark, rows), path)
    splits(20_000)
    quads, notes = read_turtle_pieces(spark, path, "g", label="f")
    assert notes.collect() == []
    again = [tuple(r) for r in quads.collect()]
    assert sorted(map(str, (r for r in again if "B" not in (r[1], r[4])))) == sorted(map(str, (r for r in rows if "B" not in (r[1], r[4]))))
    blank = {r[2]: r for r in again if r[1] == "B"}
    assert len(blank) == 2 and {r[5] for r in blank.values()} == {odd}
    pointed = next(r[5] for r in again if r[2] == "urn:s")
    assert blank[pointed][7] is None
    write_turtle_pieces(rows_frame(spark, []), path)
    assert read_turtle_pieces(spark, path, "g")[0].count() == 0


def test_a_store_takes_in_and_gives_out_large_turtle(spark, tmp_path, splits):
    (tmp_path / "d.ttl").write_text(document(8, 80) + ":bad :p nothing:x .\n")
    splits(700)
    store = Store(spark, path=str(tmp_path / "s"))
    g = store.insert_large(str(tmp_path / "d.ttl"))
    assert shapes(store.graph(g).collect()) == shapes(read_turtle(document(8, 80), g, f"file:{tmp_path}/d.ttl", "d.ttl"))
    assert ["unknown prefix" in r["message"] for r in store.diagnostics().collect()] == [True]
    store.export_turtle(g, str(tmp_path / "out"))
    again = Store(spark, path=str(tmp_path / "t"))
    assert again.graph(again.insert_large(str(tmp_path / "out"))).count() == store.graph(g).count()
