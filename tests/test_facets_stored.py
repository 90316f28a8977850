"""Search by prefix in an index, and totals counted while writing."""

import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import facets, label_index

NODES = "term string, term_kind string, element_type string, label string, individuals long"


@pytest.fixture
def nodes(spark):
    rows = [(f"urn:{i}", "I", ("owl:Class", "owl:Thing", "rdfs:Literal")[i % 3], f"{'Aab'[i % 3]}{chr(98 + i // 3 % 20)}{i // 6}", i) for i in range(900)]
    rows += [(f"urn:hot{i}", "I", "owl:Class", "Hot label", 1) for i in range(500)]
    rows += [("n", "I", "owl:Class", None, 0), ("t", "I", None, "no type", 0), ("e", "I", "owl:Class", "", 0), ("u", "I", "owl:Class", "ÉTÉ", 0), ("v", "I", "owl:Class", "été", 0), ("z", "I", "owl:Class", "\U0001f600 face", 0)]
    return spark.createDataFrame(rows, NODES).withColumn("folded", F.lit("a column of the same name"))


def test_index_finds_what_search_finds_in_few_files(spark, nodes, tmp_path):
    index = label_index.build(nodes, str(tmp_path / "i"), files=16)
    known = nodes.where("element_type IS NOT NULL")
    for prefix in ("", "a", "A", "ab", "bQ", "hot", "Hot label", "été", "\U0001f600", "zzz", "a%", "ab1￿"):
        found = sorted((r["element_type"], tuple(r["labels"])) for r in index.search(prefix).collect())
        assert found == sorted((r["element_type"], tuple(r["labels"])) for r in facets.search(known, prefix).collect()), prefix
    everything = spark.read.parquet(str(tmp_path / "i" / "labels")).inputFiles()
    assert len(everything) > 8 and len(index.files("")) == len(everything)
    assert len(index.files("hot")) <= 2 and len(index.files("ab")) <= 4
    assert len(index.find("hot").inputFiles()) == len(index.files("hot")) and index.find("hot").collect() == [("owl:Class", "Hot label")]
    assert "PushedFilters: [IsNotNull(folded), StringStartsWith(folded,hot)]" in index.find("hot")._jdf.queryExecution().executedPlan().toString()
    assert label_index.LabelIndex(spark, str(tmp_path / "i")).search("hot").count() == 1


def test_an_index_of_nothing(spark, nodes, tmp_path):
    index = label_index.build(nodes.where("false"), str(tmp_path / "i"))
    assert index.search("").collect() == [] and index.find("a").columns == ["element_type", "label"]


@pytest.mark.parametrize("some", [True, False])
def test_totals_cost_no_job(spark, nodes, tmp_path, some):
    edges = spark.createDataFrame(
        [("a", "b", "owl:ObjectProperty", "urn:p", "p", "1", None, ["SymmetricProperty"]), ("a", "c", "rdfs:subClassOf", None, None, None, None, [])],
        "domain string, range string, edge_type string, property string, label string, card_min string, card_max string, characteristics array<string>",
    )
    nodes, edges = nodes.where(F.lit(some)), edges.where(F.lit(some))
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    totals = facets.write(nodes, edges, str(tmp_path / "d"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2
    assert totals == facets.summary(nodes, edges).first().asDict()
    assert spark.read.parquet(str(tmp_path / "d" / "nodes")).count() == totals["nodes"] == (1406 if some else 0)
