import json

import pytest

from siltstone.operators.catalogue import PARTITIONS, Build
from siltstone.operators.export import read_back
from siltstone.sources.tables import VersionedTable

TABLES = {
    "universities": ("id string, name string, city string", [("u1", "U", "C"), ("u2", "V", None)]),
    "org_units": ("id string, university_id string, name string, kind string, url string", [("g1", "u1", "G", "school", "http://g")]),
    "professors": ("id string, name string, title string, title_family string, role_status string, reasons array<string>, master string, phd string, active boolean", [("e1", "P", "教授", "professor", "included", ["x"], "unknown", "confirmed", True), ("e2", "Q", None, None, "review", [], "unknown", "unknown", True), ("e3", "R", None, None, "excluded", [], "unknown", "unknown", False)]),
    "profiles": ("id string, profile_hash string", [("e1", "h1")]),
    "observations": ("id string, entity_id string, document_id string, grade string, active boolean", [("o1", "e1", "d1", "direct", True), ("o2", "e1", "d1", "legacy_merged", True), ("o3", "e2", None, "direct", True), ("o4", "e3", "d2", "direct", True), ("o5", "e1", "d3", "direct", False), ("o6", "e2", "d1", "guess", True)]),
    "affiliations": ("entity_id string, org_unit_id string, grade string", [("e1", "g1", "direct"), ("e1", "g1", "other"), ("e2", "g1", "legacy_merged")]),
    "statements": ("id string, entity_id string, observation_id string, raw_text string, language string, hash string", [("s1", "e1", "o2", "text", "en", "hh")]),
    "mentions": ("id string, entity_id string, observation_id string, raw_text string, doi string, year int, confidence double, needs_review boolean", [("m1", "e1", "o1", "b", "10.1/x", 2020, 0.9, False), ("m1", "e1", "o2", "a", None, 2021, 0.6, True), ("m2", "e2", "o6", "c", None, 2020, 1.0, False)]),
    "documents": ("id string, university_id string, url string, content_hash string, title string, fetched_at string", [("d1", "u1", "http://d1", "c1", "t", "2024"), ("d2", "u2", "http://d2", "c2", None, None), ("d3", "u1", "http://d3", "c3", None, None)]),
    "topics": ("id string, canonical_name string, normalized_name string, kind string, status string", [("t1", "T", "t", "task", "active"), ("t2", "S", "s", "method", "active"), ("t3", "X", "x", "task", "retired")]),
    "topic_links": ("statement_id string, topic_id string, relation string, review_status string, confidence double, method string, provenance string", [("s1", "t1", "PRIMARY_TOPIC", "approved", 0.7, "alias", "p1"), ("s1", "t2", "USES_METHOD", "pending", 0.7, "alias", "p2"), ("s1", "t3", "STUDIES", "approved", 0.7, "alias", "p3")]),
    "topic_relations": ("child string, parent string, confidence double, method string, provenance string", [("t1", "t2", 1.0, "taxonomy", "r1"), ("t1", "t3", 1.0, "taxonomy", "r2")]),
}


@pytest.fixture
def build(spark):
    return Build("b", {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in TABLES.items()}, {"graph_schema_version": "v6"})


def test_all_partitions(build):
    found = {}
    for r in build.rows().collect():
        found.setdefault(r.partition, {})[r.row_key] = json.loads(r.payload)
    assert set(found) == set(PARTITIONS) - {"rel:USES_METHOD", "rel:APPLIED_TO", "rel:TARGETS_TASK", "rel:STUDIES"}
    nodes = {p[5:]: set(rows) for p, rows in found.items() if p.startswith("node:")}
    assert nodes == {"Build": {"b"}, "University": {"u1", "u2"}, "OrgUnit": {"g1"}, "Professor": {"e1", "e2"}, "ResearchStatement": {"s1"}, "Topic": {"t1", "t2"}, "PublicationMention": {"m1", "m2"}, "SourceDocument": {"d1"}}
    told = lambda p: {k: (v["evidence_count"], v["confidence"]) for k, v in found[f"rel:{p}"].items()}
    assert told("PART_OF") == {"b:g1|b:u1": (1, 1.0)} and told("AFFILIATED_WITH") == {"b:e1|b:g1": (2, 0.5), "b:e2|b:g1": (1, 0.8)}
    assert told("HAS_RESEARCH_STATEMENT") == {"b:e1|b:s1": (1, 0.8)} and told("PRIMARY_TOPIC") == {"b:s1|b:t1": (1, 0.7)} and told("SUBTOPIC_OF") == {"b:t1|b:t2": (1, 1.0)}
    assert told("HAS_PUBLICATION_MENTION") == {"b:e1|b:m1": (2, 0.8), "b:e2|b:m2": (1, 0.5)}
    assert told("OBSERVED_IN") == {"b:e1|b:d1": (2, 0.8), "b:e2|b:d1": (1, 0.5)} and told("FROM_UNIVERSITY") == {"b:d1|b:u1": (3, 1.0)}
    assert found["node:PublicationMention"]["m1"] == {"logical_id": "m1", "graph_key": "b:m1", "raw_text": "a", "doi": "10.1/x", "year": None, "confidence": 0.6, "evidence_count": 2, "needs_review": True}
    assert found["node:Professor"]["e2"]["profile_hash"] is None and found["node:Build"]["b"]["graph_schema_version"] == "v6"
    assert "method" in found["rel:PRIMARY_TOPIC"]["b:s1|b:t1"] and "method" not in found["rel:PART_OF"]["b:g1|b:u1"]


def test_rebuilding_partitions_in_a_table_keeps_the_others(spark, build, tmp_path):
    rows = build.rows()
    table = VersionedTable(spark, str(tmp_path / "export"), "partition")
    table.replace(rows)
    first, before = build.manifest(table.read()), table.version()
    assert first.count() == 20 and read_back(first, build.manifest(rows)).where("difference IS NOT NULL").collect() == []
    build.tables["statements"] = build.tables["statements"].limit(0)
    again = ("node:ResearchStatement", "rel:HAS_RESEARCH_STATEMENT")
    after = table.replace(build.rows(again), list(again))
    assert {p: f for p, f in after.files.items()} == {p: f for p, f in before.files.items() if p not in again}
    changed = {r.partition for r in read_back(first, build.manifest(table.read())).where("difference IS NOT NULL").collect()}
    assert changed == set(again)


def test_partitions_of_one_source_read_it_once(build):
    leaves = lambda *names: build.rows(names)._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves("node:PublicationMention", "rel:HAS_PUBLICATION_MENTION") == 2  # mentions and observations
    assert leaves("node:SourceDocument", "rel:FROM_UNIVERSITY") == 3  # documents, observations and professors
    assert leaves(*(f"rel:{k}" for k in ("PRIMARY_TOPIC", "USES_METHOD", "APPLIED_TO", "TARGETS_TASK", "STUDIES"))) == 2  # links and topics
    assert "Expand" not in build.rows()._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_count_each_observation_once_and_relate_known_ones_alone(spark, build):
    schema = TABLES["mentions"][0]
    rows = [("m1", "e1", o, "x", None, y, 1.0, None) for o, y in (("o2", 2020), ("o1", 2020), ("o2", None), ("lost", 2020), (None, 2020))] + [("m2", "e1", "lost", "y", None, None, None, False), ("m3", None, "o6", "z", None, 2020, 0.5, True), ("m3", None, "o6", "z", None, 2021, 0.5, True)]
    build.tables["mentions"] = spark.createDataFrame(rows, schema)
    build.tables["observations"] = build.tables["observations"].union(build.tables["observations"].where("id = 'o2'"))
    nodes = {r.row_key: json.loads(r.payload) for r in build.partition("node:PublicationMention").collect()}
    assert {k: (v["evidence_count"], v["year"]) for k, v in nodes.items()} == {"m1": (3, 2020), "m2": (1, None), "m3": (1, None)}
    told = {(r.start, r.end): json.loads(r.payload) for r in build.partition("rel:HAS_PUBLICATION_MENTION").collect()}
    assert {k: (v["evidence_count"], v["confidence"]) for k, v in told.items()} == {("b:e1", "b:m1"): (2, 0.8), (None, "b:m3"): (1, 0.5)}
