"""The export partitions of a catalogue build: eight kinds of nodes, twelve of relations, as rows with payload and digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import hash_parts
from siltstone.operators.relational import manifest

#: Confidence of a relation by the grade of what it was seen in, others 0.5, and the relations between statements and topics.
GRADES = {"direct": 1.0, "legacy_merged": 0.8}
OTHER = 0.5
TOPIC_RELATIONS = ("PRIMARY_TOPIC", "USES_METHOD", "APPLIED_TO", "TARGETS_TASK", "STUDIES")
PARTITIONS = (
    *(f"node:{x}" for x in ("Build", "University", "OrgUnit", "Professor", "ResearchStatement", "Topic", "PublicationMention", "SourceDocument")),
    *(f"rel:{x}" for x in ("PART_OF", "AFFILIATED_WITH", "HAS_RESEARCH_STATEMENT", *TOPIC_RELATIONS, "SUBTOPIC_OF", "HAS_PUBLICATION_MENTION", "OBSERVED_IN", "FROM_UNIVERSITY")),
)
#: Partitions that are read off one source together.
SAME_SOURCE = {
    "node:PublicationMention": "mentions", "rel:HAS_PUBLICATION_MENTION": "mentions", "node:SourceDocument": "documents", "rel:FROM_UNIVERSITY": "documents",
    **{f"rel:{kind}": "topic_links" for kind in TOPIC_RELATIONS},
}


def confidence(grade: Column) -> Column:
    out = F.lit(OTHER)
    for name, value in GRADES.items():
        out = F.when(grade == name, value).otherwise(out)
    return out


class Build:
    """The partitions of a build from its tables.

    ``universities`` (id, name, city), ``org_units`` (id, university_id, name, kind, url), ``professors`` (id, name, title, title_family, role_status,
    reasons, master, phd, active), ``profiles`` (id, profile_hash), ``observations`` (id, entity_id, document_id, grade, active),
    ``affiliations`` (entity_id, org_unit_id, grade), ``statements`` (id, entity_id, observation_id, raw_text, language, hash), ``mentions`` (id, entity_id,
    observation_id, raw_text, doi, year, confidence, needs_review), ``documents`` (id, university_id, url, content_hash, title, fetched_at), ``topics`` (id,
    canonical_name, normalized_name, kind, status), ``topic_links`` (statement_id, topic_id, relation, review_status, confidence, method, provenance) and
    ``topic_relations`` (child, parent, confidence, method, provenance). Ids are strings. Inactive professors and topics, what hangs on them, and links not approved don't leave.
    """

    def __init__(self, build_id: str, tables: dict[str, DataFrame], about: dict[str, str] | None = None):
        self.id, self.tables, self.about = build_id, tables, about or {}

    def _key(self, c: Column) -> Column:
        return F.concat(F.lit(f"{self.id}:"), c)

    def _row(self, partition: Column, key: Column, start: Column, end: Column, properties: dict[str, Column], provenance: Column) -> Column:
        payload = F.to_json(F.struct(*(properties[n].alias(n) for n in sorted(properties))), {"ignoreNullFields": "false"})
        return F.struct(partition.alias("partition"), key.alias("row_key"), start.alias("start"), end.alias("end"), payload.alias("payload"), provenance.alias("provenance"))

    def _node(self, label: str, properties: dict[str, Column], provenance: Column) -> Column:
        none, key = F.lit(None).cast("string"), F.col("id")
        return self._row(F.lit(f"node:{label}"), key, none, none, {"logical_id": key, "graph_key": self._key(key)} | properties, provenance)

    def _relation(self, kind: Column, start: Column, end: Column, evidence: Column, sure: Column, provenance: Column, method: Column | None = None) -> Column:
        start, end = self._key(start), self._key(end)
        properties = {
            "graph_key": self._key(hash_parts(kind, start, end)), "confidence": sure.cast("double"), "evidence_count": evidence.cast("long"), "evidence_lookup": provenance, "provenance_ref": provenance,
        } | ({"method": method} if method is not None else {})
        return self._row(F.concat(F.lit("rel:"), kind), F.concat_ws("|", start, end), start, end, properties, provenance)

    def _at(self, *parts) -> Column:
        return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))

    def _seen(self) -> DataFrame:
        active = self.tables["professors"].where("active").select(F.col("id").alias("entity_id"))
        return self.tables["observations"].where("active").join(active, "entity_id", "left_semi")

    def _mentions(self) -> DataFrame:
        """(id, entity_id) with what its mentions say, the number of its observations, and of those that are known (``known``).

        A mention meets its observation and its like once each: rows come sorted by observation, so an observation counts where the one before it is another.
        """
        c = F.col
        graded = self.tables["observations"].select(c("id").alias("observation_id"), confidence(c("grade")).alias("sure"), F.lit(True).alias("there"))
        before = F.lag("observation_id").over(Window.partitionBy("id", "entity_id").orderBy("observation_id"))
        told = self.tables["mentions"].join(graded, "observation_id", "left").withColumn("first", c("observation_id").isNotNull() & ~before.eqNullSafe(c("observation_id")))
        return told.groupBy("id", "entity_id").agg(
            F.min("raw_text").alias("raw_text"), F.min("doi").alias("doi"), F.when(F.min("year") == F.max("year"), F.min("year")).alias("year"), F.min("confidence").alias("confidence"),
            F.max("needs_review").alias("needs_review"), F.count_if("first").alias("evidence_count"), F.count_if(c("first") & c("there")).alias("known"), F.min("sure").alias("sure"),
        )

    def _read(self, names: tuple[str, ...]) -> DataFrame:
        """Rows of one partition, or of several of one source, which is read once for all of them."""
        t, c, kind = self.tables, F.col, names[0].split(":", 1)[1]
        topics = t["topics"].where("status = 'active'")
        one = lambda df, row: df.select(row.alias("r")).select("r.*")
        each = lambda df, rows: df.select(F.inline(F.array(*(rows[n] for n in names)))).where("partition IS NOT NULL")
        if kind == "Build":
            about = {"status": F.lit("WRITING_VECTOR")} | {k: F.lit(v) for k, v in self.about.items()}
            return one(t["topics"].sparkSession.createDataFrame([(self.id,)], "id string"), self._node(kind, about, self._at("catalog:build", self.id)))
        if kind == "University":
            return one(t["universities"], self._node(kind, {"name": c("name"), "city": c("city"), "active": F.lit(True)}, self._at("catalog:source", c("id"))))
        if kind == "OrgUnit":
            return one(t["org_units"], self._node(kind, {x: c(x) for x in ("university_id", "name", "kind", "url")}, self._at("catalog:org-unit", self.id, c("university_id"), c("id"))))
        if kind == "Professor":
            rows = t["professors"].where("active").join(t["profiles"], "id", "left")
            return one(rows, self._node(kind, {x: c(x) for x in ("name", "title", "title_family", "role_status", "reasons", "master", "phd", "active", "profile_hash")}, self._at("catalog:entity", c("id"), "build", self.id)))
        if kind == "ResearchStatement":
            return one(t["statements"], self._node(kind, {x: c(x) for x in ("raw_text", "language", "hash")}, self._at("catalog:research-statement", self.id, c("id"))))
        if kind == "Topic":
            return one(topics, self._node(kind, {x: c(x) for x in ("canonical_name", "normalized_name", "kind", "status")}, self._at("taxonomy:topic", c("id"))))
        if kind == "PART_OF":
            return one(t["org_units"], self._relation(F.lit(kind), c("id"), c("university_id"), F.lit(1), F.lit(1.0), self._at("catalog:org-unit", self.id, c("university_id"), c("id"))))
        if kind == "AFFILIATED_WITH":
            rows = t["affiliations"].groupBy("entity_id", "org_unit_id").agg(F.count(F.lit(1)).alias("n"), F.min(confidence(c("grade"))).alias("sure"))
            return one(rows, self._relation(F.lit(kind), c("entity_id"), c("org_unit_id"), c("n"), c("sure"), self._at("catalog:affiliation", self.id, c("entity_id"), c("org_unit_id"))))
        if kind == "HAS_RESEARCH_STATEMENT":
            rows = t["statements"].join(t["observations"].select(c("id").alias("observation_id"), "grade"), "observation_id")
            return one(rows, self._relation(F.lit(kind), c("entity_id"), c("id"), F.lit(1), confidence(c("grade")), self._at("catalog:research-statement", self.id, c("id"))))
        if kind in TOPIC_RELATIONS:
            asked = c("relation").isin([n.split(":", 1)[1] for n in names])
            rows = t["topic_links"].where(asked & (c("review_status") == "approved")).join(topics.select(c("id").alias("topic_id")), "topic_id", "left_semi")
            return one(rows, self._relation(c("relation"), c("statement_id"), c("topic_id"), F.lit(1), c("confidence"), c("provenance"), c("method")))
        if kind == "SUBTOPIC_OF":
            rows = t["topic_relations"].join(topics.select(c("id").alias("child")), "child", "left_semi").join(topics.select(c("id").alias("parent")), "parent", "left_semi")
            return one(rows, self._relation(F.lit(kind), c("child"), c("parent"), F.lit(1), c("confidence"), c("provenance"), c("method")))
        if kind == "OBSERVED_IN":
            rows = self._seen().where("document_id IS NOT NULL").groupBy("entity_id", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min(confidence(c("grade"))).alias("sure"))
            return one(rows, self._relation(F.lit(kind), c("entity_id"), c("document_id"), c("n"), c("sure"), self._at("catalog:observation-document", self.id, c("entity_id"), c("document_id"))))
        if kind in ("PublicationMention", "HAS_PUBLICATION_MENTION"):
            provenance = self._at("catalog:publication-mention", self.id, c("id"))
            return each(self._mentions(), {
                "node:PublicationMention": self._node("PublicationMention", {x: c(x) for x in ("raw_text", "doi", "year", "confidence", "evidence_count", "needs_review")}, provenance),
                "rel:HAS_PUBLICATION_MENTION": F.when(c("known") > 0, self._relation(F.lit("HAS_PUBLICATION_MENTION"), c("entity_id"), c("id"), c("known"), c("sure"), provenance)),
            })
        if kind in ("SourceDocument", "FROM_UNIVERSITY"):
            rows = t["documents"].join(self._seen().groupBy(c("document_id").alias("id")).agg(F.count_distinct("id").alias("n")), "id")
            provenance = self._at("catalog:source-document", c("id"))
            return each(rows, {
                "node:SourceDocument": self._node("SourceDocument", {x: c(x) for x in ("url", "content_hash", "title", "fetched_at")}, provenance),
                "rel:FROM_UNIVERSITY": self._relation(F.lit("FROM_UNIVERSITY"), c("id"), c("university_id"), c("n"), F.lit(1.0), provenance),
            })
        raise ValueError(f"no partition {names[0]}")

    def partition(self, name: str) -> DataFrame:
        """(partition, row_key, start, end, payload, provenance) of one partition."""
        return self._read((name,))

    def rows(self, names: tuple[str, ...] = PARTITIONS) -> DataFrame:
        """The rows of the partitions with their digests, to be put into a versioned table by ``partition``."""
        sources: dict[str, list[str]] = {}
        for name in names:
            sources.setdefault(SAME_SOURCE.get(name, name), []).append(name)
        every = reduce(DataFrame.unionByName, (self._read(tuple(of)) for of in sources.values()))
        return every.withColumn("payload_sha256", F.sha2(F.col("payload").cast("binary"), 256))

    def manifest(self, rows: DataFrame) -> DataFrame:
        """Count, least and greatest key and digest of every partition, empty ones included."""
        listed = rows.sparkSession.createDataFrame([(p,) for p in PARTITIONS], "partition string")
        return manifest(rows, "partition", F.col("row_key"), F.col("payload"), listed)
