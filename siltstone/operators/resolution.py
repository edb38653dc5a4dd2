"""Entity resolution: identity claims, ordered assignment, survivorship, roles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import hashing, text, urls
from siltstone.operators.graph import connected_components, resolve_merges
from siltstone.operators.relational import best_by
from siltstone.storage import cut

#: Scores of the ways to match, and confidences of evidence grades.
SCORES = {"strong": 1.0, "reused": 1.0, "weak": 0.8, "new": None, "review": 0.0}
GRADES = {"official": 0.9, "profile": 0.6, "listing": 0.4}

#: Title families in the order in which they are tried, and the terms of roles.
FAMILIES = [
    ("clinical", ["主任医师", "副主任医师", "主治医师"]),
    ("researcher", ["副研究员", "研究员"]),
    ("associate", ["副教授", "特聘副教授"]),
    ("professor", ["教授", "院士"]),
    ("lecturer", ["讲师", "助理教授"]),
    ("technical", ["高级工程师", "工程师", "实验师", "护师", "技术员"]),
]
EXCLUDED = ["专职行政", "行政人员", "行政团队", "辅导员", "学生工作", "学工队伍", "教辅人员", "教辅岗位", "实验技术队伍", "实验室管理人员"]
MASTER = (["硕士生导师", "硕导", "研究生导师"], ["非硕士生导师", "不是硕士生导师", "非硕导"])
PHD = (["博士生导师", "博导"], ["非博士生导师", "不是博士生导师", "非博导"])


def identity_claims(observations: DataFrame) -> DataFrame:
    """(observation_id, kind, value, strength) of ``observations``.

    These have observation_id, university_id, org_unit_id, name_key, source_url,
    page_kind (single_profile, multi_profile, unknown), external_link, email.
    """
    url = urls.catalog_url(F.col("source_url"))
    named = F.concat_ws("|", url, "name_key")

    def claim(kind: str, value: Column, strength: str, when: Column) -> Column:
        return F.when(when & value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(strength).alias("strength")))

    single = F.col("page_kind") == "single_profile"
    claims = F.array(
        claim("profile_name_url", named, "strong", single & url.isNotNull()),
        claim("external_identity", urls.external_identity(F.col("external_link")), "strong", F.lit(True)),
        claim("listing_name_url", named, "weak", ~single & url.isNotNull()),
        claim("weak_org_name", F.concat_ws("|", "university_id", "org_unit_id", "name_key"), "weak", F.col("org_unit_id").isNotNull()),
        claim("email", text.email(F.col("email")), "weak", F.lit(True)),
    )
    rows = observations.select("observation_id", F.explode(F.filter(claims, lambda x: x.isNotNull())).alias("c"))
    return rows.select("observation_id", "c.kind", "c.value", "c.strength")


def assign_entities(observations: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(observation_id, entity_id, method, score, finding) in the order of (source_ordinal, observation_id).

    An observation goes, in this order: where ``history`` (observation_id, entity_id)
    has it; to the one entity that owns one of its strong claims; into review if several do;
    to the one entity that shares a weak claim other than the e-mail, unless its listing or
    e-mail contradicts that entity's (then review); into review if several do; else it is
    new. Later observations see earlier assignments.

    Observations can meet only through shared claims, so components of those are replayed
    apart from each other. A component streams through its task in order; the task keeps its
    claims, not its rows.
    """
    claims = cut(identity_claims(observations), "claims")
    linking = claims.where("kind <> 'email'")
    node = F.xxhash64(F.lit("o"), "observation_id")
    edges = linking.select(node.alias("src"), F.xxhash64(F.lit("c"), "kind", "value").alias("dst"))
    if history is not None:
        edges = edges.union(history.select(node.alias("src"), F.xxhash64(F.lit("e"), "entity_id").alias("dst")))
    labels = connected_components(edges)
    given = F.collect_list(F.struct("kind", "value", "strength"))
    rows = observations.select("observation_id", "source_ordinal", node.alias("id")).join(labels, "id", "left").withColumn("component", F.coalesce("component_id", "id"))
    rows = rows.join(claims.groupBy("observation_id").agg(F.array_sort(given).alias("claims")), "observation_id", "left")
    known = observations.select("observation_id").join(history, "observation_id", "left") if history is not None else observations.select("observation_id", F.lit(None).cast("string").alias("entity_id"))
    rows = rows.join(known.withColumnRenamed("entity_id", "historic"), "observation_id").withColumn("fresh", hashing.hash_parts(F.lit("entity"), F.col("observation_id")))

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component: int | None = None
        owner: dict = {}
        members: dict = defaultdict(set)
        held: dict = defaultdict(set)
        for part in parts:
            out = []
            for at, obs, historic, fresh, own in part[["component", "observation_id", "historic", "fresh", "claims"]].itertuples(index=False):
                if at != component:
                    component = at
                    owner, members, held = {}, defaultdict(set), defaultdict(set)
                mine = [(c["kind"], c["value"], c["strength"]) for c in (own if own is not None else [])]
                finding = None
                if isinstance(historic, str):
                    entity, method = historic, "reused"
                else:
                    strong = {owner[k, v] for k, v, s in mine if s == "strong" and (k, v) in owner}
                    weak = set().union(*[members[k, v] for k, v, s in mine if s == "weak" and k != "email"])
                    target = next(iter(strong or weak), None)
                    apart = not strong and len(weak) == 1 and any(held[target, k] and v not in held[target, k] for k, v, _ in mine if k in ("listing_name_url", "email"))
                    if len(strong) == 1:
                        entity, method = target, "strong"
                    elif len(strong) > 1:
                        entity, method, finding = fresh, "review", "strong_claim_collision"
                    elif apart:
                        entity, method, finding = fresh, "review", "identity_conflict"
                    elif len(weak) == 1:
                        entity, method = target, "weak"
                    elif weak:
                        entity, method, finding = fresh, "review", "weak_claim_collision"
                    else:
                        entity, method = fresh, "new"
                for k, v, s in mine:
                    if s == "strong" and (k, v) not in owner:
                        owner[k, v] = entity
                    members[k, v].add(entity)
                    held[entity, k].add(v)
                out.append((obs, entity, method, SCORES[method], finding))
            yield pd.DataFrame(out, columns=["observation_id", "entity_id", "method", "score", "finding"])

    ordered = rows.repartition("component").sortWithinPartitions("component", "source_ordinal", "observation_id")
    return ordered.mapInPandas(replay, "observation_id string, entity_id string, method string, score double, finding string")


def surviving_fields(claims: DataFrame) -> DataFrame:
    """Best value of each (entity_id, field): by grade, time, observation; ``claims`` also have value, grade, observed_at, observation_id."""
    confidence = F.lit(0.0)
    for grade, value in GRADES.items():
        confidence = F.when(F.col("grade") == grade, value).otherwise(confidence)
    ranked = claims.where(F.col("value").isNotNull()).withColumn("confidence", confidence)
    best = best_by(ranked, ["entity_id", "field"], [F.desc("confidence"), F.desc_nulls_last("observed_at"), F.desc("observation_id")])
    return best.select("entity_id", "field", "value", "confidence", "observation_id")


def completeness(fields: list[str]) -> Column:
    """Share of the fields that have a value, to four digits."""
    total = F.lit(0)
    for f in fields:
        total = total + F.col(f).isNotNull().cast("int")
    return F.round(total / len(fields), 4)


def _any(values: Column, terms: list[str]) -> Column:
    return F.exists(values, lambda v: F.coalesce(F.array_contains(F.array(*[F.contains(v, F.lit(t)) for t in terms]), True), F.lit(False)))


def _eligible(values: Column, terms: tuple[list[str], list[str]]) -> Column:
    """confirmed, conflict or unknown: a negative term spoils the value that it stands in."""
    positive, negative = terms
    yes = F.exists(values, lambda v: F.array_contains(F.array(*[F.contains(v, F.lit(t)) for t in positive]), True) & ~F.array_contains(F.array(*[F.contains(v, F.lit(t)) for t in negative]), True))
    return F.when(yes & _any(values, negative), "conflict").when(yes, "confirmed").otherwise("unknown")


def classify_roles(rows: DataFrame, title: str, enrollment: str, context: str) -> DataFrame:
    """``rows`` with title_family, role_status, reason, master, phd; enrollment and context are arrays of texts."""
    name = F.coalesce(text.normalize_text(F.col(title)), F.lit(""))
    rows = rows.withColumn("_title", name)
    family = F.lit("unknown")
    for label, terms in reversed(FAMILIES):
        family = F.when(_any(F.array("_title"), terms), label).otherwise(family)
    rows = rows.withColumn("title_family", family).withColumn("master", _eligible(F.col(enrollment), MASTER)).withColumn("phd", _eligible(F.col(enrollment), PHD))
    said = ["confirmed", "conflict"]
    case = (
        F.when(_any(F.concat(F.col(context), F.array("_title")), EXCLUDED), F.struct(F.lit("excluded"), F.lit("explicit_non_teacher_context")))
        .when(F.col("master").isin(said) | F.col("phd").isin(said), F.struct(F.lit("included"), F.lit("supervisor_evidence")))
        .when(F.col("title_family").isin("professor", "associate", "researcher", "clinical"), F.struct(F.lit("included"), F.lit("teaching_research_title")))
        .when(F.col("title_family") == "lecturer", F.struct(F.lit("review"), F.lit("lecturer_without_supervisor_evidence")))
        .when(F.col("title_family") == "technical", F.struct(F.lit("review"), F.lit("technical_title_without_exclusion_context")))
        .otherwise(F.struct(F.lit("review"), F.lit("missing_or_unclassified_title")))
    )
    return rows.withColumn("_role", case).withColumn("role_status", F.col("_role.col1")).withColumn("reason", F.col("_role.col2")).drop("_role", "_title")


LOCAL = 100_000  # cluster pairs that one task finishes when no more than that are left


def _contracted(pairs: DataFrame, merges: DataFrame, group: str) -> DataFrame:
    """``pairs`` (group, a, b, key) with the clusters of ``merges`` (group, a, b: b goes into a) as one.

    Two clusters stay a pair if all parts of the one are paired with all parts of the other.
    """
    names = cut(merges.select(group, F.col("b").alias("was"), F.col("a").alias("now")).unionByName(merges.select(group, F.col("a").alias("was"), F.col("a").alias("now"))), "renamed")
    left = names.select(group, F.col("was").alias("a"), F.col("now").alias("x"))
    right = names.select(group, F.col("was").alias("b"), F.col("now").alias("y"))
    named = pairs.join(left, [group, "a"], "left").join(right, [group, "b"], "left")
    parts = F.when(F.col("x").isNull(), 1).otherwise(2) * F.when(F.col("y").isNull(), 1).otherwise(2)
    named = named.select(group, F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "key", parts.alias("parts")).where("x <> y")
    ends = named.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "key", "parts")
    return ends.groupBy(group, "a", "b").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts")).where("n = parts").drop("n", "parts")


def _finished(group: str):
    """Greedy merging of the cluster pairs that are left, best first."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lost", "first", "second"])
        near, into, out = defaultdict(set), {}, []
        pairs = [((g, a), (g, b)) for g, a, b in zip(part[group], part["a"], part["b"], strict=True)]
        for x, y in pairs:
            near[x].add(y)
            near[y].add(x)

        def home(x):
            while x in into:
                x = into[x]
            return x

        for x, y in pairs:
            x, y = sorted((home(x), home(y)), key=lambda c: c[1])
            if x == y or y not in near[x]:
                continue
            both = near[x] & near[y]
            for z in near[x] | near[y]:
                near[z] -= {x, y}
                if z in both:
                    near[z].add(x)
            near[x], into[y] = both, x
            near.pop(y)
            out.append((x[0], x[1], y[1]))
        return pd.DataFrame(out, columns=[group, "a", "b"])

    return run


def complete_link(neighbours: DataFrame, least: float, group: str = "kind") -> DataFrame:
    """Clusters of ``neighbours`` (group, a, b, score, both directions) in which every pair is mutual and scores ``least`` or more.

    As if pairs were taken best first, ties by their ids, and two clusters merged at a pair between them whenever
    all their members are mutual. Merging runs in rounds: clusters merge that are each other's best. That gives the same clusters: a merge never
    makes a key smaller, as a merged cluster's key is the least of its parts', so a pair that comes first at both
    its ends stays first there until it is taken, and no other merge can part it. Once no more than LOCAL pairs are left one task takes them in order.
    A hub's pairs are aggregated before they are shuffled, and no component is gathered. Null ids and pairs of a thing with itself don't count;
    of rows that repeat a direction the best counts.
    """
    spark, kind = neighbours.sparkSession, dict(neighbours.dtypes)
    rows = neighbours.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(group, "a", "b").agg(F.max("score").alias("score"))
    back = rows.select(group, F.col("a").alias("b"), F.col("b").alias("a"), F.col("score").alias("other"))
    mutual = rows.where("a < b").join(back, [group, "a", "b"]).select(group, "a", "b", F.least("score", "other").alias("score")).where(F.col("score") >= least)
    mutual = cut(mutual, "mutual")
    pairs = mutual.select(group, "a", "b", F.struct((-F.col("score")).alias("lost"), F.col("a").alias("first"), F.col("b").alias("second")).alias("key"))
    merges = spark.createDataFrame([], f"`{group}` {kind[group]}, a {kind['a']}, b {kind['a']}")
    while (left := pairs.count()) > LOCAL:
        own = F.struct("key", "a", "b")
        ends = pairs.select(group, F.col("a").alias("end"), own.alias("pair")).unionByName(pairs.select(group, F.col("b").alias("end"), own.alias("pair")))
        best = ends.groupBy(group, "end").agg(F.min("pair").alias("pair"))
        taken = cut(best.groupBy(group, "pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(group, "pair.a", "pair.b"), "taken")
        merges = merges.unionByName(taken)
        pairs = cut(_contracted(pairs, taken, group), "pairs")
    if left:
        flat = pairs.select(group, "a", "b", "key.*").withColumn("all", F.lit(1))
        merges = merges.unionByName(flat.groupBy("all").applyInPandas(_finished(group), merges.schema))
    merges = cut(merges, "merges")
    # within a group an id goes into another once, so chains of merges end in the cluster's least id
    key = F.struct(group, "b")
    homes = resolve_merges(merges.select(key.alias("id"), F.struct(F.col(group), F.col("a").alias("b")).alias("into")))
    homes = homes.select(F.col(f"id.{group}").alias(group), F.col("id.b").alias("member"), F.col("final.b").alias("cluster"))
    members = cut(homes.unionByName(homes.select(group, F.col("cluster").alias("member"), "cluster").distinct()), "members")
    ends = [members.select(group, F.col("member").alias(c), F.col("cluster").alias(f"of_{c}")) for c in ("a", "b")]
    within = mutual.join(ends[0], [group, "a"]).join(ends[1], [group, "b"]).where("of_a = of_b").groupBy(group, F.col("of_a").alias("cluster")).agg(F.min("score").alias("score"))
    listed = members.groupBy(group, "cluster").agg(F.array_sort(F.collect_list("member")).alias("members"))  # all pairs are rows, so a cluster of n has n * (n - 1) / 2 of them
    return listed.join(within, [group, "cluster"]).select(group, "members", "score")


def _finished_line(group: str, width: int):
    """Greedy joining over the gaps that are left, least first; gaps are (group, lo, hi, next_lo, next_hi, key)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lost", "first", "second"])
        last, first, out = {}, {}, []  # ends of joined intervals: the greatest place by the least, and back
        for g, lo, hi, next_lo, next_hi in part[[group, "lo", "hi", "next_lo", "next_hi"]].itertuples(index=False):
            left, right = first.get((g, hi), lo), last.get((g, next_lo), next_hi)
            if right - left <= width:
                last[g, left], first[g, right] = right, left
                out.append((g, next_lo))
        return pd.DataFrame(out, columns=[group, "lo"])

    return run


def complete_link_line(points: DataFrame, width: int, group: str = "kind") -> DataFrame:
    """:func:`complete_link` of ``points`` (group, id, place) that are mutual if at most ``width`` apart, nearest first: (group, members, least, greatest).

    No pair is made. A point between two others is nearer to both than they are to each other, so when the two meet, what lies
    between has met one of them or was refused, and then the two are refused too: clusters are intervals, and a gap between
    neighbouring places is decided once, by its length and the least ids on its sides. Gaps are closed in rounds,
    those that come first on both sides together; once no more than LOCAL may be closed one task takes them in order.
    Points of one place are one interval at the start. Places are whole numbers; null groups, ids and places take no part.
    """
    kind = dict(points.dtypes)
    points = cut(points.where(F.col(group).isNotNull() & F.col("id").isNotNull() & F.col("place").isNotNull()).select(group, "id", F.col("place").cast("long").alias("place")), "points")
    in_line = Window.partitionBy(group).orderBy("lo")
    after = lambda c: F.lead(c).over(in_line)
    gap = F.struct((after("lo") - F.col("hi")).alias("lost"), F.least("hi_id", after("lo_id")).alias("first"), F.greatest("hi_id", after("lo_id")).alias("second"), F.col("lo").alias("at"))
    line = points.groupBy(group, F.col("place").alias("lo")).agg(F.min("id").alias("lo_id")).select(group, "lo", F.col("lo").alias("hi"), "lo_id", F.col("lo_id").alias("hi_id"))
    while True:
        line = cut(line.withColumn("key", F.when(after("hi") - F.col("lo") <= width, gap)).select("*", after("lo").alias("next_lo"), after("hi").alias("next_hi")), "line")
        open_ = line.where("key IS NOT NULL")
        if (left := open_.count()) <= LOCAL:
            break
        before, behind = F.lag("key").over(in_line), after("key")
        taken = F.col("key").isNotNull() & (before.isNull() | (F.col("key") < before)) & (behind.isNull() | (F.col("key") < behind))
        at = line.withColumn("taken", taken).withColumn("at", F.when(F.lag("taken").over(in_line), F.lag("lo").over(in_line)).otherwise(F.col("lo")))
        line = at.groupBy(group, "at").agg(F.max("hi").alias("hi"), F.min_by("lo_id", "lo").alias("lo_id"), F.max_by("hi_id", "lo").alias("hi_id")).withColumnRenamed("at", "lo")
    starts = line.select(group, "lo")
    if left:
        flat = open_.select(group, "lo", "hi", "next_lo", "next_hi", "key.*").withColumn("all", F.lit(1))
        closed = flat.groupBy("all").applyInPandas(_finished_line(group, width), f"`{group}` {kind[group]}, lo long")
        starts = starts.join(cut(closed, "closed"), [group, "lo"], "left_anti")
    marked = points.select(group, "place", "id").unionByName(starts.select(group, F.col("lo").alias("place"), F.lit(None).cast(kind["id"]).alias("id")))
    start = F.last(F.when(F.col("id").isNull(), F.col("place")), True).over(Window.partitionBy(group).orderBy("place", F.col("id").asc_nulls_first()))
    found = marked.withColumn("start", start).where("id IS NOT NULL").groupBy(group, "start")
    listed = found.agg(F.array_sort(F.collect_set("id")).alias("members"), F.min("place").alias("least"), F.max("place").alias("greatest"))
    return listed.where(F.size("members") > 1).select(group, "members", "least", "greatest")
