"""Recommendation answers: routes, filters, recall, explanations, evidence, validated claims, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.budget import each_within_tokens, tokens, version, within_tokens
from siltstone.functions.text import folded, nfkc, normal_lines

#: Intents, keys of a match analysis, time models, limits of labels and titles, and what labels mustn't be.
RECOMMEND_INTENTS = ["new_search", "more_mentors", "same_field", "refine_direction"]
DETAIL_INTENT = "detail_followup"
MATCH_DIMENSIONS = ["research_fit", "method_match", "location_fit", "degree_goal", "publication_activity"]
TIME_MODELS = {"eventWindow": "competition_window", "submission": "submission_deadline"}
TITLE_CHARS, LABEL_CHARS, LABELS = 32, 8, 4
TEMPLATES = {"baseline-v1": (2048, 1024, 768), "research-heavy-v1": (2560, 768, 512)}
PROFILE_LINES = [("学校", "school", 64), ("学院", "org", 128), ("职称", "title", 64), ("研究方向原文", "research", 0), ("规范主题", "topics", 768), ("代表成果", "publications", 1), ("简介", "bio", 2)]
NO_DIRECTION = "未找到与查询方向直接对应的研究证据，仅作为语义近邻参考"
NO_DETAIL = "综合匹配信号较高；当前缺少可回溯详情证据"
AWARDS = ["特等奖", "一等奖", "二等奖", "三等奖", "金牌", "银牌", "铜牌", "优秀奖", "获奖"]
LEVEL_WORDS = [("国际级", "国际"), ("国家级", "国家级|国家|国赛"), ("省级", "省级|省赛"), ("校级", "校级|校赛")]

_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def routed(requests: DataFrame) -> DataFrame:
    """``requests`` (intent, anchor, prior array) with route, excluded, anchor_used, merges and issue.

    An unknown intent falls back to a new search with an issue; more of the same needs prior results, the
    same field and details need an anchor.
    """
    asked = F.coalesce("intent", F.lit("new_search"))
    known = asked.isin([*RECOMMEND_INTENTS, DETAIL_INTENT])
    route = F.when(known, asked).otherwise("new_search")
    prior, anchor = F.coalesce("prior", _none()), F.nullif(F.col("anchor"), F.lit(""))
    issue = (
        F.when(~known, "invalid_intent").when((asked == DETAIL_INTENT) & anchor.isNull(), "detail_followup_requires_anchor")
        .when((asked == "more_mentors") & (F.size(prior) == 0), "more_mentors_requires_prior").when((asked == "same_field") & anchor.isNull(), "same_field_requires_anchor")
    )
    return requests.select(
        "*", route.alias("route"), F.when(route == "more_mentors", prior).otherwise(_none()).alias("excluded"), F.when(route.isin("same_field", DETAIL_INTENT), anchor).alias("anchor_used"), (route == "refine_direction").alias("merges"), issue.alias("issue")
    )


def effective_cities(explicit: Column, inferred: Column, route: Column) -> Column:
    """Cities to filter by: those asked for; else, in a new or refined search, those read from the question."""
    return F.when(F.size(F.coalesce(explicit, _none())) > 0, explicit).when(route.isin("new_search", "refine_direction"), F.coalesce(inferred, _none())).otherwise(_none())


def merged_context(current: Column, stored: Column) -> Column:
    """Ids of earlier results, those of the present turn first, each once in order."""
    return F.array_distinct(F.concat(F.coalesce(current, _none()), F.coalesce(stored, _none())))


def matched_by(items: Column, terms: Column) -> Column:
    """Items that hold one of the terms, case aside."""
    return F.filter(F.coalesce(items, _none()), lambda x: F.exists(terms, lambda t: F.contains(F.lower(x), F.lower(t))))


def explained(rows: DataFrame) -> DataFrame:
    """``rows`` with matched topics, statements, publications, the reasons to show, and whether they are weak and why.

    ``rows``: terms, topics, statements, publications, refs, source_urls (arrays), summary, score, direction, has_detail.
    """
    terms = F.filter("terms", lambda t: t != "")
    topics, statements, publications = (matched_by(F.col(c), terms) for c in ("topics", "statements", "publications"))
    summary = F.exists(terms, lambda t: F.contains(F.lower("summary"), F.lower(t)))
    rows = rows.select("*", topics.alias("_t"), statements.alias("_s"), publications.alias("_p"), F.coalesce(summary, F.lit(False)).alias("_m"), ((F.size(terms) > 0) & (F.col("direction") <= 0)).alias("_no"))
    yes = ~F.col("_no")
    first = lambda c: F.substring(F.get(c, F.lit(0)), 1, 60)
    reasons = [
        F.when(F.col("_no"), NO_DIRECTION).when(F.size("_t") > 0, F.concat(F.lit("研究方向匹配: "), F.array_join(F.slice("_t", 1, 3), ", "))),
        F.when(yes & (F.size("_s") > 0), F.concat(F.lit("研究陈述命中: "), first("_s"))),
        F.when(yes & F.col("_m") & (F.size("_t") == 0) & (F.size("_s") == 0), F.concat(F.lit("研究摘要命中: "), F.substring("summary", 1, 60))),
        F.when(yes & (F.size("_p") > 0), F.concat(F.lit("代表成果命中: "), first("_p"))),
    ]
    said = F.array_compact(F.array(*reasons))
    fallback = F.array(F.concat(F.lit("语义召回匹配，未找到精确方向证据 (score="), F.format_string("%.2f", F.col("score")), F.lit(")")))
    refs = F.when(F.size("refs") > 0, F.col("refs")).otherwise(F.slice("source_urls", 1, 5))
    weak = F.col("_no") | (F.size(refs) == 0)
    missing = F.when(F.col("_no"), "no direct direction evidence for query terms").when(weak, "no provenance or source URLs")
    there = F.col("has_detail")
    or_none = lambda c: F.when(there, c).otherwise(_none())
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")], F.when(there, F.when(F.size(said) > 0, said).otherwise(fallback)).otherwise(F.array(F.lit(NO_DETAIL))).alias("reasons"), or_none(F.col("_t")).alias("matched_topics"),
        or_none(F.col("_s")).alias("matched_statements"), or_none(F.col("_p")).alias("matched_publications"), or_none(refs).alias("evidence"), F.when(there, weak).otherwise(True).alias("weak"), F.when(there, missing).otherwise("ProfessorDetail unavailable in ACTIVE build").alias("missing_reason"),
    )


def source_match(refs: DataFrame, hits: DataFrame) -> DataFrame:
    """(card_id, source_score): summed scores of the hits that a card's references (card_id, chunk_hash) name, over those of all hits.

    ``hits`` (chunk_hash, score) is a ranked list of a query, a few rows.
    """
    least = F.greatest(F.sum(F.greatest("score", F.lit(0.0))), F.lit(1.0))
    total = hits.agg(F.coalesce(least, F.lit(1.0)).alias("total"))
    met = refs.join(hits, "chunk_hash").groupBy("card_id").agg(F.sum("score").alias("met"))
    return met.crossJoin(F.broadcast(total)).select("card_id", F.least(F.col("met") / F.col("total"), F.lit(1.0)).alias("source_score"))


def recalled(cards: DataFrame, scores: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """The best ``k`` of ``cards`` (card_id, name, blob): the greater of source score and share of terms; if none scores, all at 0.05."""
    text = folded(F.col("blob"))
    met = sum((F.contains(text, F.lit(t.casefold())).cast("int") for t in terms), F.lit(0))
    lexical = met / max(len(terms), 1) if terms else F.lit(0.0)
    scored = cards.join(scores, "card_id", "left").withColumn("score", F.greatest(F.coalesce("source_score", F.lit(0.0)), lexical))
    some = scored.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_most"))
    kept = scored.crossJoin(F.broadcast(some)).where("score > 0 OR _most <= 0").withColumn("score", F.when(F.col("_most") <= 0, 0.05).otherwise(F.col("score")))
    return kept.select("card_id", "name", "score").orderBy(F.desc("score"), "name", "card_id").limit(k)


def category(text: Column, keywords: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The first category one of whose keywords a text holds, case folded."""
    low, out = folded(text), F.lit(otherwise)
    for name, words in reversed(keywords):
        out = F.when(_holds(low, words), name).otherwise(out)
    return out


def _holds(low: Column, words: Sequence[str]) -> Column:
    """Whether a case-folded text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.casefold()))
    return out


def first_with_keyword(chunks: DataFrame, key: str, order: str, keywords: Sequence[str], most: int = 500) -> DataFrame:
    """(key, text): of each key's chunks the first that holds a keyword, its beginning."""
    met = chunks.withColumn("_low", folded(F.col("text"))).where(_holds(F.col("_low"), keywords))
    return met.groupBy(key).agg(F.min_by("text", order).alias("text")).select(key, F.trim(F.substring("text", 1, most)).alias("text"))


def competition_name(name: Column) -> Column:
    """NFKC, white space collapsed, ASCII letters in lower case and no others."""
    clean = F.trim(F.regexp_replace(nfkc(name), r"(?U)\s+", " "))
    return F.translate(clean, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def card_evidence(refs: Column, statuses: Column) -> Column:
    """grounded, partial or uncertain, by a card's references and the statuses of its fields."""
    return F.when(F.size(refs) == 0, "uncertain").when(F.arrays_overlap(statuses, F.array(F.lit("conflict"), F.lit("uncertain"))), "partial").otherwise("grounded")


def freshness(notices: Column, dated: Column, standing: str) -> Column:
    """Notices of fields that age, each once; else the standing one where a card has such fields."""
    own = F.array_distinct(F.filter(notices, lambda n: n.isNotNull() & (n != "")))
    return F.when(F.size(own) > 0, F.array_join(own, "；")).when(dated, standing)


def merged_bundles(bundles: DataFrame, key: str, order: str) -> DataFrame:
    """Facts of all bundles (key, facts, refs) of a subject in order, and their references, each once."""
    parts = F.array_sort(F.collect_list(F.struct(order, "facts", "refs")))
    rows = bundles.groupBy(key).agg(parts.alias("parts"))
    return rows.select(key, F.flatten(F.transform("parts", lambda x: x["facts"])).alias("facts"), F.array_distinct(F.flatten(F.transform("parts", lambda x: x["refs"]))).alias("refs"))


def supported(claims: DataFrame, facts: DataFrame, drop: bool) -> DataFrame:
    """``claims`` (claim_id, subject_id, kind, indices array) with the references of the facts (subject_id, ordinal, ref) that they name.

    A negative or unknown index leaves a claim without any. A fact without references becomes uncertain, or goes if
    ``drop``; uncertain claims carry none.
    """
    named = claims.select("claim_id", "subject_id", F.explode("indices").alias("ordinal")).distinct()
    met = named.join(facts, ["subject_id", "ordinal"], "left").groupBy("claim_id").agg(F.bool_or(F.col("ref").isNull()).alias("bad"), F.array_sort(F.collect_set("ref")).alias("found"))
    refs = F.when(F.coalesce("bad", F.lit(True)), _none()).otherwise(F.col("found"))
    rows = claims.join(met, "claim_id", "left").withColumn("refs", F.when(F.col("kind") == "uncertain", _none()).otherwise(refs))
    bare = (F.col("kind") == "fact") & (F.size("refs") == 0)
    if drop:
        return rows.where(~bare).drop("bad", "found")
    return rows.withColumn("kind", F.when(bare, "uncertain").otherwise(F.col("kind"))).drop("bad", "found")


def dimension_scores(json: Column) -> Column:
    """Scores of a match analysis; null unless it has exactly the expected keys and every value is a number."""
    raw = F.from_json(json, "map<string,string>")
    kinds = F.forall(F.array(*[F.lit(k) for k in MATCH_DIMENSIONS]), lambda k: F.try_element_at(raw, k).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    quoted = json.rlike(r':\s*"')
    ok = (F.array_sort(F.map_keys(raw)) == F.array(*map(F.lit, sorted(MATCH_DIMENSIONS)))) & kinds & ~quoted
    return F.when(ok, F.transform_values(raw, lambda k, v: v.try_cast("double")))


def valid_context(gpa: Column, rank: Column, completeness: Column, gpas: Sequence[str], ranks: Sequence[str]) -> Column:
    """Why a student's context isn't valid; null if it is."""
    return F.when(gpa.isNotNull() & ~gpa.isin(list(gpas)), "gpa_bucket").when(rank.isNotNull() & ~rank.isin(list(ranks)), "rank_bucket").when((completeness < 0) | (completeness > 1) | F.isnan(completeness), "profile_completeness")


def evidenced(span: Column, source: Column) -> Column:
    """Whether a span stands in its source, both under NFKC; null or empty spans don't."""
    return F.coalesce(F.contains(nfkc(source), nfkc(span)) & (span != ""), F.lit(False))


def title(text: Column) -> Column:
    """A conversation's title: white space collapsed, the first characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, TITLE_CHARS)


def quick_labels(labels: Column, question_starts: Sequence[str], question_ends: Sequence[str]) -> Column:
    """The first labels that are short and no questions, each once."""
    fine = lambda x: (x != "") & (F.length(x) <= LABEL_CHARS) & ~x.rlike("[?？]")
    asks = lambda x: F.exists(F.array(*map(F.lit, question_starts)), lambda p: F.startswith(x, p)) | F.exists(F.array(*map(F.lit, question_ends)), lambda p: F.endswith(x, p))
    return F.slice(F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: fine(x) & ~asks(x))), 1, LABELS)


def time_model(timeline: Column) -> Column:
    out = F.lit(None).cast("string")
    for public, own in TIME_MODELS.items():
        out = F.when(timeline == public, own).otherwise(out)
    return out


def achievement(text: Column) -> Column:
    """Award, year and level that a sentence names, each empty where it names none."""
    award = F.lit("")
    for a in reversed(AWARDS):
        award = F.when(F.contains(text, F.lit(a)), a).otherwise(award)
    level = F.lit("")
    for name, words in reversed(LEVEL_WORDS):
        level = F.when(text.rlike(words), name).otherwise(level)
    return F.struct(award.alias("award"), F.regexp_extract(text, r"((?:19|20)\d{2})", 1).alias("year"), level.alias("level"))


def plan_issues(time_models: Column, target: Column, defense: Column, event: Column, tasks: Column, mandatory: Column) -> Column:
    """What a preparation plan lacks, in order: dates of its phases by its time model, then its tasks."""
    late = (time_models == "submission_deadline") & F.when(defense.isNull(), True).otherwise(F.coalesce(defense <= target, F.lit(False)))
    off = (time_models == "competition_window") & F.when(event.isNull(), True).otherwise(F.coalesce(event != target, F.lit(False)))
    which = lambda c, missing, wrong: F.when(c.isNull(), missing).otherwise(wrong)
    return F.array_compact(
        F.array(
            F.when(late, which(defense, "submission plan requires defense_prep", "defense_prep must start after submission")),
            F.when(off, which(event, "competition window plan requires event_sprint", "event_sprint must start at the event window")),
            F.when((tasks == 0) | (mandatory < tasks), "required task collection is invalid"),
        )
    )


def filtered_competitions(rows: DataFrame, categories: Sequence[str], team: str | None) -> DataFrame:
    """Competitions of the categories asked for; solo or team is compared only where both sides say so."""
    wanted = [c.strip() for c in categories if c.strip()]
    kept = rows.where(F.col("category").isin(wanted)) if wanted else rows
    return kept.where(~F.col("team_policy").isin("solo", "team") | (F.col("team_policy") == team)) if team in ("solo", "team") else kept


def routing_rates(samples: DataFrame) -> DataFrame:
    """passed, total and rate of implicit and of explicit ``samples`` (source, predicted, expected, actual_kind, expected_kind)."""
    right = F.col("predicted").eqNullSafe(F.col("expected")) & F.col("actual_kind").eqNullSafe(F.col("expected_kind"))
    counts = samples.groupBy("source").agg(F.count_if(right).alias("passed"), F.count(F.lit(1)).alias("total"))
    both = samples.sparkSession.createDataFrame([("implicit",), ("explicit",)], "source string").join(F.broadcast(counts), "source", "left")
    passed, total = F.coalesce("passed", F.lit(0)), F.coalesce("total", F.lit(0))
    return both.select("source", passed.alias("passed"), total.alias("total"), F.coalesce(F.try_divide(passed, total), F.lit(0.0)).alias("rate"))


def findings_page(findings: DataFrame, limit: int = 100) -> DataFrame:
    """Open findings by severity downwards, code and id, 1 to 500 of them."""
    return findings.where("NOT resolved").orderBy(F.desc("severity"), "code", "id").limit(max(1, min(limit, 500)))


def any_observation(observations: DataFrame, entity: str, observation: str) -> DataFrame:
    """One row of each entity: that of its least observation, since some order has to choose."""
    return observations.groupBy(entity).agg(F.min_by(F.struct("*"), observation).alias("_row")).select("_row.*")


def protection_reasons(builds: DataFrame, protections: DataFrame, findings: DataFrame, observations: DataFrame) -> DataFrame:
    """(snapshot_id, kind, reference_id): why a snapshot must stay.

    Builds (snapshot_id, build_id, status) that are ready or active; ``protections`` (snapshot_id, kind, reference_id), those of a finding
    only while it is open; open ``findings`` (finding_id, observation_id, resolved) of its ``observations`` (snapshot_id, observation_id).
    """
    own = builds.where(F.col("status").isin("READY", "ACTIVE")).select("snapshot_id", F.concat(F.lit("build:"), F.lower("status")).alias("kind"), F.col("build_id").alias("reference_id"))
    open_ = findings.where("NOT resolved").select(F.col("finding_id").alias("reference_id"), "observation_id")
    other = protections.where("kind <> 'unresolved_finding'")
    held = protections.where("kind = 'unresolved_finding'").join(open_.select("reference_id"), "reference_id", "left_semi").select("snapshot_id", "kind", "reference_id")
    found = open_.join(observations, "observation_id").select("snapshot_id", F.lit("unresolved_finding").alias("kind"), "reference_id")
    return own.unionByName(other.select("snapshot_id", "kind", "reference_id")).unionByName(held).unionByName(found).distinct()


def semantic_profile(rows: DataFrame, template: str = "baseline-v1", most: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """entity_id, profile, profile_hash, n_tokens of ``rows``: labelled lines, each field and then the whole within a token budget.

    ``rows``: entity_id, school, org, title, bio, and arrays statements, topics, publications. Tokens are those of the file ``tokenizer`` of the tokenizers
    library, whose digest is then part of the hash; without one a token is a run without white space, which cuts no Chinese text.
    """
    research, publications, bio = TEMPLATES[template]
    budgets = {"school": 64, "org": 128, "title": 64, "research": research, "topics": 768, "publications": publications, "bio": bio}
    whole = lambda c: F.split(nfkc(F.array_join(F.coalesce(c, _none()), "\x01")), "\x01")  # noqa: E731  # one text for the UDF, which can't stand inside array functions
    joined = lambda c: F.array_join(F.filter(F.transform(whole(c), lambda x: normal_lines(x)), lambda x: x != ""), "\n")
    texts = {"school": F.col("school"), "org": F.col("org"), "title": F.col("title"), "research": joined(F.col("statements")), "topics": joined(F.col("topics")), "publications": joined(F.col("publications")), "bio": F.col("bio")}

    def within(text: Column, budget: int) -> Column:
        if tokenizer:
            return F.trim(within_tokens(normal_lines(F.coalesce(text, F.lit(""))), budget, tokenizer))
        # possessive groups are matched in a loop; greedy ones take a stack frame a token, which some thousand tokens exhaust
        return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?Us)^\s*+((?:\S++\s*+){{0,{budget}}}+)", 1))

    if tokenizer:
        cut = each_within_tokens([normal_lines(F.coalesce(t, F.lit(""))) for t in texts.values()], [budgets[c] for c in texts], tokenizer)
        rows = rows.select("entity_id", cut.alias("cut"))
        fields = {c: F.trim(F.col("cut")[i]) for i, c in enumerate(texts)}
    else:
        fields = {c: within(t, budgets[c]) for c, t in texts.items()}
    lines = [F.when(fields[c] != "", F.concat(F.lit(f"{label}："), fields[c])) for label, c, _ in PROFILE_LINES]
    profile = normal_lines(within(F.concat_ws("\n", *lines), most))
    out = rows.select("entity_id", profile.alias("profile"))
    by = f"{template}\n{version(tokenizer)}\n" if tokenizer else f"{template}\n"
    digest = F.sha2(F.concat(F.lit(by), F.col("profile")).cast("binary"), 256)
    n = tokens(F.col("profile"), tokenizer) if tokenizer else F.size(F.regexp_extract_all("profile", F.lit(r"(?U)\S+"), 0)).cast("long")
    return out.select("entity_id", "profile", digest.alias("profile_hash"), n.alias("n_tokens"))


def detail(entities: DataFrame, statements: DataFrame, publications: DataFrame, links: DataFrame, key: str = "entity_id") -> DataFrame:
    """``entities`` with what is shown of them: statements and publications (key, ordinal, text) in order, and sources (key, url), each once."""
    listed = lambda df, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias(name))
    sources = links.groupBy(key).agg(F.array_sort(F.collect_set("url")).alias("sources"))
    out = entities.join(listed(statements, "statements"), key, "left").join(listed(publications, "publications"), key, "left").join(sources, key, "left")
    return out.select(*entities.columns, *[F.coalesce(c, _none()).alias(c) for c in ("statements", "publications", "sources")])
