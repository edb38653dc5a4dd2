"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import ann, audit, bpe, chat, html, infill, licenses, minhash, mixing, token_counts, toxicity, vector_dedup, warc
from siltstone.llm.tokens import public_path


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat.window_digests(chat.chat_windows(turns.union(odd), public_path("byte_bpe_50k.json")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("word_bpe_49k.json")
    coded = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size(F.array_distinct(F.col("licenses.license"))).cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("licenses"),
        F.round(F.array_max(F.col("licenses.dice")), 6).alias("best_dice"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    output, form = F.col("output"), F.col("form")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(output).alias("output_sha256"), sha(infill.restored(output, form)).alias("restored_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann_search,
        op2_minhash_near_dedup,
        op3_chat_format,
        op4_source_mixing,
        op5_bpe_codec,
        op6_vector_dedup,
        op7_html_main_text,
        op8_license_scan,
        op9_token_counts,
        op10_toxicity,
        op11_filter_audit,
        op12_fill_in_middle,
        op13_warc,
    )
}

def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = licenses.template_pairs(licenses.TEMPLATES)
    listed = lambda p: f"[{', '.join(map(quoted, p))}]"
    templates = ", ".join(f"({quoted(n)}, {listed(p)})" for n, p in known)
    opening = ", ".join(f"({quoted(known[t][0])}, {listed(known[t][1])}, {quoted(a)}, {quoted(b)}, {at}, {n})" for t, a, b, at, n in licenses.anchors(licenses.TEMPLATES))
    most = int(max(len(p) for _, p in known) * (2 - licenses.DICE) / licenses.DICE)
    dotted = "regexp_replace(regexp_replace(s, '([0-9])\\.([0-9])', '\\1·\\2', 'g'), '([0-9])\\.([0-9])', '\\1·\\2', 'g')"
    pairs = lambda w: f"CASE WHEN len({w}) > 1 THEN list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])) ELSE {w} END"
    return f"""
        WITH t(name, pairs) AS (VALUES {templates}), g(name, pairs, a, b, place, n) AS (VALUES {opening}),
        u AS (SELECT row_number() OVER () AS row, doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS parts FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        x AS (SELECT row, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS line FROM u UNION ALL SELECT row, doc_id, text, 0 FROM u WHERE len(parts) > 1),
        w AS (SELECT row, doc_id, line, string_split(trim(regexp_replace(lower({dotted}), '[^\\p{{L}}\\p{{N}}·]+', ' ', 'g')), ' ') AS words FROM x),
        p AS (SELECT row, doc_id, line, {pairs('words')} AS pairs FROM w WHERE words[1] <> ''),
        m AS (SELECT row, doc_id, line, name, max(2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs))) AS d FROM p CROSS JOIN t WHERE len(p.pairs) <= {most} GROUP BY ALL),
        k AS (SELECT row, doc_id, words, len(words) AS size FROM w WHERE words[1] <> '' AND (line = 0 OR row IN (SELECT row FROM u WHERE len(parts) = 1))),
        o AS (SELECT row, doc_id, words, size, g.name, g.pairs, place, n, unnest(list_filter(range(1, size), lambda i: words[i] = a AND words[i + 1] = b)) AS i FROM k JOIN g ON contains(' ' || array_to_string(words, ' ') || ' ', ' ' || a || ' ' || b || ' ')),
        c AS (SELECT row, doc_id, name, pairs AS theirs, list_slice(words, greatest(i - place, 1), least(i - place + n - 1, size)) AS own FROM o),
        z AS (SELECT row, doc_id, name, theirs, {pairs('own')} AS mine FROM c),
        v AS (SELECT row, doc_id, name, max(2.0::DOUBLE * len(list_intersect(mine, theirs)) / (len(mine) + len(theirs))) AS d FROM z GROUP BY ALL),
        b AS (SELECT row, doc_id, name, d FROM m WHERE d >= {licenses.DICE} UNION ALL SELECT row, doc_id, name, d FROM v WHERE d >= {licenses.DICE}),
        f AS (SELECT row, count(DISTINCT name) AS n_found, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, round(max(d), 6) AS best_dice FROM b GROUP BY row)
        SELECT u.doc_id, CAST(len(parts) AS BIGINT) AS n_lines, coalesce(n_found, 0) AS n_found, coalesce(licenses, '') AS licenses, best_dice FROM u LEFT JOIN f USING (row)"""


#: DuckDB SQL of the queries that SQL expresses at whole-table size.
ORACLE_SQL: dict[str, str] = {
    "op6_vector_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
        c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op8_license_scan": _license_sql(),
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        r(s) AS (SELECT '' UNION ALL SELECT s || c FROM r, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(s, c)),
        o AS (SELECT s AS filter_order, step, substr(s, step, 1) AS own, substr(s, 1, step - 1) AS prior FROM r, range(1, 6) g(step) WHERE length(s) = 5),
        e AS (SELECT *, translate(prior, fails, '') = prior AS here, contains(fails, own) AS bad FROM m, o),
        x AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(coalesce(sum(n) FILTER (here AND NOT bad), 0) AS BIGINT) AS kept,
            CAST(coalesce(sum(n) FILTER (here AND bad), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (bad AND NOT here), 0) AS BIGINT) AS redundant,
            CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (here AND bad), 0) AS BIGINT) AS good_lost,
            CAST(coalesce(sum(toxic) FILTER (here AND bad), 0) AS BIGINT) AS toxic_lost FROM e GROUP BY part, filter_order, step, own)
        SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS g FROM d),
        c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
            CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
        x AS (SELECT *, array_to_string(u[1:a], '') AS p, CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS m, CASE WHEN n > b THEN array_to_string(u[b + 1:], '') ELSE '' END AS s FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x""",
    "op13_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to FROM q""",
}
