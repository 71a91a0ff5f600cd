"""Queries over pages, parse quality, corpus checks and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.core import pin
from quire.functions.html import html_decision, low_text_ratio, read_page
from quire.functions.markdown import morphology
from quire.operators import annotation as A
from quire.operators import corpus as C
from quire.operators import quality as Q
from quire.operators.signatures import manifest, manifest_diff
from quire.plans.common import MARKDOWN, markdown_docs, registry, table
from quire.operators.search import dense_topk
from quire.plans.retrieval import DOT, embeddings, neighbours, neighbours_sql
from quire.session import materialize, spread

QUERIES, ORACLES, query = registry()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "page", read_page(F.col("html"))).drop("html")


# The pages hold one h1 per article, no table, pre or image; a control character marks where tags were.
UNESCAPE = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
PAGE_SQL = f"""a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(nav|aside|footer|script|style|header|form|noscript)\\b.*?</(nav|aside|footer|script|style|header|form|noscript)>', chr(1), 'g') AS h FROM pages),
 b AS (SELECT page_id, h, regexp_replace(regexp_replace(h, '<h1>', chr(1) || '# ', 'g'), '<[^>]*>', chr(1), 'g') AS t FROM a),
 c AS (SELECT page_id, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS ti,
   list_filter(list_transform(string_split(regexp_replace(h, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS strings,
   list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(h, '(?s)<body[^>]*>(.*)', 1), '<h1>', chr(1) || '# ', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '' AND x <> '#') AS blocks,
   len(regexp_extract_all(h, '<[a-zA-Z]')) AS tags FROM a)"""


@query(
    "html_extract",
    f"""WITH {PAGE_SQL} SELECT page_id, trim({UNESCAPE.format(x='ti')}) AS title, len(blocks) AS n_blocks, sha256({UNESCAPE.format(x="array_to_string(blocks, chr(10) || chr(10))")}) AS digest FROM c""",
)
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select(
        "page_id",
        "page.title",
        F.size(F.split("page.markdown", "\n\n", -1)).alias("n_blocks"),
        F.sha2("page.markdown", 256).alias("digest"),
    )


@query(
    "html_precheck",
    f"""WITH {PAGE_SQL}, d AS (SELECT page_id, length({UNESCAPE.format(x="array_to_string(strings, ' ')")}) AS text_chars, tags FROM c)
    SELECT page_id, text_chars, tags AS tag_count, CASE WHEN text_chars >= 100 THEN 'html_text' ELSE 'skip' END AS decision, text_chars / tags < 10 AS low_ratio FROM d""",
)
def html_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select(
        "page_id", "page.text_chars", "page.tag_count", html_decision(F.col("page")).alias("decision"), low_text_ratio(F.col("page")).alias("low_ratio")
    )


# A "parsed" text: the Markdown form with its first heading lost, blanks doubled and every x removed.
PARSED = "replace(replace(replace(md, '# code', 'code'), ' ', '  '), 'au', '')"


def parsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pin(markdown_docs(spark, sf_dir), "gold", F.col("md"))
    return pin(docs, "parsed", F.expr(PARSED)).select("doc_id", "lang", "source", "parsed", "gold")


def _grams(col: str) -> str:
    return f"list_distinct(list_transform(range(1, length({col})), lambda i: {col}[i:i + 1]))"


FID_SQL = f"""md AS (SELECT doc_id, lang, {MARKDOWN} AS md FROM documents), pr AS (SELECT doc_id, lang, md, {PARSED} AS ps FROM md),
 sq AS (SELECT doc_id, lang, md, ps, trim(regexp_replace(ps, '\\s+', ' ', 'g')) AS p, trim(regexp_replace(md, '\\s+', ' ', 'g')) AS g FROM pr),
 ch AS (SELECT doc_id, string_split(p, '') AS pc, string_split(g, '') AS gc FROM sq),
 pg AS (SELECT DISTINCT doc_id, a || b AS t FROM (SELECT doc_id, unnest(pc[:-2]) AS a, unnest(pc[2:]) AS b FROM ch)),
 gg AS (SELECT DISTINCT doc_id, a || b AS t FROM (SELECT doc_id, unnest(gc[:-2]) AS a, unnest(gc[2:]) AS b FROM ch)),
 cn AS (SELECT doc_id, count(*) AS c FROM pg JOIN gg USING (doc_id, t) GROUP BY doc_id),
 np AS (SELECT doc_id, count(*) AS c FROM pg GROUP BY doc_id), ng AS (SELECT doc_id, count(*) AS c FROM gg GROUP BY doc_id),
 fx AS (SELECT sq.doc_id, sq.lang, cn.c / ng.c AS text_recall, cn.c / np.c AS text_precision FROM sq JOIN cn USING (doc_id) JOIN np ON np.doc_id = sq.doc_id JOIN ng ON ng.doc_id = sq.doc_id)"""


@query(
    "ngram_fidelity",
    f"WITH {FID_SQL} SELECT doc_id, round(text_recall, 6) AS text_recall, round(text_precision, 6) AS text_precision FROM fx",
)
def ngram_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.text_fidelity(parsed_pairs(spark, sf_dir))
    return rows.select("doc_id", F.round("text_recall", 6).alias("text_recall"), F.round("text_precision", 6).alias("text_precision"))


@query("fidelity_report")
def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.fidelity(parsed_pairs(spark, sf_dir)).withColumn("morphology", morphology(F.col("gold")))
    out = Q.fidelity_report(rows.withColumn("format", F.col("lang")))
    return out.select("format", "morphology", "samples", *[F.round(m, 6).alias(m) for m in Q.FIDELITY])


@query(
    "parse_quality",
    f"""WITH md AS (SELECT doc_id, lang, {MARKDOWN} AS md FROM documents)
    SELECT doc_id, CASE lang WHEN 'fr' THEN ['table_loss', 'heading_discontinuous'] WHEN 'es' THEN CASE WHEN length(md) > 1500 THEN ['table_loss', 'code_fence_loss'] ELSE ['table_loss'] END
      WHEN 'en' THEN ['table_loss'] ELSE ['table_loss'] END AS reasons FROM md""",
)
def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pin(markdown_docs(spark, sf_dir), "t", F.col("md"))
    fences = F.when((F.col("lang") == "es") & (F.length("t") > 1500), 3).when(F.col("lang") == "es", 1)
    return docs.select("doc_id", Q.parse_quality(F.col("t"), F.lit(2), fences).alias("reasons"))


@query(
    "parse_chain",
    f"""SELECT CASE WHEN lang = 'fr' AND length(text) > 400 THEN 'second' WHEN lang = 'fr' THEN 'none' ELSE 'first' END AS backend, count(*) AS docs FROM documents GROUP BY 1""",
)
def parse_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pin(spread(table(spark, sf_dir, "documents")).selectExpr("doc_id", "lang", "source", "text", f"{MARKDOWN} AS md"), "t", F.col("md"))
    none = F.lit(None).cast("int")
    second = F.when(F.length("text") > 400, F.col("text"))
    best = Q.first_good(
        [
            ("first", F.col("t"), Q.parse_quality(F.col("t"), none, none)),
            ("second", second, Q.parse_quality(second, none, none)),
        ]
    )
    return docs.groupBy(F.coalesce(best["backend"], F.lit("none")).alias("backend")).agg(F.count(F.lit(1)).alias("docs"))


# Turns of a conversation as pages: some end and start with a table or a list that goes on.
PAGE_TEXT = """CASE WHEN turn % 4 IN (0, 1) THEN concat(CASE WHEN turn % 4 = 0 THEN concat('para', chr(10)) ELSE '' END, '| a | b |', chr(10), '|---|---|', chr(10), '| ', role, ' | ', turn, ' |')
 WHEN turn % 4 = 2 THEN concat('tail', chr(10), turn, '. item ', role) ELSE concat(turn, '. next ', role, chr(10), 'rest of page') END"""


@query(
    "merge_pages",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, role, turn % 4 AS k, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
    SELECT conv_id AS doc_id, turn AS page, CASE WHEN rn = 1 THEN 'first' WHEN k = 1 THEN 'table' WHEN k = 3 AND prev = turn - 1 THEN 'list' ELSE 'append' END AS kind,
     CASE WHEN rn > 1 AND k = 1 THEN '| ' || role || ' | ' || turn || ' |' WHEN rn > 1 AND k = 3 AND prev = turn - 1 THEN turn || '. next ' || role
      WHEN k IN (0, 1) THEN (CASE WHEN k = 0 THEN 'para' || chr(10) ELSE '' END) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || role || ' | ' || turn || ' |'
      WHEN k = 2 THEN 'tail' || chr(10) || turn || '. item ' || role ELSE turn || '. next ' || role || chr(10) || 'rest of page' END AS kept FROM p""",
)
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn AS page", f"{PAGE_TEXT} AS text")
    return Q.merge_pages(p)


LABELS_SQL = """lb AS (SELECT CASE WHEN quality = 1 THEN 'text' WHEN toxic = 1 THEN 'vlm' ELSE 'skip' END AS gold,
 CASE WHEN n_chars > 1500 THEN 'text' WHEN n_chars > 600 THEN 'vlm' ELSE 'skip' END AS predicted FROM documents JOIN labels USING (doc_id))"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "CASE WHEN quality = 1 THEN 'text' WHEN toxic = 1 THEN 'vlm' ELSE 'skip' END AS gold",
        "CASE WHEN n_chars > 1500 THEN 'text' WHEN n_chars > 600 THEN 'vlm' ELSE 'skip' END AS predicted",
    )


@query(
    "route_confusion",
    f"""WITH {LABELS_SQL}, l AS (SELECT DISTINCT gold AS label FROM lb UNION SELECT DISTINCT predicted FROM lb),
    c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM l, lb GROUP BY label),
    m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
    SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m""",
)
def route_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.confusion(routed(spark, sf_dir))


@query(
    "route_cost",
    f"WITH {LABELS_SQL} SELECT round(avg(CASE WHEN gold = predicted THEN 1 ELSE 0 END), 4) AS accuracy, sum(CASE WHEN gold = predicted THEN 0 WHEN gold = 'text' AND predicted = 'skip' THEN 2 ELSE 1 END) AS misroute_cost FROM lb",
)
def route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.route_cost(routed(spark, sf_dir))


@query(
    "guard_shingles",
    """WITH f AS (SELECT text AS fact FROM benchmark UNION ALL SELECT substr(text, 1, 9) FROM benchmark),
    w AS (SELECT DISTINCT substr(fact, CAST(i AS BIGINT), 20) AS w FROM (SELECT fact, unnest(range(1, length(fact) - 18)) AS i FROM f WHERE length(fact) >= 20)),
    s AS (SELECT DISTINCT fact FROM f WHERE length(fact) BETWEEN 1 AND 19),
    ch AS (SELECT doc_id, substring(text, CAST(o AS BIGINT) + 1, 219) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 200)) AS o FROM documents)),
    dw AS (SELECT doc_id, substring(c, CAST(i AS BIGINT), 20) AS w FROM (SELECT doc_id, c, unnest(range(1, least(length(c) - 18, 201))) AS i FROM ch WHERE length(c) >= 20))
    SELECT DISTINCT doc_id FROM dw SEMI JOIN w USING (w) UNION SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM s WHERE contains(text, fact))""",
)
def guard_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    facts = b.select(F.col("text").alias("fact")).unionByName(b.select(F.substring("text", 1, 9).alias("fact")))
    return C.guard_hits(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), facts)


@query(
    "fuzzy_source_doc",
    """WITH k AS (SELECT url AS doc_id, page_id AS position FROM pages), w AS (SELECT page_id AS item, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'see ' || url || '!' ELSE substr(url, 8, 14) END AS name FROM pages),
    h AS (SELECT item, doc_id, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN name = doc_id THEN 0 ELSE 1 END, position) AS r FROM w JOIN k ON contains(name, doc_id) OR contains(doc_id, name))
    SELECT w.item, w.name, h.doc_id FROM w LEFT JOIN h ON h.item = w.item AND r = 1""",
)
def fuzzy_source_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    known = p.select(F.col("url").alias("doc_id"), F.col("page_id").alias("position"))
    wanted = p.selectExpr(
        "page_id AS item",
        "CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN concat('see ', url, '!') ELSE substr(url, 8, 14) END AS name",
    )
    return C.resolve_names(wanted, known).select("item", "name", "doc_id")


@query(
    "pass_rates",
    "SELECT source, lang, count(*) AS attempts, sum(CASE WHEN n_chars > 1800 THEN 1 ELSE 0 END) AS passes, round(sum(CASE WHEN n_chars > 1800 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM documents GROUP BY source, lang HAVING count(*) >= 5 AND sum(CASE WHEN n_chars > 1800 THEN 1 ELSE 0 END) / count(*) < 0.3",
)
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", (F.col("n_chars") > 1800).alias("passed"))
    out = C.low_pass_rates(d, ["source", "lang"])
    return out.select("source", "lang", "attempts", "passes", F.round("rate", 6).alias("rate"))


STAGES = {"clean": "label < 7", "control": "label < 8", "noisy": "true"}
#: What each stage adds to the one before; together every vector once.
ADDED = {"clean": "label < 7", "control": "label = 7", "noisy": "label > 7 OR label IS NULL"}
_STAGE_SQL = ", ".join(
    neighbours_sql(5, corpus.replace("label", "e.label"), f"nb_{stage}") for stage, corpus in STAGES.items()
)


@query(
    "needle_test",
    f"""WITH {_STAGE_SQL},
    r AS (SELECT stage, query_id, rank, q.label AS ql, e.label AS el FROM (SELECT 'clean' AS stage, * FROM nb_clean UNION ALL SELECT 'control', * FROM nb_control UNION ALL SELECT 'noisy', * FROM nb_noisy) nb
      JOIN embeddings q ON q.vec_id = nb.query_id JOIN embeddings e ON e.vec_id = nb.vec_id WHERE q.label < 7),
    q AS (SELECT stage, query_id, max(CASE WHEN el = ql THEN 1 ELSE 0 END) AS recall, max(CASE WHEN el >= 8 THEN 1 ELSE 0 END) AS pen, max(CASE WHEN el = ql THEN 1.0 / rank ELSE 0 END) AS rr FROM r GROUP BY ALL),
    a AS (SELECT avg(CASE WHEN stage = 'clean' THEN recall END) AS c, avg(CASE WHEN stage = 'control' THEN recall END) AS k, avg(CASE WHEN stage = 'noisy' THEN recall END) AS n, avg(CASE WHEN stage = 'noisy' THEN pen END) AS p,
      avg(CASE WHEN stage = 'clean' THEN rr END) AS mc, avg(CASE WHEN stage = 'control' THEN rr END) AS mk, avg(CASE WHEN stage = 'noisy' THEN rr END) AS mn FROM q)
    ,w AS (SELECT count(*) FILTER (d <> 0) AS n, count(*) FILTER (d > 0) AS pos, count(*) FILTER (d = 0) AS zeros FROM (SELECT k.recall - n.recall AS d FROM q k JOIN q n USING (query_id) WHERE k.stage = 'control' AND n.stage = 'noisy')),
    z AS (SELECT *, abs(least(pos, n - pos) * (n + 1) / 2.0 - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * (pow(n, 3) - n)) / 24) / sqrt(2) AS x FROM w WHERE n > 0),
    pv AS (SELECT CASE WHEN n = 1 AND zeros = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * (SELECT sum(exp(k * ln(2) + (2 * k + 1) * ln(greatest(x, 1e-12)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))) FROM (SELECT unnest(range(0, 400)) AS k)) END AS p FROM z)
    SELECT round(coalesce((SELECT p FROM pv), 1), 6) AS p_value, round(c, 6) AS recall_clean, round(k, 6) AS recall_control, round(n, 6) AS recall_noisy, round(mc, 6) AS mrr_clean, round(mk, 6) AS mrr_control, round(mn, 6) AS mrr_noisy,
     round(p, 6) AS penetration, round(c - k, 6) AS scale_drop, round(k - n, 6) AS interference_drop,
     CASE WHEN p < 0.1 THEN 'INCONCLUSIVE' WHEN k - n < 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a""",
)
def needle_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels below 7 are the clean corpus, 7 the control documents and 8, 9 the noisy ones; each stage adds to the last.

    Only the rows that a stage adds are searched, so that all vectors are read once, and the best lists are merged. ``p_value`` is the
    signed-rank test of recall between control and noisy. Queries are the asking vectors with relevant rows in the clean corpus.
    """
    e = embeddings(spark, sf_dir).select("vec_id", "label")
    mine = e.where("label < 7").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    staged = C.staged_best([(stage, neighbours(spark, sf_dir, 5, added)) for stage, added in ADDED.items()], 5, "vec_id")
    hit = F.col("label") == F.col("q_label")
    per = staged.join(mine, "query_id").join(e, "vec_id").groupBy("stage", "query_id").agg(
        F.max(hit.cast("int")).alias("recall"),
        F.max((F.col("label") >= 8).cast("int")).alias("penetrated"),
        F.max(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )
    per = materialize(per, "needle-stages")
    out = C.needle_verdict(per).join(C.needle_p(per), F.lit(True), "left")  # one row each
    return out.select(*[F.round(c, 6).alias(c) if c != "verdict" else F.col(c) for c in out.columns])


@query(
    "multi_chunk_pairs",
    "SELECT conv_id AS doc_id, turn // 2 AS pair_no, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1, 2 HAVING count(*) = 2",
)
def multi_chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("parent_no"), F.col("turn").alias("chunk_id"), F.col("text").alias("content")
    )
    return C.adjacent_pairs(c).select("doc_id", "pair_no", F.sha2("content", 256).alias("digest"))


@query(
    "stratified_sample",
    "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE (lang = 'en' AND r <= 20) OR (lang = 'fr' AND r <= 5) OR lang NOT IN ('en', 'fr')",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return C.stratified(d, "lang", "doc_id", {"en": 20, "fr": 5})


@query(
    "manifest_diff",
    """WITH b AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE lang <> 'es'), a AS (SELECT doc_id AS path, sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END) AS h FROM documents WHERE lang <> 'fr')
    SELECT path, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'missing' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE b.h IS DISTINCT FROM a.h""",
)
def manifest_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang", F.col("text").alias("content"))
    after = d.where("lang <> 'fr'").withColumn("content", F.when(F.col("lang") == "de", F.upper("content")).otherwise(F.col("content")))
    return manifest_diff(manifest(d.where("lang <> 'es'")), manifest(after))


def pairs_with_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its successor in id order; positive when both carry the same half of the labels."""
    e = embeddings(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    dot = F.aggregate(
        F.zip_with("embedding", "other", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return e.join(nxt, "vec_id").select(
        (F.round(dot, 6) + 0.6).alias("cosine"), ((F.col("label") < 5) == (F.col("other_label") < 5)).alias("positive")
    )


SCAN_SQL = f"""pr AS (SELECT {DOT.format(a='a.embedding', b='b.embedding')} + 0.6 AS cosine, (a.label < 5) = (b.label < 5) AS positive FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 th AS (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) AS DOUBLE) AS threshold),
 sc AS (SELECT threshold, count(*) FILTER (positive AND cosine > threshold) / count(*) FILTER (positive) AS keep_rate, count(*) FILTER (NOT positive AND cosine <= threshold) / count(*) FILTER (NOT positive) AS reject_rate FROM pr, th GROUP BY threshold)"""


@query("threshold_scan", f"WITH {SCAN_SQL} SELECT threshold, round(keep_rate, 6) AS keep_rate, round(reject_rate, 6) AS reject_rate FROM sc")
def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.scan(pairs_with_cosine(spark, sf_dir))
    return out.select("threshold", F.round("keep_rate", 6).alias("keep_rate"), F.round("reject_rate", 6).alias("reject_rate"))


@query(
    "operating_point",
    f"WITH {SCAN_SQL} SELECT min(threshold) AS threshold, min(threshold) IS NOT NULL AS found FROM sc WHERE keep_rate >= 0.4 AND reject_rate >= 0.4",
)
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.operating_point(A.scan(pairs_with_cosine(spark, sf_dir)), 0.4, 0.4)


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
_FOLD = "trim(regexp_replace(regexp_replace(lower(replace({0}, '，', ',')), '\\s+', ' ', 'g'), '([,.!?;:]) ', '\\1', 'g'))"


@query(
    "annotation_grounding",
    f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS first_line, string_split(text, chr(10))[-1] AS last_line FROM documents),
     q AS (SELECT *, replace(replace(CASE WHEN doc_id % 3 > 0 THEN first_line ELSE concat(last_line, ' ', first_line) END, ' ', '  '), ',', '，') AS quote FROM d)
     SELECT doc_id, {_FOLD.format('quote')} <> '' AND contains({_FOLD.format('text')}, {_FOLD.format('quote')}) AS grounded,
      round(coalesce(len(list_intersect({_WORDS.format('first_line')}, {_WORDS.format('last_line')})) / nullif(len({_WORDS.format('first_line')}), 0), 0), 6) AS overlap FROM q""",
)
def annotation_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with changed marks and blanks are found again in the whole text; lines put in a wrong order are not."""
    lines = F.split("text", "\n", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.get(lines, F.lit(0)).alias("a"), F.element_at(lines, -1).alias("z"))
    quote = F.when(F.col("doc_id") % 3 > 0, F.col("a")).otherwise(F.concat("z", F.lit(" "), "a"))
    quote = F.replace(F.replace(quote, F.lit(" "), F.lit("  ")), F.lit(","), F.lit("，"))
    return d.select(
        "doc_id",
        A.quote_present(quote, F.col("text")).alias("grounded"),
        F.round(A.term_overlap(F.col("a"), F.col("z")), 6).alias("overlap"),
    )


@query(
    "annotation_consistency",
    """SELECT conv_id AS query_id, least(n, 4) AS labels, CASE WHEN n >= 2 THEN 'multi_chunk' ELSE 'single_chunk' END AS difficulty, (hop AND n < 2) OR n > 4 AS review_needed
    FROM (SELECT conv_id, count(*) AS n, max(length(text)) > 500 AS hop FROM conversations GROUP BY conv_id)""",
)
def annotation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.array_sort(F.collect_list("turn")).alias("expected_parent_ids"),
        F.when(F.max(F.length("text")) > 500, "multi_hop").otherwise("factual").alias("question_type"),
    )
    return A.consistent(c.withColumn("difficulty", F.lit("single_chunk"))).select(
        "query_id", F.size("expected_parent_ids").alias("labels"), "difficulty", "review_needed"
    )


@query(
    "annotation_gates",
    """SELECT round(avg(quality), 6) AS semantic_rate, count(*) FILTER (toxic = 0 AND quality = 1) AS keep, count(*) FILTER (toxic = 0 AND quality = 0) AS fix, count(*) FILTER (toxic = 1) AS "delete", avg(quality) >= 0.8 AS passed FROM labels""",
)
def annotation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").selectExpr(
        "quality = 1 AS semantic_relevant", "CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'keep' ELSE 'fix' END AS disposition"
    )
    out = A.pilot_summary(rows)
    return out.withColumn("semantic_rate", F.round("semantic_rate", 6))


@query(
    "delete_and_renumber",
    "SELECT doc_id, printf('crawler-%04d', row_number() OVER (ORDER BY doc_id) - 1) AS query_id FROM labels WHERE toxic = 0",
)
def delete_and_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query_id"), F.col("doc_id").alias("position"), "doc_id", "toxic")
    gone = items.where("toxic = 1").select("query_id")
    return A.delete_and_renumber(items.drop("toxic"), gone).select("doc_id", "query_id")


@query(
    "topic_distance",
    f"""WITH d AS (SELECT label, vec_id, 1 - max(s) AS dist FROM (SELECT a.label, a.vec_id, {DOT.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id) GROUP BY 1, 2),
    r AS (SELECT round(dist, 6) AS v, row_number() OVER (ORDER BY round(dist, 6)) - 1 AS i, count(*) OVER () AS n FROM d)
    SELECT any_value(n) AS n, max(CASE WHEN i = least(n - 1, CAST(floor(0.05 * n) AS BIGINT)) THEN v END) AS p5, max(CASE WHEN i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) THEN v END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) THEN v END) AS p95 FROM r""",
)
def topic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every vector to its nearest other vector, and nearest-rank percentiles of it."""
    from quire.operators.ordered import percentiles

    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    asks = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = dense_topk(e, asks, 2, "vec_id", "embedding", write_blocks=True).where("vec_id <> query_id")  # one of two is another one
    near = materialize(hits.groupBy("query_id").agg(F.round(1 - F.max("score"), 6).alias("dist")).select(F.lit(0).alias("g"), "dist"), "distances")
    return percentiles(near, ["g"], "dist", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, "nearest").drop("g")
