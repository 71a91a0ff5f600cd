"""Queries over documents and pages: quality, routing, cleaning, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.core import pin
from quire.functions.markdown import fence_ranges, headings, morphology, passes_quality, table_ranges
from quire.functions.splitting import recursive_split
from quire.operators.chunking import child_chunks, parent_chunks, with_quality
from quire.plans.common import MARKDOWN, markdown_docs, registry, table
from quire.session import spread

QUERIES, ORACLES, query = registry()


LINES = f"""
md AS (SELECT doc_id, lang, source, {MARKDOWN} AS md FROM documents),
ln AS (SELECT doc_id, md, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM md),
po AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS pos,
       sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER w - (CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) AS fences
       FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hd AS (SELECT doc_id, md, i, pos, line, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+', 1)) AS level FROM po
       WHERE regexp_matches(line, '^#{{1,6}}[ \\t]+') AND fences % 2 = 0),
hx AS (SELECT *, lag(level) OVER w AS before, coalesce(lead(pos) OVER w, length(md)) AS stop FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ha AS (SELECT doc_id, count(*) AS n, bool_or(level = 1) AS h1, bool_and(before IS NULL OR level <= before + 1) AS cont,
       max(CAST(stop - pos AS BIGINT) // 2) AS longest, median(CAST(stop - pos AS BIGINT) // 2) AS med FROM hx GROUP BY doc_id),
fp AS (SELECT doc_id, sum(length(regexp_replace(CASE WHEN fences % 2 = 0 AND NOT starts_with(line, '```') THEN line ELSE '' END, '[\\s]', '', 'g'))) AS dense
       FROM po GROUP BY doc_id),
q AS (SELECT md.doc_id, md.md, coalesce(n, 0) AS n_headings, coalesce(h1, false) AS has_h1, coalesce(cont, false) AS heading_continuous,
      CASE WHEN n IS NULL THEN false WHEN h1 AND n >= 3 THEN true ELSE length(md.md) / n <= 2000 END AS heading_density_ok,
      coalesce(longest, length(md.md) // 2) AS max_section_tokens,
      CAST(coalesce(med, length(md.md) // 2) AS DOUBLE) AS median_section_tokens,
      length(md.md) // 2 AS total_tokens, CASE WHEN length(md.md) = 0 THEN 0.0 ELSE round(dense / length(md.md), 6) END AS text_ratio
      FROM md LEFT JOIN ha USING (doc_id) LEFT JOIN fp USING (doc_id))
"""

STRATEGY_SQL = """CASE WHEN has_h1 AND heading_continuous AND heading_density_ok THEN 'structured_clear'
 WHEN has_h1 THEN 'flat_parent_child' WHEN median_section_tokens < 200 THEN 'flat_simple' ELSE 'flat_parent_child' END"""


@query(
    "doc_quality",
    f"""WITH {LINES} SELECT doc_id, n_headings, has_h1, heading_continuous, heading_density_ok,
    median_section_tokens < 200 AS too_fragmented, max_section_tokens > 8192 AS exceeds_embed_token_limit, text_ratio,
    max_section_tokens, median_section_tokens, total_tokens,
    has_h1 AND heading_continuous AND heading_density_ok AND median_section_tokens >= 200 AND text_ratio >= 0.3 AS passes
    FROM q""",
)
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = with_quality(markdown_docs(spark, sf_dir), "md")
    return q.select(
        "doc_id",
        *[
            F.col(f"quality.{c}")
            for c in (
                "n_headings", "has_h1", "heading_continuous", "heading_density_ok", "too_fragmented",
                "exceeds_embed_token_limit", "max_section_tokens", "median_section_tokens", "total_tokens",
            )
        ],
        F.round("quality.text_ratio", 6).alias("text_ratio"),
        passes_quality(F.col("quality")).alias("passes"),
    )


@query(
    "route_strategy",
    f"WITH {LINES} SELECT strategy, count(*) AS docs, sum(total_tokens) AS tokens FROM (SELECT total_tokens, {STRATEGY_SQL} AS strategy FROM q) GROUP BY strategy",
)
def route_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = with_quality(markdown_docs(spark, sf_dir), "md")
    return q.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("quality.total_tokens").alias("tokens")
    )


@query(
    "heading_parse",
    f"WITH {LINES} SELECT doc_id, i AS line_number, level, trim(regexp_replace(line, '^#+', '')) AS heading, CAST(pos AS BIGINT) AS char_start, CAST(pos + length(line) AS BIGINT) AS char_end FROM hd",
)
def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markdown_docs(spark, sf_dir).select("doc_id", F.explode(headings(F.col("md"))).alias("h"))
    return rows.select(
        "doc_id", "h.line_number", "h.level", F.col("h.text").alias("heading"),
        F.col("h.char_start").cast("long").alias("char_start"), F.col("h.char_end").cast("long").alias("char_end"),
    )


@query(
    "protected_ranges",
    f"""WITH {LINES}, f AS (SELECT doc_id, i, pos, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM po WHERE starts_with(line, '```')),
    fr AS (SELECT a.doc_id, 'fence' AS kind, a.pos AS start, b.pos + 3 AS stop FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.n = a.n + 1 WHERE a.n % 2 = 1),
    tl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM po WHERE regexp_matches(line, '^\\s*\\|.*\\|\\s*$')),
    tr AS (SELECT doc_id, 'table' AS kind, min(pos) AS start, least(max(pos + length(line) + 1), max(length(md))) AS stop FROM tl GROUP BY doc_id, island)
    SELECT doc_id, kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT * FROM fr UNION ALL SELECT * FROM tr)""",
)
def protected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_docs(spark, sf_dir)

    def kind(name, ranges):
        return docs.select("doc_id", F.lit(name).alias("kind"), F.explode(ranges).alias("r"))

    return (
        kind("fence", fence_ranges(F.col("md")))
        .unionByName(kind("table", table_ranges(F.col("md"))))
        .select("doc_id", "kind", F.col("r.start").cast("long").alias("start"), F.col("r.stop").cast("long").alias("stop"))
    )


@query(
    "morphology_sample",
    f"""WITH md AS (SELECT doc_id, {MARKDOWN} AS md FROM documents),
    m AS (SELECT doc_id, CASE WHEN t AND c THEN 'mixed' WHEN t THEN 'table' WHEN c THEN 'code' ELSE 'plain' END AS morphology
          FROM (SELECT doc_id, regexp_matches(md, '(?m)^\\s*\\|.*\\|\\s*$') AS t, contains(md, '```') AS c FROM md))
    SELECT morphology, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM m GROUP BY morphology""",
)
def morphology_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = markdown_docs(spark, sf_dir).select("doc_id", morphology(F.col("md")).alias("morphology"))
    return kinds.groupBy("morphology").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


DIRTY = """concat('<b>', chr(8203), text, '</b>', chr(10), 'See https://', source, '.example.com/a?x=1#f (mail Info@', upper(source), '.Example.COM)',
 chr(10), '  Copyright ', source, chr(10), 'Read  more here', chr(10), 'end')"""
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(
    "clean_text",
    f"""WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}\\x{{feff}}\\x{{ad}}]', '', 'g'), '<[^>]*>', '', 'g'),
          '(https?://[^\\s)?#]*)[?#][^\\s)]*', '\\1', 'g') AS t FROM d),
    p AS (SELECT doc_id, t, regexp_extract_all(t, '{EMAIL_RE}') AS m, string_split_regex(t, '{EMAIL_RE}') AS s FROM a),
    e AS (SELECT doc_id, CASE WHEN len(m) = 0 THEN t ELSE array_to_string(list_transform(list_zip(s, list_concat(m, [''])), lambda z: z[1] || lower(z[2])), '') END AS t FROM p),
    b AS (SELECT doc_id, regexp_replace(t, '(?im)^\\s*(?:copyright\\s*©?|read\\s+more).*$', '', 'g') AS t FROM e)
    SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest FROM b""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = pin(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "t", F.expr(DIRTY))
    done = pin(dirty, "c", X.clean(F.col("t")))
    return done.select("doc_id", F.length("c").alias("n_chars"), F.sha2("c", 256).alias("digest"))


RAGGED = """concat(chr(10), '#', source, chr(13), chr(10), '| - | ---- |', chr(10), replace(text, chr(10), concat('  ', chr(10), chr(10), chr(10))), '   ', chr(10))"""


@query(
    "normalize_markdown",
    f"""WITH d AS (SELECT doc_id, {RAGGED} AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^(#{{1,6}})([^#\\s])', '\\1 \\2', 'g') AS t FROM d),
    b AS (SELECT doc_id, replace(t, chr(10) || '| - | ---- |' || chr(10), chr(10) || '|---|---|' || chr(10)) AS t FROM a),
    c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS t FROM b)
    SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest FROM c""",
)
def normalize_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ragged = pin(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "t", F.expr(RAGGED))
    done = pin(ragged, "c", X.normalize_markdown(F.col("t")))
    return done.select("doc_id", F.length("c").alias("n_chars"), F.sha2("c", 256).alias("digest"))


def split_sql(src: str, size: int, out: str) -> str:
    """CTEs that cut ``src`` (k, content) by the separators the documents hold, then by fixed width.

    The last one is ``out`` (k, content, start, piece_no), without overlap.
    """
    zero = "CAST(0 AS BIGINT)"
    none = "CAST([] AS STRUCT(content VARCHAR, start BIGINT)[])"

    def level(a: str, b: str, sep: str) -> str:
        def item(s, n):
            return f"struct_pack(s := {s}, n := {n}, buf := '', at := {zero}, pos := {zero}, res := {none})"

        return f"""
 {b}p AS (SELECT k, content, start, string_split(content, {sep}) AS raw FROM {a} WHERE length(content) > {size} AND contains(content, {sep})),
 {b}q AS (SELECT k, start, list_transform(raw, lambda p, i: CASE WHEN i = len(raw) THEN p ELSE p || {sep} END) AS parts FROM {b}p),
 {b}f AS (SELECT k, start, list_reduce(list_transform(parts, lambda p: {item('p', 'length(p)')}), lambda a, x: struct_pack(s := '', n := {zero},
   buf := CASE WHEN x.n > {size} THEN '' WHEN length(a.buf) + x.n <= {size} THEN a.buf || x.s ELSE x.s END,
   at := CASE WHEN length(a.buf) > 0 AND length(a.buf) + x.n <= {size} THEN a.at ELSE a.pos END,
   pos := a.pos + x.n,
   res := CASE WHEN x.n <= {size} AND length(a.buf) + x.n <= {size} THEN a.res
     ELSE list_concat(a.res, CASE WHEN length(a.buf) > 0 THEN [struct_pack(content := a.buf, start := a.at)] ELSE [] END,
                     CASE WHEN x.n > {size} THEN [struct_pack(content := x.s, start := a.pos)] ELSE [] END) END), {item("''", zero)}) AS a FROM {b}q),
 {b}r AS (SELECT k, start, unnest(CASE WHEN length(a.buf) > 0 THEN list_concat(a.res, [struct_pack(content := a.buf, start := a.at)]) ELSE a.res END) AS p FROM {b}f),
 {b} AS (SELECT k, content, start FROM {a} WHERE NOT (length(content) > {size} AND contains(content, {sep}))
   UNION ALL SELECT k, p.content, start + p.start FROM {b}r)"""

    return f"""{out}0 AS (SELECT k, content, {zero} AS start FROM {src} WHERE length(content) > 0),
 {level(out + '0', out + 'a', "chr(10) || chr(10)")},
 {level(out + 'a', out + 'b', 'chr(10)')},
 {level(out + 'b', out + 'c', "' '")},
 {out}d AS (SELECT k, content, start FROM {out}c WHERE length(content) <= {size}
   UNION ALL SELECT k, substring(content, CAST(o AS BIGINT) + 1, {size}), start + o FROM (SELECT *, unnest(generate_series(0, length(content) - 1, {size})) AS o FROM {out}c WHERE length(content) > {size})),
 {out} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY start) - 1 AS piece_no FROM {out}d)"""


def overlap_sql(whole: str, start: str, content: str, width: int) -> str:
    return f"substring({whole}, greatest({start} - {width}, 0) + 1, {start} - greatest({start} - {width}, 0)) || {content}"


@query(
    "recursive_split",
    f"""WITH src AS (SELECT doc_id AS k, text AS content FROM documents), {split_sql('src', 300, 'x')}
    SELECT k AS doc_id, piece_no, start, sha256({overlap_sql('text', 'start', 'content', 50)}) AS digest FROM x JOIN documents ON doc_id = k""",
)
def recursive_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recursive_split(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", 300, 50)
    return rows.select("doc_id", F.posexplode("pieces").alias("piece_no", "p")).select(
        "doc_id",
        F.col("piece_no").cast("long"),
        F.col("p.start").cast("long").alias("start"),
        F.sha2("p.content", 256).alias("digest"),
    )


@query("parent_child_chunks")
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = parent_chunks(with_quality(markdown_docs(spark, sf_dir), "md"), "doc_id", "md")
    return child_chunks(parents).select(
        "doc_id", "parent_id", "chunk_id", F.size("section_path").alias("depth"), "start_char_index",
        F.length("content").alias("n_chars"),
    )


@query(
    "question_type",
    """SELECT kind, difficulty, count(*) AS n FROM (SELECT CASE WHEN difficulty = 'multi_chunk' THEN 'multi_hop' WHEN contains(q, '区别') OR contains(q, 'vs') THEN 'comparison'
     WHEN contains(q, '如果') THEN 'conditional' ELSE 'factual' END AS kind, difficulty FROM
     (SELECT CASE WHEN turn > 3 THEN 'multi_chunk' ELSE 'single_chunk' END AS difficulty,
      CASE WHEN role = 'assistant' THEN '区别 ' || text WHEN length(text) > 300 THEN '如果 ' || text ELSE text END AS q FROM conversations)) GROUP BY kind, difficulty""",
)
def question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").selectExpr(
        "CASE WHEN turn > 3 THEN 'multi_chunk' ELSE 'single_chunk' END AS difficulty",
        "CASE WHEN role = 'assistant' THEN concat('区别 ', text) WHEN length(text) > 300 THEN concat('如果 ', text) ELSE text END AS q",
    )
    return (
        q.select(X.question_type(F.col("q"), F.col("difficulty")).alias("kind"), "difficulty")
        .groupBy("kind", "difficulty")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "url_source_tag",
    """SELECT CASE WHEN contains(u, 'juejin') THEN 'juejin' WHEN contains(u, 'csdn') THEN 'csdn' WHEN contains(u, 'zhihu') THEN 'zhihu' ELSE 'other' END AS tag, count(*) AS n
    FROM (SELECT CASE WHEN contains(url, '/fr/') THEN replace(url, 'example', 'juejin') WHEN contains(url, '/de/') THEN replace(url, 'example', 'csdn') ELSE url END AS u FROM pages) GROUP BY 1""",
)
def url_source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").selectExpr(
        "CASE WHEN contains(url, '/fr/') THEN replace(url, 'example', 'juejin') WHEN contains(url, '/de/') THEN replace(url, 'example', 'csdn') ELSE url END AS u"
    )
    return u.groupBy(X.source_tag(F.col("u")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "url_slug",
    """SELECT page_id, printf('%04d-', page_id) || coalesce(nullif(trim(regexp_replace(coalesce(nullif(regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '([^/]*)$', 1), ''), 'article'),
      '[^\\p{L}\\p{N}_\\x{4e00}-\\x{9fff}-]+', '-', 'g'), '-'), ''), 'article') AS slug FROM pages""",
)
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url"), F.col("page_id")).alias("slug"))


MESSAGE = """CASE event_type WHEN 'error' THEN 'Model not loaded' WHEN 'click' THEN 'docling 不可用' WHEN 'view' THEN 'output was EMPTY'
 WHEN 'signup' THEN '质量不足' ELSE 'broken pipe' END"""
BACKEND = "CASE WHEN value < 40 THEN 'vlm' WHEN value < 80 THEN 'colpali' ELSE 'docling' END"


@query(
    "error_classes",
    f"""SELECT backend, error_class, count(*) AS n FROM (SELECT backend, CASE WHEN slow THEN 'timeout' WHEN backend = 'vlm' AND contains(m, '不可用') THEN 'vlm_unavailable'
     WHEN backend = 'colpali' AND contains(m, '不可用') THEN 'colpali_unavailable' WHEN contains(m, '未安装') OR contains(m, '不可用') THEN 'import_error'
     WHEN contains(m, '模型') OR contains(lower(m), 'model') THEN 'model_load_error' WHEN contains(m, '空') OR contains(lower(m), 'empty') THEN 'empty'
     WHEN contains(m, '质量') THEN 'quality_fail' ELSE 'parse_error' END AS error_class
     FROM (SELECT {MESSAGE} AS m, {BACKEND} AS backend, value > 150 AS slow FROM events)) GROUP BY backend, error_class""",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(f"{MESSAGE} AS m", f"{BACKEND} AS backend", "value > 150 AS slow")
    return (
        e.select("backend", X.error_class(F.col("m"), F.col("backend"), F.col("slow")).alias("error_class"))
        .groupBy("backend", "error_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


REPLY = """CASE WHEN value < 50 THEN props WHEN value < 100 THEN concat('Sure:', chr(10), '```json', chr(10), props, chr(10), '```')
 WHEN value < 200 THEN concat('answer ', props, ' and {more}') ELSE 'no json at all' END"""


@query(
    "json_extraction",
    "SELECT event_id, CASE WHEN value < 200 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
)
def json_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{REPLY} AS reply")
    return pin(e, "j", X.json_block(F.col("reply"))).select(
        "event_id", F.get_json_object("j", "$.k").cast("long").alias("k")
    )


# The longest prefix within 500 bytes has between 125 and 500 characters: the SQL takes the longest that fits.
@query(
    "byte_truncate",
    """SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT doc_id, CASE WHEN strlen(text) <= 500 THEN text ELSE
    left(text, list_max(list_filter(generate_series(120, 500), lambda n: strlen(left(text, n)) <= 500))) END AS t FROM documents)""",
)
def byte_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.fit_bytes(F.col("text"), 500).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("digest"))

