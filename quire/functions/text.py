"""Text cleaning, normalisation, labels and hashes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import bind
from quire.functions.markdown import TABLE_ROW, strip

# Fixed patterns and word lists; results depend on them.
CONTROL = (
    r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f\u00ad"
    r"\u200b-\u200f\u202a-\u202e\u2060\ufeff]"
)
TAG = r"<[^>]*>"
URL_TAIL = r"(?U)(https?://[^\s)?#]*)[?#][^\s)]*"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BOILERPLATE = (
    r"(?imdU)^\s*(?:copyright\s*©?|版权所有|版权声明|免责声明|声明[:：]|关注公众号|扫描二维码|长按识别|"
    r"read\s+more|阅读原文|查看更多|本文(?:由|来自)|转载(?:请|须|需)|未经授权|如(?:有|涉及)侵权|版权归.*?所有).*$"
)
COMPARISON_MARKERS = (
    "区别", "差异", "对比", "比较", "有何不同", "异同", "优劣", "优缺点",
    "相比", "vs", "VS", "哪个更", "如何选择", "分别", "关系",
)
CONDITIONAL_MARKERS = (
    "如果", "什么情况下", "何时", "若", "假如", "一旦",
    "需要满足什么条件", "会怎样", "是否", "当",
)
WORD = r"[\p{L}\p{N}]+"


def replace_each(text: Column, pattern: str, change) -> Column:
    """Replace every match of ``pattern`` by ``change(match)``, which may be any column expression."""
    pieces = F.split(text, pattern, -1)
    matches = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(p, change(m))), "")


def lower_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), replace_each(text, EMAIL, F.lower)).otherwise(text)


def clean(text: Column) -> Column:
    """Drop control characters and tags, cut URL queries, lower e-mail addresses, blank boilerplate lines."""
    out = F.regexp_replace(text, CONTROL, "")
    out = F.regexp_replace(out, TAG, "")
    out = F.regexp_replace(out, URL_TAIL, "$1")
    return bind(out, lambda t: F.regexp_replace(lower_emails(t), BOILERPLATE, ""))


def normalize_markdown(text: Column) -> Column:
    """Line ends, a space after heading marks, three-dash separator cells, no trailing blanks, few empty lines."""
    out = F.regexp_replace(text, r"\r\n|\r", "\n")
    out = F.regexp_replace(out, r"(?mdU)^(#{1,6})(?=[^#\s])", "$1 ")

    def separator(line: Column) -> Column:
        cells = F.transform(
            F.split(line, r"\|", -1), lambda c: F.when(strip(c).rlike(r"^-+$"), F.lit("---")).otherwise(c)
        )
        return F.when(line.rlike(r"(?dU)^\|[\s\-|]*\|\s*$"), F.array_join(cells, "|")).otherwise(line)

    lines = F.transform(F.split(out, "\n", -1), lambda x: F.regexp_replace(separator(x), r"(?U)\s+$", ""))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\n+|\n+$", "")


def pipe_table(rows: Column) -> Column:
    """Rows of cells as a pipe table whose second line is the separator; empty for no rows."""
    lines = F.transform(
        rows,
        lambda r: F.concat(
            F.lit("| "), F.array_join(F.transform(r, lambda c: strip(F.replace(c, F.lit("\n"), F.lit(" ")))), " | "), F.lit(" |")
        ),
    )
    width = F.greatest(F.size(F.try_element_at(rows, F.lit(1))), F.lit(1))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(
        F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(rows))), "\n")
    )


def heading_line(level: Column, text: Column) -> Column:
    return F.concat(
        F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level))), F.lit(" "), strip(text)
    )


def tokens(text: Column) -> Column:
    """Default tokenizer: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_counts(words: Column) -> Column:
    """Distinct terms of one text with their counts, by the run lengths of the sorted terms. Linear after the sort."""

    def runs(sorted_words: Column) -> Column:
        n = F.size(sorted_words)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: (i <= n)
            & ((i == 1) | (F.try_element_at(sorted_words, i) != F.try_element_at(sorted_words, F.greatest(i - 1, F.lit(1))))),
        )
        return bind(
            starts,
            lambda at: F.transform(
                at,
                lambda p, j: F.struct(
                    F.try_element_at(sorted_words, p).alias("term"),
                    (F.coalesce(F.try_element_at(at, j + 2), n + 1) - p).alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(words), runs)


def stem(path: Column) -> Column:
    """Lower-case base name without its last extension."""
    base = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.lower(F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1"))


def doc_id_from_path(path: Column, base_dir: str) -> Column:
    """Path below ``base_dir`` without suffix; outside of it the bare stem."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    marker = base_dir.replace("\\", "/").rstrip("/") + "/"
    at = F.instr(plain, marker)
    relative = F.substring(plain, at + len(marker), F.length(plain))
    name = F.regexp_extract(plain, r"([^/]*)$", 1)
    return F.regexp_replace(F.when(at > 0, relative).otherwise(name), r"(?<=[^/])\.[^./]*$", "")


def format_hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)


def auto_query_id(position: Column) -> Column:
    return F.format_string("Q%04d", position)


def fit_bytes(text: Column, limit: int = 65535) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that ends on a character boundary."""
    raw = F.encode(text, "UTF-8")
    # The first dropped byte must start a character, so step back over continuation bytes (80..BF).
    cut = F.coalesce(
        *[
            F.when(~F.hex(F.substring(raw, at + 1, 1)).rlike("^[89AB]"), F.decode(F.substring(raw, 1, at), "UTF-8"))
            for at in range(limit, max(limit - 4, -1), -1)
        ]
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def any_marker(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def question_type(query: Column, difficulty: Column) -> Column:
    return (
        F.when(difficulty == "multi_chunk", F.lit("multi_hop"))
        .when(any_marker(query, COMPARISON_MARKERS), F.lit("comparison"))
        .when(any_marker(query, CONDITIONAL_MARKERS), F.lit("conditional"))
        .otherwise(F.lit("factual"))
    )


def source_tag(url: Column, sites: tuple[str, ...] = ("juejin", "csdn", "zhihu")) -> Column:
    """First site name the URL contains, else ``other``."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(s)), F.lit(s)) for s in sites], F.lit("other"))


def error_class(message: Column, backend: Column, timeout: Column) -> Column:
    """Ordered rules from an error message to one of eight classes."""
    low = F.lower(message)
    gone = F.contains(message, F.lit("不可用"))
    return (
        F.when(timeout, F.lit("timeout"))
        .when((backend == "vlm") & gone, F.lit("vlm_unavailable"))
        .when((backend == "colpali") & gone, F.lit("colpali_unavailable"))
        .when(F.contains(message, F.lit("未安装")) | gone, F.lit("import_error"))
        .when(F.contains(message, F.lit("模型")) | F.contains(low, F.lit("model")), F.lit("model_load_error"))
        .when(F.contains(message, F.lit("空")) | F.contains(low, F.lit("empty")), F.lit("empty"))
        .when(F.contains(message, F.lit("质量")), F.lit("quality_fail"))
        .otherwise(F.lit("parse_error"))
    )


def sha_prefix(text: Column, width: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, width)


def query_signature(query_id: Column, expected_ids: Column) -> Column:
    """Signature of a query and its labels, independent of label order."""
    return sha_prefix(F.concat(query_id, F.lit("|"), F.array_join(F.array_sort(expected_ids), "|")), 16)


def hash_embed(text: Column, dim: int = 16) -> Column:
    """Deterministic stand-in for an embedding model: unit vector from the bytes of a digest (dim <= 32)."""
    raw = bind(
        F.sha2(text, 256),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5,
        ),
    )
    return bind(
        raw,
        lambda v: bind(
            F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
            lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)),
        ),
    )


def context_text(chunks: Column) -> Column:
    """Answer context from ordered chunks with ``title``, ``source`` and ``content``."""
    parts = F.transform(
        chunks,
        lambda c, i: F.concat(
            F.lit("[来源"),
            (i + 1).cast("string"),
            F.lit("] 文档: "),
            F.coalesce(F.nullif(c["title"], F.lit("")), F.nullif(c["source"], F.lit("")), F.lit("[未知来源]")),
            F.lit("\n"),
            c["content"],
        ),
    )
    return F.array_join(parts, "\n\n---\n\n")


def rerank_text(title: Column, section_path: Column, doc_id: Column, content: Column) -> Column:
    """Text given to a reranker: title and section in brackets before the content."""
    path = F.when(F.size(section_path) > 0, F.concat(F.lit("['"), F.array_join(section_path, "', '"), F.lit("']")))
    return F.concat(
        F.lit("["), F.coalesce(F.nullif(title, F.lit("")), doc_id), F.lit("]["), F.coalesce(path, doc_id), F.lit("] "), content
    )


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Plain replacement of ``{key}`` marks."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def table_line(line: Column) -> Column:
    return line.rlike(TABLE_ROW)


def slug(url: Column, index: Column) -> Column:
    """File-name-safe form of a URL: its number and its last path segment."""
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"/+$", "")
    name = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("")), F.lit("article"))
    safe = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\u4e00-\u9fff-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.format_string("%04d-", index), F.coalesce(F.nullif(safe, F.lit("")), F.lit("article")))


def json_block(text: Column) -> Column:
    """JSON inside free text: the whole, then the first fenced block that parses, then the first balanced braces."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"), F.lit(1))
    return F.coalesce(
        _if_json(strip(text)),
        F.try_element_at(F.filter(F.transform(fenced, lambda b: _if_json(strip(b))), lambda b: b.isNotNull()), F.lit(1)),
        _if_json(first_object(text)),
    )


def _if_json(candidate: Column) -> Column:
    return F.when((F.length(candidate) > 0) & F.try_parse_json(candidate).isNotNull(), candidate)


def first_object(text: Column) -> Column:
    """First balanced ``{...}`` of a text, counting braces; empty when none closes."""
    start = F.instr(text, "{")
    body = F.substring(text, start, F.length(text))
    marks = F.regexp_extract_all(body, F.lit(r"[^{}]+|[{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("stop"))

    def step(acc: Column, m: Column) -> Column:
        depth = acc["depth"] + F.when(m == "{", F.lit(1)).when(m == "}", F.lit(-1)).otherwise(F.lit(0))
        after = acc["pos"] + F.length(m)
        return F.struct(
            depth.alias("depth"),
            after.alias("pos"),
            F.when((acc["stop"] == 0) & (m == "}") & (depth == 0), after).otherwise(acc["stop"]).alias("stop"),
        )

    stop = F.aggregate(marks, zero, step, lambda acc: acc["stop"])
    return F.when(start > 0, F.substring(body, F.lit(1), stop)).otherwise(F.lit(""))
