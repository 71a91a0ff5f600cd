"""Quality of parsed documents: fidelity to a gold text, retention gates, page merging, routing confusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.core import adjacent, bind, pin, safe_ratio
from quire.functions.markdown import FENCED_CODE, TABLE_ROW, TABLE_SEPARATOR, bare_line, split_lines, strip
from quire.session import materialize, ship_by_value

ship_by_value(__name__)


def squash(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def _pairs(text: str | None) -> np.ndarray | None:
    """Distinct character pairs of a text, each as one number of its two code points, ascending."""
    if text is None:
        return None
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.unique((codes[:-1] << 21) + codes[1:])


PAIR_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("parsed", "gold", "common")])


@F.pandas_udf(PAIR_COUNTS)
def pair_counts(parsed: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Numbers of distinct character pairs of two texts and of those in both; null for a null text."""
    rows = []
    for p, g in zip(map(_pairs, parsed), map(_pairs, gold), strict=True):
        both = None if p is None or g is None else len(np.intersect1d(p, g, assume_unique=True))
        rows.append((None if p is None else len(p), None if g is None else len(g), both))
    return pd.DataFrame(rows, columns=PAIR_COUNTS.names, dtype="Int32")


def heading_items(text: Column) -> Column:
    """Level and text of every heading line; fences are not looked at here."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(?mdU)^(#{1,6}\s+[^\n]*)$"), F.lit(1)),
        lambda h: F.concat(
            F.length(F.regexp_extract(h, r"^(#+)", 1)).cast("string"), F.lit(" "), strip(F.regexp_replace(h, r"^#{1,6}", ""))
        ),
    )


def _columns(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\|", -1), lambda c: strip(c) != ""))


def table_shapes(text: Column) -> Column:
    """Data rows and columns of every pipe table, as ``rows x columns``."""
    zero = F.struct(F.lit(0).alias("rows"), F.lit(-1).alias("cols"), F.array().cast("array<string>").alias("out"))

    def flush(acc: Column) -> Column:
        shape = F.concat(acc["rows"].cast("string"), F.lit("x"), acc["cols"].cast("string"))
        return F.when(acc["cols"] >= 0, F.concat(acc["out"], F.array(shape))).otherwise(acc["out"])

    def step(acc: Column, raw: Column) -> Column:
        line = bare_line(raw)
        row = line.rlike(TABLE_ROW)
        data = (~line.rlike(TABLE_SEPARATOR)).cast("int")
        return F.struct(
            F.when(row, F.when(acc["cols"] >= 0, acc["rows"]).otherwise(0) + data).otherwise(0).alias("rows"),
            F.when(row, F.when(acc["cols"] >= 0, acc["cols"]).otherwise(_columns(line))).otherwise(-1).alias("cols"),
            F.when(row, acc["out"]).otherwise(flush(acc)).alias("out"),
        )

    return F.when(F.contains(text, F.lit("|")), F.aggregate(split_lines(text), zero, step, flush)).otherwise(
        F.array().cast("array<string>")
    )


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?sU)```(\w*\n.*?)```"), F.lit(1))


def _share(parsed: Column, gold: Column) -> Column:
    found = F.size(F.filter(gold, lambda g: F.array_contains(parsed, g)))
    return F.when(F.size(gold) == 0, F.lit(1.0)).otherwise(safe_ratio(found, F.size(gold)))


def text_fidelity(pairs: DataFrame, parsed: str = "parsed", gold: str = "gold") -> DataFrame:
    """Add text_recall and text_precision. Row-local."""
    rows = pin(pairs, "_c", pair_counts(squash(F.col(parsed)), squash(F.col(gold))))
    p, g, common = F.col("_c.parsed"), F.col("_c.gold"), F.col("_c.common")
    rows = rows.withColumn(
        "text_recall",
        F.when(g == 0, F.when(p == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(safe_ratio(common, g)),
    ).withColumn("text_precision", F.when(p == 0, F.lit(1.0)).otherwise(safe_ratio(common, p)))
    return rows.drop("_c")


def fidelity(pairs: DataFrame, parsed: str = "parsed", gold: str = "gold") -> DataFrame:
    """Add text_recall, text_precision, heading, table, code and overall fidelity. Row-local."""
    rows = text_fidelity(pairs, parsed, gold)
    for name, items in (("heading", heading_items), ("table", table_shapes), ("code", code_blocks)):
        rows = pin(rows.drop("_p", "_g"), "_p", items(F.col(parsed)))
        rows = pin(rows, "_g", items(F.col(gold))).withColumn(name, _share(F.col("_p"), F.col("_g")))
    return rows.drop("_p", "_g").withColumn(
        "overall", (F.col("heading") + F.col("table") + F.col("code")) / 3
    )


FIDELITY = ("text_recall", "text_precision", "heading", "table", "code", "overall")


def fidelity_report(rows: DataFrame, by: tuple[str, str] = ("format", "morphology")) -> DataFrame:
    """Means overall and by both groupings in one pass."""
    sets = rows.groupingSets([[by[0]], [by[1]], []], *by)
    return sets.agg(F.count(F.lit(1)).alias("samples"), *[F.avg(m).alias(m) for m in FIDELITY])


def parse_quality(text: Column, tables: Column, fences: Column, keep: float = 0.8) -> Column:
    """Reasons why a parsed text is not good enough; ``tables`` and ``fences`` are the expected counts or null."""
    levels = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?mdU)^(#{1,6})\s+"), F.lit(1)), lambda h: F.length(h)
    )
    table_loss = F.try_divide(F.size(table_shapes(text)), F.when(tables > 0, tables)) < keep
    fence_loss = F.try_divide(F.size(F.regexp_extract_all(text, F.lit(FENCED_CODE), F.lit(0))), F.when(fences > 0, fences)) < keep
    return F.array_compact(
        F.array(
            F.when(strip(text) == "", F.lit("empty")),
            F.when(table_loss, F.lit("table_loss")),
            F.when(fence_loss, F.lit("code_fence_loss")),
            F.when(~bind(levels, lambda v: adjacent(v, lambda a, b: b <= a + 1)), F.lit("heading_discontinuous")),
        )
    )


def first_good(candidates: list[tuple[str, Column, Column]]) -> Column:
    """First backend output that is not blank and has no quality reason: struct(backend, markdown) or null."""
    return F.coalesce(
        *[
            F.when(
                text.isNotNull() & (strip(text) != "") & (F.size(reasons) == 0),
                F.struct(F.lit(name).alias("backend"), text.alias("markdown")),
            )
            for name, text, reasons in candidates
        ]
    )


#: Pages of a document that are folded together.
PAGE_BLOCK = 128
_LAST = "struct<num:bigint,mark:string,some:boolean>"
_STATE = f"struct<cols:int,cols_in:boolean,last:{_LAST},last_in:boolean>"


def _after_page(a: Column, s: Column, same_cols: Column, same_list: Column, keep_tail: bool) -> tuple[Column, Column]:
    """Kind of a page and the state after it. ``cols_in`` and ``last_in`` say that a value is still the one before the block.

    A value from before the block is compared once at most, as a page that compares it also replaces it, and the page at which that
    happens is the same on every path; ``same_cols`` and ``same_list`` are the outcomes.
    """
    lead, first, last = s["lead_cols"], s["first"], a["last"]
    table = lead.isNotNull() & F.when(a["cols_in"], same_cols).otherwise(F.coalesce(a["cols"] == lead, F.lit(False)))
    itemized = first["num"].isNotNull() | first["mark"].isNotNull()
    listed = ~table & F.when(a["last_in"], same_list & itemized).otherwise(_continues(last, first))
    kind = F.when(table, "table").when(listed, "list").otherwise("append")
    nothing = F.struct(F.lit(None).cast("bigint").alias("num"), F.lit(None).cast("string").alias("mark"), F.lit(True).alias("some")).cast(_LAST)
    new_cols, new_last = s["last_cols"], F.when(s["last"]["some"], s["last"].cast(_LAST))
    if not keep_tail:
        new_cols = F.when(table, F.coalesce(s["body_cols"], lead)).when(~listed, new_cols)
        new_last = F.when(table, F.when(s["body_cols"].isNotNull(), nothing)).when(listed, first.cast(_LAST)).otherwise(new_last)
    state = F.struct(
        F.coalesce(new_cols, a["cols"]).alias("cols"), (a["cols_in"] & new_cols.isNull()).alias("cols_in"),
        F.coalesce(new_last, last).alias("last"), (a["last_in"] & new_last.isNull()).alias("last_in"),
    )
    return kind, state.cast(_STATE)


def _continues(last: Column, first: Column) -> Column:
    """True if a list item ``first`` goes on after ``last``."""
    numbered = last["num"].isNotNull() & first["num"].isNotNull()
    return F.coalesce(F.when(numbered, first["num"] == last["num"] + 1).otherwise(last["mark"] == first["mark"]), F.lit(False))


def _page_kinds(summary: DataFrame, keep_tail: bool) -> DataFrame:
    """``doc_id, page, kind`` by a segment scan over ``doc_id, s``.

    A block of pages is a map of states: what it leaves behind, for both outcomes of either comparison with the state before it.
    The maps of a document are composed in order, and every block is then walked from its own state.
    """
    nowhere = F.struct(F.lit(None).cast("int").alias("cols"), F.lit(False).alias("cols_in"), F.struct(F.lit(None).alias("num"), F.lit(None).alias("mark"), F.lit(False).alias("some")).alias("last"), F.lit(False).alias("last_in")).cast(_STATE)
    unknown = F.struct(F.lit(None).cast("int").alias("cols"), F.lit(True).alias("cols_in"), F.struct(F.lit(None).alias("num"), F.lit(None).alias("mark"), F.lit(False).alias("some")).alias("last"), F.lit(True).alias("last_in")).cast(_STATE)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("s.page")) - 1
    begun = F.min(F.when(F.col("s.n") > 0, F.col("s.page"))).over(Window.partitionBy("doc_id"))
    placed = summary.select("doc_id", "s", begun.alias("begun"), F.floor(place / PAGE_BLOCK).alias("block"))
    blocks = materialize(placed.groupBy("doc_id", "block").agg(F.first("begun").alias("begun"), F.array_sort(F.collect_list("s")).alias("pages")), "page-blocks")

    def walked(bits: Column) -> Column:
        return F.aggregate("pages", unknown, lambda a, s: _after_page(a, s, F.pmod(bits, F.lit(2)) == 1, bits >= 2, keep_tail)[1])

    maps = blocks.select(
        "doc_id",
        F.struct(
            "block",
            F.get(F.filter(F.transform("pages", lambda s: s["lead_cols"]), lambda c: c.isNotNull()), 0).alias("lead_cols"),
            F.get(F.filter(F.transform("pages", lambda s: s["first"]), lambda f: f["num"].isNotNull() | f["mark"].isNotNull()), 0).alias("first"),
            F.transform(F.sequence(F.lit(0), F.lit(3)), walked).alias("ends"),
        ).alias("map"),
    )

    def compose(a: Column, m: Column) -> Column:
        state = a["state"]
        same = F.coalesce(state["cols"] == m["lead_cols"], F.lit(False)).cast("int")
        bits = same + 2 * F.coalesce(_continues(state["last"], m["first"]), F.lit(False)).cast("int")
        end = F.element_at(m["ends"], bits + 1)
        after = F.struct(
            F.when(end["cols_in"], state["cols"]).otherwise(end["cols"]).alias("cols"), F.lit(False).alias("cols_in"),
            F.when(end["last_in"], state["last"]).otherwise(end["last"]).alias("last"), F.lit(False).alias("last_in"),
        ).cast(_STATE)
        return F.struct(after.alias("state"), F.concat(a["out"], F.array(F.struct(m["block"].alias("block"), state.alias("state")))).alias("out"))

    start = F.struct(nowhere.alias("state"), F.array().cast(f"array<struct<block:bigint,state:{_STATE}>>").alias("out"))
    states = maps.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list("map")), start, compose, lambda a: a["out"]).alias("_out"))

    def step(a: Column, s: Column) -> Column:
        kind, state = _after_page(a["state"], s, F.lit(False), F.lit(False), keep_tail)
        return F.struct(state.alias("state"), F.concat(a["out"], F.array(F.struct(s["page"].cast("bigint").alias("page"), kind.alias("kind")))).alias("out"))

    begin = F.struct(F.col("state"), F.array().cast("array<struct<page:bigint,kind:string>>").alias("out"))
    kinds = blocks.join(states.select("doc_id", F.inline("_out")), ["doc_id", "block"]).select(
        "doc_id", "begun", F.inline(F.aggregate("pages", begin, step, lambda a: a["out"]))
    )
    first = F.col("begun").isNull() | (F.col("page") <= F.col("begun"))
    return kinds.select("doc_id", "page", F.when(first, "first").otherwise(F.col("kind")).alias("kind"))


def merged_lists(joined: DataFrame) -> DataFrame:
    """``doc_id, kind, pages``: the pages that were merged into the one before, in order, per kind (table or list)."""
    return joined.where("kind IN ('table', 'list')").groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def merge_pages(pages: DataFrame, keep_tail: bool = False) -> DataFrame:
    """Join pages of a document over table and list breaks: (doc_id, page, kind, kept).

    ``pages`` is (doc_id, page, text). ``kind`` is first, table, list or append; ``kept`` is what the page adds. With
    ``keep_tail=False`` a page that continues a table or list adds only that part; with True its rest stays too.
    The walk over a document sees a fixed-size summary per page, in blocks; page texts stay spread and join back by (doc, page).
    """
    ordered, bullet = r"^(\d+)\.\s+", r"^([-*])\s+"
    base = pin(pages, "_lines", F.filter(F.transform(split_lines(F.col("text")), bare_line), lambda x: x.isNotNull()))
    base = pin(
        base,
        "_lead",
        F.aggregate(
            "_lines",
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, x: F.struct(
                (a["n"] + (a["on"] & x.rlike(TABLE_ROW)).cast("int")).alias("n"), (a["on"] & x.rlike(TABLE_ROW)).alias("on")
            ),
            lambda a: a["n"],
        ),
    )
    lines = F.col("_lines")
    filled = F.filter(lines, lambda x: strip(x) != "")
    header = (F.col("_lead") >= 2) & F.coalesce(F.try_element_at(lines, F.lit(2)).rlike(TABLE_SEPARATOR), F.lit(False))
    skip = F.when(header, 2).otherwise(0)
    rows = F.filter(lines, lambda x: x.rlike(TABLE_ROW))

    def line_key(line: Column) -> Column:
        return F.struct(
            F.try_to_number(F.nullif(F.regexp_extract(line, ordered, 1), F.lit("")), F.lit("999999999999")).cast("long").alias("num"),
            F.nullif(F.regexp_extract(line, bullet, 1), F.lit("")).alias("mark"),
            line.isNotNull().alias("some"),
        )

    summary = base.select(
        "doc_id",
        F.struct(
            F.col("page").alias("page"),
            F.size(lines).alias("n"),
            F.when(F.col("_lead") > 0, _columns(F.try_element_at(lines, F.lit(1)))).alias("lead_cols"),
            F.when(F.col("_lead") - skip > 0, _columns(F.try_element_at(lines, F.col("_lead")))).alias("body_cols"),
            F.when(F.size(rows) > 0, _columns(F.try_element_at(rows, F.lit(-1)))).alias("last_cols"),
            line_key(F.try_element_at(filled, F.lit(1))).alias("first"),
            line_key(F.try_element_at(filled, F.lit(-1))).alias("last"),
            F.col("_lead").alias("lead"),
            skip.alias("skip"),
        ).alias("s"),
    )
    kinds = _page_kinds(summary, keep_tail)
    body = F.slice(lines, skip + 1, F.greatest(F.col("_lead") - skip, F.lit(0)))
    if keep_tail:
        kept = F.when(F.col("kind") == "table", F.slice(lines, skip + 1, F.size(lines))).otherwise(lines)
    else:
        kept = F.when(F.col("kind") == "table", body).when(F.col("kind") == "list", F.slice(filled, 1, 1)).otherwise(lines)
    return base.join(kinds, ["doc_id", "page"]).select("doc_id", "page", "kind", F.array_join(kept, "\n").alias("kept"))


def confusion(labels: DataFrame) -> DataFrame:
    """Per-label tp, fp, fn, precision, recall and f1 over (gold, predicted)."""
    pairs = labels.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    right = F.col("gold") == F.col("predicted")
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("gold").alias("label"), F.when(right, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~right, F.col("n")).otherwise(0).alias("fn")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(~right, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "label", "tp", "fp", "fn",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(safe_ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
    )


def route_cost(labels: DataFrame) -> DataFrame:
    """Accuracy and cost of wrong routes; text sent to skip costs 2, any other mistake 1."""
    wrong = F.col("gold") != F.col("predicted")
    cost = F.when(~wrong, 0.0).when((F.col("gold") == "text") & (F.col("predicted") == "skip"), 2.0).otherwise(1.0)
    return labels.agg(F.round(F.avg((~wrong).cast("double")), 4).alias("accuracy"), F.round(F.sum(cost), 4).alias("misroute_cost"))


def route_label(decision: Column, colpali: Column) -> Column:
    return (
        F.when(colpali, "colpali").when(decision.isin("html_text", "whole_text"), "text").when(decision == "vlm", "vlm").otherwise("skip")
    )
