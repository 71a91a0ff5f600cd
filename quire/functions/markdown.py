"""Markdown structure as column expressions: lines, fences, tables, headings, quality and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import adjacent, array_median, bind
from quire.settings import DEFAULTS, Settings

# Fixed patterns. (?U) gives \s its Unicode meaning, (?d) makes \n the only line end.
LINE_END = r"\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029"
LINE = rf"[^{LINE_END}]*+(?:\r\n|[{LINE_END}])|[^{LINE_END}]++"
HEADING = r"(?sU)^(#{1,6})\s+(.*)$"
TABLE_ROW = r"(?dU)^\s*\|.*\|\s*$"
TABLE_SEPARATOR = r"(?dU)^\s*\|[\s\-|]+\|\s*$"
FENCED_CODE = r"(?sU)```\w*\n.*?```"
MOJIBAKE = r"\ufffd|\u00c3[\u0080-\u00bf]|\u00e2\u20ac|\u00ef\u00bc"

RANGE_TYPE = "array<struct<start:int,stop:int>>"
LINE_TYPE = "array<struct<text:string,start:int>>"
HEADING_TYPE = "array<struct<level:int,text:string,line_number:int,char_start:int,char_end:int>>"


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("int")


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines with their ends kept, cut at every line boundary Unicode knows."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def bare_line(line: Column) -> Column:
    return F.regexp_replace(line, r"[\r\n]+$", "")


def overlaps(start: Column, stop: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (start < r["stop"]) & (stop > r["start"]))


def inside(position: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["start"] <= position) & (position < r["stop"]))


def _range(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def _no_ranges() -> Column:
    return F.array().cast(RANGE_TYPE)


def fence_ranges(text: Column) -> Column:
    """Half-open ranges of fenced code: from an opening fence to just after the three closing backticks.

    A fence that is never closed runs to the end of the text.
    """

    def scan(lines: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("pos"), F.lit(-1).alias("opened"), _no_ranges().alias("found")
        )

        def step(acc: Column, line: Column) -> Column:
            fence = F.startswith(line, F.lit("```"))
            closing = fence & (acc["opened"] >= 0)
            return F.struct(
                (acc["pos"] + F.length(line) + 1).alias("pos"),
                F.when(closing, F.lit(-1)).when(fence, acc["pos"]).otherwise(acc["opened"]).alias("opened"),
                F.when(closing, F.concat(acc["found"], F.array(_range(acc["opened"], acc["pos"] + 3))))
                .otherwise(acc["found"])
                .alias("found"),
            )

        return F.aggregate(
            lines,
            start,
            step,
            lambda acc: F.when(
                acc["opened"] >= 0,
                F.concat(acc["found"], F.array(_range(acc["opened"], acc["pos"] - 1))),
            ).otherwise(acc["found"]),
        )

    return F.when(F.contains(text, F.lit("```")), scan(F.split(text, "\n", -1))).otherwise(_no_ranges())


def table_ranges(text: Column) -> Column:
    """Half-open ranges of runs of consecutive pipe-table lines."""

    def scan(lines: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("pos"), F.lit(-1).alias("opened"), _no_ranges().alias("found")
        )

        def step(acc: Column, line: Column) -> Column:
            row = bare_line(line).rlike(TABLE_ROW)
            ends = ~row & (acc["opened"] >= 0)
            return F.struct(
                (acc["pos"] + F.length(line)).alias("pos"),
                F.when(ends, F.lit(-1))
                .when(row & (acc["opened"] < 0), acc["pos"])
                .otherwise(acc["opened"])
                .alias("opened"),
                F.when(ends, F.concat(acc["found"], F.array(_range(acc["opened"], acc["pos"]))))
                .otherwise(acc["found"])
                .alias("found"),
            )

        return F.aggregate(
            lines,
            start,
            step,
            lambda acc: F.when(
                acc["opened"] >= 0, F.concat(acc["found"], F.array(_range(acc["opened"], acc["pos"])))
            ).otherwise(acc["found"]),
        )

    return F.when(F.contains(text, F.lit("|")), scan(split_lines(text))).otherwise(_no_ranges())


def _table_fits(r: Column, cfg: Settings) -> Column:
    width = r["stop"] - r["start"]
    return (width <= cfg.table_atomic_max_chars) & (F.floor(width / 2) <= cfg.embed_token_limit)


def protected_table_ranges(text: Column, cfg: Settings = DEFAULTS) -> Column:
    return F.filter(table_ranges(text), lambda r: _table_fits(r, cfg))


def degraded_table_count(text: Column, cfg: Settings = DEFAULTS) -> Column:
    return F.size(F.filter(table_ranges(text), lambda r: ~_table_fits(r, cfg)))


def headings(text: Column) -> Column:
    """Headings outside fenced code with level, text, line number and character range."""

    def scan(ranges: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("pos"), F.lit(1).alias("line"), F.array().cast(HEADING_TYPE).alias("found")
        )

        def step(acc: Column, raw: Column) -> Column:
            line = bare_line(raw)
            hit = F.startswith(raw, F.lit("#")) & line.rlike(HEADING) & ~inside(acc["pos"], ranges)
            item = F.struct(
                F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
                strip(F.regexp_extract(line, HEADING, 2)).alias("text"),
                acc["line"].alias("line_number"),
                acc["pos"].alias("char_start"),
                (acc["pos"] + F.length(line)).alias("char_end"),
            )
            return F.struct(
                (acc["pos"] + F.length(raw)).alias("pos"),
                (acc["line"] + 1).alias("line"),
                F.when(hit, F.concat(acc["found"], F.array(item))).otherwise(acc["found"]).alias("found"),
            )

        return F.aggregate(split_lines(text), start, step, lambda acc: acc["found"])

    return F.when(F.contains(text, F.lit("#")), bind(fence_ranges(text), scan)).otherwise(
        F.array().cast(HEADING_TYPE)
    )


def text_ratio(text: Column) -> Column:
    """Share of characters that are neither white space nor inside fenced code."""

    def outside(ranges: Column) -> Column:
        # One gap before each fence and one after the last.
        stops = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["stop"]))
        starts = F.concat(F.transform(ranges, lambda r: r["start"]), F.array(F.length(text)))
        return F.aggregate(
            F.zip_with(stops, starts, lambda a, b: F.substring(text, a + 1, b - a)),
            F.lit(0),
            lambda n, part: n + F.length(F.regexp_replace(part, r"(?U)[\s\u001c-\u001f]+", "")),
        )

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        bind(fence_ranges(text), outside) / F.length(text)
    )


def diagnose(text: Column, cfg: Settings = DEFAULTS) -> Column:
    """Quality report of one Markdown text as a struct."""

    def report(h: Column) -> Column:
        n = F.size(h)
        has_h1 = F.exists(h, lambda x: x["level"] == 1)
        starts = F.transform(h, lambda x: x["char_start"])
        stops = F.concat(
            F.slice(starts, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.length(text))
        )
        sections = F.when(n == 0, F.array(token_estimate(text))).otherwise(
            F.zip_with(starts, stops, lambda a, b: F.floor((b - a) / 2).cast("int"))
        )
        return bind(
            F.struct(F.array_max(sections).alias("longest"), array_median(sections).alias("median")),
            lambda s: F.struct(
                has_h1.alias("has_h1"),
                ((n > 0) & adjacent(h, lambda a, b: b["level"] <= a["level"] + 1)).alias("heading_continuous"),
                F.when(n == 0, F.lit(False))
                .when(has_h1 & (n >= cfg.heading_density_min), F.lit(True))
                .otherwise(F.try_divide(F.length(text), n) <= cfg.heading_density_chars)
                .alias("heading_density_ok"),
                (s["median"] < cfg.fragmented_tokens).alias("too_fragmented"),
                (s["longest"] > cfg.embed_token_limit).alias("exceeds_embed_token_limit"),
                text_ratio(text).alias("text_ratio"),
                text.rlike(MOJIBAKE).alias("has_encoding_issues"),
                n.alias("n_headings"),
                s["longest"].alias("max_section_tokens"),
                s["median"].alias("median_section_tokens"),
                token_estimate(text).alias("total_tokens"),
            ),
        )

    return bind(headings(text), report)


def strategy(quality: Column) -> Column:
    """Splitting strategy for a quality report."""
    return (
        F.when(
            quality["has_h1"] & quality["heading_continuous"] & quality["heading_density_ok"],
            F.lit("structured_clear"),
        )
        .when(quality["has_h1"], F.lit("flat_parent_child"))
        .when(quality["too_fragmented"], F.lit("flat_simple"))
        .otherwise(F.lit("flat_parent_child"))
    )


def passes_quality(quality: Column, cfg: Settings = DEFAULTS) -> Column:
    return (
        quality["has_h1"]
        & quality["heading_continuous"]
        & quality["heading_density_ok"]
        & ~quality["too_fragmented"]
        & (quality["text_ratio"] >= cfg.text_ratio_warn)
        & ~quality["has_encoding_issues"]
    )


def morphology(text: Column) -> Column:
    """Content shape: plain, table, code or mixed."""
    table = text.rlike(r"(?mdU)^\s*\|.*\|\s*$")
    code = F.contains(text, F.lit("```"))
    return (
        F.when(table & code, F.lit("mixed"))
        .when(table, F.lit("table"))
        .when(code, F.lit("code"))
        .otherwise(F.lit("plain"))
    )
