"""Recursive and heading-based splitting as row-local folds over arrays.

A document is one row, so no step shuffles and none leaves the JVM: each separator level is a ``transform`` over
the pieces of the level above, and inside it one ``aggregate`` cuts and re-packs a piece. The levels are one fold over
the separators, so a row is written once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.core import bind, built, pin
from quire.functions.markdown import fence_ranges, headings, overlaps, protected_table_ranges, strip
from quire.settings import DEFAULTS, Settings

RANGE_TYPE = "array<struct<start:int,stop:int>>"
PIECE_TYPE = "array<struct<sec:int,content:string,start:int>>"
PART_TYPE = "array<struct<s:string,len:int>>"
WIDE = r"[\x{10000}-\x{10ffff}]"
SECTION_TYPE = "array<struct<section_path:array<string>,content:string,start:int>>"


def _piece(sec: Column, content: Column, start: Column) -> Column:
    return F.struct(sec.cast("int").alias("sec"), content.alias("content"), start.cast("int").alias("start"))


def _pieces(*items: Column) -> Column:
    return F.array(*items).cast(PIECE_TYPE)


def _append_last(items: Column, suffix: Column) -> Column:
    """The array with ``suffix`` added to the content of its last piece."""
    last = F.element_at(items, -1)
    return F.concat(
        F.slice(items, F.lit(1), F.size(items) - 1),
        F.array(_piece(last["sec"], F.concat(last["content"], suffix), last["start"])),
    )


def _parts(content: Column, separator: Column, start: Column, ranges: Column) -> Column:
    """Parts of a text with the separator kept at the part's end; no cut lies in a protected range."""
    width = F.length(separator)

    def with_end(raw: Column) -> Column:
        return F.transform(
            raw,
            lambda x, i: F.when(i == F.size(raw) - 1, F.struct(x.alias("s"), F.length(x).alias("len"))).otherwise(
                F.struct(F.concat(x, separator).alias("s"), (F.length(x) + width).alias("len"))
            ),
        )

    def glue(parts: Column) -> Column:
        """Join neighbours whose separator is protected."""
        zero = F.struct(
            start.cast("int").alias("pos"),
            F.lit("").alias("open"),
            F.array().cast(PART_TYPE).alias("out"),
        )

        def step(acc: Column, part: Column) -> Column:
            stop = acc["pos"] + part["len"]
            text = F.concat(acc["open"], part["s"])
            kept = overlaps(stop - width, stop, ranges)
            return F.struct(
                stop.alias("pos"),
                F.when(kept, text).otherwise(F.lit("")).alias("open"),
                F.when(kept, acc["out"])
                .otherwise(F.concat(acc["out"], F.array(F.struct(text.alias("s"), F.length(text).alias("len")))))
                .alias("out"),
            )

        body = F.slice(parts, F.lit(1), F.size(parts) - 1)
        tail = F.element_at(parts, -1)["s"]
        return F.aggregate(
            body,
            zero,
            step,
            lambda acc: bind(
                F.concat(acc["open"], tail),
                lambda text: F.concat(acc["out"], F.array(F.struct(text.alias("s"), F.length(text).alias("len")))),
            ),
        )

    return bind(
        bind(F.split(content, F.concat(F.lit(r"\Q"), separator, F.lit(r"\E")), -1), with_end),
        lambda parts: F.when(F.size(ranges) == 0, parts).otherwise(glue(parts)),
    )


def _pack(parts: Column, sec: Column, start: Column, size: Column) -> Column:
    """Join neighbouring parts greedily up to ``size``; a part above it stays alone for the next level."""
    zero = F.struct(
        start.cast("int").alias("pos"),
        F.lit("").alias("buf"),
        F.lit(0).alias("buf_len"),
        F.lit(0).alias("buf_start"),
        _pieces().alias("out"),
    )

    def step(acc: Column, part: Column) -> Column:
        big = part["len"] > size
        fits = acc["buf_len"] + part["len"] <= size
        after = acc["pos"] + part["len"]
        buffered = F.when(acc["buf_len"] > 0, F.array(_piece(sec, acc["buf"], acc["buf_start"]))).otherwise(_pieces())
        return F.struct(
            after.alias("pos"),
            F.when(big, F.lit("")).when(fits, F.concat(acc["buf"], part["s"])).otherwise(part["s"]).alias("buf"),
            F.when(big, F.lit(0)).when(fits, acc["buf_len"] + part["len"]).otherwise(part["len"]).alias("buf_len"),
            F.when(fits & (acc["buf_len"] > 0), acc["buf_start"]).otherwise(acc["pos"]).alias("buf_start"),
            F.when(big, F.concat(acc["out"], buffered, F.array(_piece(sec, part["s"], acc["pos"]))))
            .when(fits, acc["out"])
            .otherwise(F.concat(acc["out"], buffered))
            .alias("out"),
        )

    return F.aggregate(
        parts,
        zero,
        step,
        lambda acc: F.when(
            acc["buf_len"] > 0, F.concat(acc["out"], F.array(_piece(sec, acc["buf"], acc["buf_start"])))
        ).otherwise(acc["out"]),
    )


def _packed(content: Column, separator: Column, sec: Column, start: Column, size: Column) -> Column:
    """The same as :func:`_pack` over :func:`_parts` for a separator of one character and without protected ranges.

    One match is a piece: as many whole parts as fit into ``size``, or one part above it.
    """
    sep = F.concat(F.lit(r"\Q"), separator, F.lit(r"\E"))
    fits = F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}(?:(?<="), sep, F.lit(r")|\z)"))
    pattern = F.concat(fits, F.lit("|[^"), sep, F.lit("]+"), sep, F.lit("?"))
    zero = F.struct(start.cast("int").alias("pos"), _pieces().alias("out"))
    return F.aggregate(
        F.regexp_extract_all(content, pattern, F.lit(0)),
        zero,
        lambda acc, part: F.struct(
            (acc["pos"] + F.length(part)).cast("int").alias("pos"),
            F.concat(acc["out"], F.array(_piece(sec, part, acc["pos"]))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _hard_cut(piece: Column, size: Column, ranges: Column) -> Column:
    """Fixed-width cuts; a cut inside a protected range moves behind it and over the newlines that follow."""
    sec, content, start = piece["sec"], piece["content"], piece["start"]
    plain = F.transform(
        F.sequence(F.lit(0), F.length(content) - 1, size),
        lambda i: _piece(sec, F.substring(content, i + 1, size), start + i),
    )
    zero = F.struct(F.lit(0).alias("cursor"), _pieces().alias("out"))

    def step(acc: Column, _: Column) -> Column:
        length = F.length(content)
        fixed = F.least(acc["cursor"] + size, length)
        hits = F.filter(ranges, lambda r: (r["start"] <= start + fixed) & (start + fixed < r["stop"]))
        moved = bind(
            F.least(F.element_at(hits, 1)["stop"], start + length) - start,
            lambda stop: stop + F.length(F.regexp_extract(F.substring(content, stop + 1, length), r"^\n*", 0)),
        )
        wanted = F.when(F.size(hits) > 0, moved).otherwise(fixed)
        return F.when(acc["cursor"] >= length, acc).otherwise(
            bind(
                F.when(wanted <= acc["cursor"], fixed).otherwise(wanted).cast("int"),
                lambda stop: F.struct(
                    stop.alias("cursor"),
                    F.concat(
                        acc["out"],
                        F.array(
                            _piece(
                                sec,
                                F.substring(content, acc["cursor"] + 1, stop - acc["cursor"]),
                                start + acc["cursor"],
                            )
                        ),
                    ).alias("out"),
                ),
            )
        )

    moving = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.length(content) / size).cast("int")), zero, step, lambda acc: acc["out"]
    )
    return F.when(F.size(ranges) == 0, plain).otherwise(moving)


def _above(content: Column, size: Column) -> Column:
    """Longer than ``size``; characters are only counted where there are more bytes than that."""
    return (F.octet_length(content) > size) & (F.length(content) > size)


def _level(pieces: Column, separator: Column, size: Column, ranges: Column) -> Column:
    """One step down: pieces above ``size`` that hold the separator are cut at it and packed again."""

    def plain(p: Column) -> Column:
        # Characters of two UTF-16 units beside others make the matcher recurse, so such texts are packed part by part.
        free = ~overlaps(p["start"], p["start"] + F.length(p["content"]), _of(ranges, p))
        return (F.length(separator) == 1) & free & ~p["content"].rlike(WIDE)

    def cut(p: Column) -> Column:
        parts = _parts(p["content"], separator, p["start"], _of(ranges, p))
        return F.when(plain(p), _packed(p["content"], separator, p["sec"], p["start"], size)).otherwise(
            _pack(parts, p["sec"], p["start"], size)
        )

    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(_above(p["content"], size) & F.contains(p["content"], separator), cut(p)).otherwise(F.array(p)),
        )
    )


def _levels(pieces: Column, separators: Column, size: Column, ranges: Column) -> Column:
    """All steps down, in one fold over the separators; texts without a piece above ``size`` are passed on."""
    return F.aggregate(
        separators,
        pieces,
        lambda p, sep: F.when(F.exists(p, lambda x: _above(x["content"], size)), _level(p, sep, size, ranges)).otherwise(p),
    )


def _last_level(pieces: Column, size: Column, ranges: Column) -> Column:
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(_above(p["content"], size), _hard_cut(p, size, _of(ranges, p))).otherwise(F.array(p)),
        )
    )


def _of(ranges: Column, piece: Column) -> Column:
    """Protected ranges of the section a piece belongs to."""
    return F.element_at(ranges, piece["sec"] + 1)


def _lone_heading(content: Column) -> Column:
    return F.startswith(content, F.lit("#")) & ~F.contains(content, F.lit("\n")) & content.rlike(r"(?U)^#{1,6}\s")


def _follows(out: Column, piece: Column) -> Column:
    return (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["sec"] == piece["sec"])


def _join_lone_headings(pieces: Column) -> Column:
    joined = F.aggregate(
        pieces,
        _pieces(),
        lambda out, p: F.when(
            _lone_heading(p["content"]) & _follows(out, p), _append_last(out, F.concat(F.lit("\n"), p["content"]))
        ).otherwise(F.concat(out, F.array(p))),
    )
    return F.when(F.exists(pieces, lambda p: _lone_heading(p["content"])), joined).otherwise(pieces)


def _join_blank_after_code(pieces: Column, ranges: Column) -> Column:
    """A blank piece of at most two characters right behind protected text joins its neighbour."""

    def micro(content: Column, p: Column) -> Column:
        near = F.exists(_of(ranges, p), lambda r: (p["start"] - r["stop"]).between(0, 2))
        return (F.length(content) <= 2) & (strip(content) == "") & near

    zero = F.struct(F.lit(-1).alias("sec"), F.lit("").alias("carry"), _pieces().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        def place(content: Column) -> Column:
            blank = micro(content, p)
            first = ~_follows(acc["out"], p)
            return F.struct(
                p["sec"].alias("sec"),
                F.when(blank & first, content).otherwise(F.lit("")).alias("carry"),
                F.when(blank & first, acc["out"])
                .when(blank, _append_last(acc["out"], content))
                .otherwise(F.concat(acc["out"], F.array(_piece(p["sec"], content, p["start"]))))
                .alias("out"),
            )

        carried = F.when(acc["sec"] == p["sec"], acc["carry"]).otherwise(F.lit(""))
        return bind(F.concat(carried, p["content"]), place)

    return F.when(F.forall(ranges, lambda r: F.size(r) == 0), pieces).otherwise(
        F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    )


def _overlap(pieces: Column, ranges: Column, width: Column) -> Column:
    """Prefix each piece with the tail of the (already prefixed) piece before, unless that tail is protected."""
    zero = F.struct(F.lit("").alias("tail"), F.lit(-1).alias("sec"), _pieces().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        blocked = overlaps(p["start"] - F.length(acc["tail"]), p["start"], _of(ranges, p))
        content = F.when((acc["sec"] == p["sec"]) & ~blocked, F.concat(acc["tail"], p["content"])).otherwise(
            p["content"]
        )
        return bind(
            content,
            lambda c: F.struct(
                F.right(c, width).alias("tail"),
                p["sec"].alias("sec"),
                F.concat(acc["out"], F.array(_piece(p["sec"], c, p["start"]))).alias("out"),
            ),
        )

    return F.when(width <= 0, pieces).otherwise(F.aggregate(pieces, zero, step, lambda acc: acc["out"]))


def _code(texts: Column) -> Column:
    return F.transform(texts, fence_ranges)


def _code_and_tables(texts: Column, tables: Column) -> Column:
    none = F.array().cast(RANGE_TYPE)
    return F.transform(
        texts, lambda t: F.concat(fence_ranges(t), F.when(tables, protected_table_ranges(t)).otherwise(none))
    )


def _whole(texts: Column) -> Column:
    return F.filter(F.transform(texts, lambda t, i: _piece(i, t, F.lit(0))), lambda p: p["content"] != "")


def split_sections(
    df: DataFrame,
    sections: Column,
    size: Column | int,
    overlap: Column | int,
    out: str,
    separators: tuple[str, ...] = DEFAULTS.separators,
    protect_tables: Column | None = None,
) -> DataFrame:
    """Add ``out``: the pieces of every section of a row, as ``array<struct<sec,content,start>>``.

    ``sections`` is an array of texts. Separators are tried from coarse to fine and stay at the end of a piece;
    fenced code (and tables, where ``protect_tables`` holds) is never cut. Lone headings and blank crumbs join
    their neighbour, and each piece but the first of a section carries the last ``overlap`` characters of the one
    before.
    """
    size = F.lit(size) if isinstance(size, int) else size
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap

    step = df.withColumn("_size", size).withColumn("_over", overlap)
    step = pin(step, "_texts", sections)
    if protect_tables is None:
        step = pin(step, "_ranges", built(_code, "_texts"))
    else:
        step = step.withColumn("_tables", protect_tables)
        step = pin(step, "_ranges", built(_code_and_tables, "_texts", "_tables")).drop("_tables")
    step = pin(step, "_p", built(_whole, "_texts"))
    step = pin(step.withColumn("_seps", F.array(*map(F.lit, separators))), "_p", built(_levels, "_p", "_seps", "_size", "_ranges"))
    step = pin(step, "_p", built(_last_level, "_p", "_size", "_ranges"))
    step = pin(step, "_p", built(_join_lone_headings, "_p"))
    step = pin(step, "_p", built(_join_blank_after_code, "_p", "_ranges"))
    step = pin(step, out, built(_overlap, "_p", "_ranges", "_over"))
    return step.drop("_texts", "_seps", "_size", "_over", "_ranges", "_p")


def recursive_split(
    df: DataFrame, text: str, size: int, overlap: int = 0, out: str = "pieces", protect_tables: Column | None = None
) -> DataFrame:
    """Add the pieces of one text column."""
    return split_sections(df, F.array(F.col(text)), size, overlap, out, protect_tables=protect_tables)


def heading_sections(text: Column, max_level: int = DEFAULTS.max_heading_level) -> Column:
    """Sections of the heading tree: path from the root, content and start."""

    def build(items: Column) -> Column:
        n = F.size(items)
        stack_type = "array<struct<level:int,text:string>>"
        zero = F.struct(
            F.array().cast(stack_type).alias("stack"),
            F.array().cast("array<struct<path:array<string>,start:int>>").alias("out"),
        )

        def push(acc: Column, h: Column) -> Column:
            return bind(
                F.concat(
                    F.filter(acc["stack"], lambda s: s["level"] < h["level"]),
                    F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"))),
                ),
                lambda stack: F.struct(
                    stack.alias("stack"),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.struct(
                                F.transform(stack, lambda s: s["text"]).alias("path"),
                                h["char_start"].alias("start"),
                            )
                        ),
                    ).alias("out"),
                ),
            )

        paths = F.aggregate(items, zero, push, lambda acc: acc["out"])

        def cut(p: Column) -> Column:
            stops = F.concat(
                F.transform(F.slice(p, F.lit(2), n - 1), lambda x: x["start"]), F.array(F.length(text))
            )
            sections = F.zip_with(
                p,
                stops,
                lambda a, stop: F.struct(
                    a["path"].alias("section_path"),
                    F.substring(text, a["start"] + 1, stop - a["start"]).alias("content"),
                    a["start"].alias("start"),
                ),
            )
            lead = F.substring(text, F.lit(1), F.element_at(p, 1)["start"])
            head = F.when(
                lead.rlike(r"(?U)\S"),
                F.array(
                    F.struct(
                        F.array().cast("array<string>").alias("section_path"),
                        lead.alias("content"),
                        F.lit(0).alias("start"),
                    )
                ),
            ).otherwise(F.array().cast(SECTION_TYPE))
            return F.concat(head, sections)

        whole = F.array(
            F.struct(
                F.array().cast("array<string>").alias("section_path"),
                text.alias("content"),
                F.lit(0).alias("start"),
            )
        ).cast(SECTION_TYPE)
        return F.when(n == 0, whole).otherwise(_join_lone_sections(bind(paths, cut)))

    return bind(F.filter(headings(text), lambda h: h["level"] <= max_level), build)


def _join_lone_sections(sections: Column) -> Column:
    """A section without a body joins the one before it."""

    def lone(content: Column) -> Column:
        return ~content.rlike(r"(?U)\A[^\n]*+\n\s*+\S") & content.rlike(r"(?U)\S")

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(
            last["section_path"].alias("section_path"),
            F.concat(last["content"], F.lit("\n"), s["content"]).alias("content"),
            last["start"].alias("start"),
        )
        return F.when(
            lone(s["content"]) & (F.size(out) > 0),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined)),
        ).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(sections, F.array().cast(SECTION_TYPE), step)
