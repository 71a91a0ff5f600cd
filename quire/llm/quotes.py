"""Conversations in reply order, with quotations replaced by links.

Lines of a message carry a quote level (the number of leading ``>`` signs). Level 0 is what its author wrote; a run of
lines of one deeper level is a quoted passage. Passages are normalised (white space joined, A to Z lower-cased, quote
signs gone) and hashed; so are the whole own text of every message and its pieces: paragraphs, lines, and for lines under
``MIN_CHARS`` the shortest windows of lines from there and up to there that are long enough. A passage belongs to the
latest earlier message of its conversation that wrote it, else to the smallest message of another conversation that
did. A passage that nobody wrote as a whole is taken by its pieces, each of them linked in that way: any run of lines of a
message is covered by its windows, wherever it was cut out. The passage then belongs to the message of its longest linked
piece, one of the same conversation first. A message replies to the message that its first outermost linked passage
comes from (a deeper level is what that one quoted itself); without one it replies to nothing and starts a thread. The
own text stays, with each linked passage or piece dropped; what links nowhere is kept as written, since nothing else
holds it. Blank lines in a passage go with the line above them.

Threads are found by pointer jumping. A reply is always later than what it quotes, so threads in the order of their
first turn, and turns in their order inside, put every message after the one it answers. Places are counted in ranges of
rows and stitched, so a conversation or thread of any length is never gathered in one task. Originals are merged by
hash before they meet the passages; the joins have plain keys, which adaptive execution can split.

Defined cases: a null text is empty and quotes nothing; null roles, turns and conversations are values like others and
come first; rows equal in all four columns are one message, counted in ``copies``; messages that share a turn are ordered
by role and text; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, materialize

#: Passages shorter than this are not linked: a quoted "yes" has no one author.
MIN_CHARS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = r"^((?:[ \t]*>)+)[ \t]?"


def normalised(text: Column) -> Column:
    return F.translate(F.btrim(F.regexp_replace(text, SPACE + "+", " ")), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    """Lines as structs of ``level`` and ``line`` (without the quote signs)."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, _MARK, "").alias("line"),
        ),
    )


def passages_of(lines: Column) -> Column:
    """Maximal runs of lines of one level: structs of ``level``, ``text`` and ``raw`` (with the signs put back).

    The starts of runs are found first and each run is one slice, so the work is linear in the lines.
    """
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    return F.transform(F.array(starts), lambda s: F.transform(s, lambda a, k: _run(lines, a, F.coalesce(F.get(s, k + 1), n))))[0]


def _run(lines: Column, a: Column, b: Column) -> Column:
    level = F.get(lines, a)["level"]
    own = F.transform(F.slice(lines, a + 1, b - a), lambda x: x["line"])
    raw = F.transform(own, lambda x: F.concat(F.repeat(F.lit(">"), level), F.when(level > 0, F.lit(" ")).otherwise(F.lit("")), x))
    return F.struct(level.alias("level"), F.array_join(own, "\n").alias("text"), F.array_join(raw, "\n").alias("raw"))


def messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table of distinct messages ``conv, turn, role, body, copies, mid`` and their ``runs``."""
    rows = turns.groupBy(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("body")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    rows = materialize(rows.withColumn("mid", F.monotonically_increasing_id()), "messages")
    cut = rows.withColumn("_lines", F.explode(F.array(lines_of(F.col("body")))))
    return materialize(cut.withColumn("runs", F.explode(F.array(passages_of(F.col("_lines"))))).drop("_lines"), "message-runs")


def _pieces(rows: DataFrame, text: str) -> DataFrame:
    """Explode the texts into ``a, b`` (first and last line), ``whole`` and the normalised ``t`` of their pieces.

    Lists that lambdas look into are columns of their own, so the work is linear in the lines.
    """
    keep = [F.col(c) for c in rows.columns if c != text]
    cut = rows.select(*keep, F.explode(F.array(F.transform(F.split(text, "\n", -1), normalised))).alias("_l"))
    at = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.get("_l", i) != "")
    cut = cut.withColumn("_at", F.explode(F.array(at))).withColumn("_w", F.explode(F.array(F.filter("_l", lambda x: x != "")))).where(F.size("_at") > 0)
    n, m = F.size("_l"), F.size("_at")
    places = F.sequence(F.lit(0), m - 1)
    cut = cut.withColumn("_p", F.explode(F.array(F.filter(places, lambda k: (k == 0) | (F.get("_at", k - 1) + 1 != F.get("_at", k))))))

    def piece(start: Column, end: Column, whole: bool = False) -> Column:
        first = F.when(start == 0, 0).otherwise(F.get("_at", start))
        last = F.when(end >= m, n - 1).otherwise(F.get("_at", end) - 1)
        return F.struct(first.alias("a"), last.alias("b"), F.lit(whole).alias("whole"), F.array_join(F.slice("_w", start + 1, end - start), " ").alias("t"))

    def long_enough(start: Column, end: Column) -> Column:
        return F.when((start >= 0) & (end <= m), F.when(F.length(F.array_join(F.slice("_w", F.greatest(start, F.lit(0)) + 1, end - start), " ")) >= MIN_CHARS, piece(start, end)))

    # lines that are not blank and the space between them: this many reach the length
    sizes = range(1, MIN_CHARS // 2 + 2)
    onward = F.transform(places, lambda k: F.coalesce(*[long_enough(k, k + w) for w in sizes]))
    back = F.transform(places, lambda k: F.coalesce(*[long_enough(k - w + 1, k + 1) for w in sizes]))
    paragraphs = F.transform("_p", lambda s, j: piece(s, F.coalesce(F.get("_p", j + 1), m)))
    every = F.array_distinct(F.concat(F.array(piece(F.lit(0), m, True)), paragraphs, F.array_compact(onward), F.array_compact(back)))
    return cut.select(*keep, F.inline(every)).where(F.length("t") >= MIN_CHARS)


def _originals(rows: DataFrame) -> DataFrame:
    """``hash, conv, turn, mid`` of everything a message wrote itself: its own text and each own run, whole and in pieces."""
    own = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"])
    cut = rows.select("conv", "turn", "mid", F.explode(F.array_distinct(F.concat(F.array(F.array_join(own, "\n")), own))).alias("own"))
    return _pieces(cut, "own").select(F.md5("t").alias("hash"), "conv", "turn", "mid").distinct()


def _links(rows: DataFrame) -> DataFrame:
    """``mid, place, level`` of linked passages with the message ``to`` they come from and the lines ``gone`` with the links."""
    quoted = rows.select("conv", "turn", "mid", F.posexplode("runs").alias("place", "run")).where("run.level > 0")
    quoted = _pieces(quoted.select("conv", "turn", "mid", "place", F.col("run.level").alias("level"), F.col("run.text").alias("_text")), "_text")
    quoted = quoted.withColumn("piece", F.struct("place", "level", "a", "b", "whole", F.length("t").alias("n")))
    quoted = materialize(quoted.select("conv", "turn", "mid", "piece", F.md5("t").alias("hash")), "quoted")
    wrote = materialize(_originals(rows).join(quoted.select("hash").distinct(), "hash", "left_semi"), "originals")

    # the latest earlier message of the same conversation: both kinds of row in one order, the last original carries on
    none = F.lit(None).cast(quoted.schema["piece"].dataType)
    both = wrote.select("hash", "conv", "turn", F.lit(1).alias("kind"), "mid", none.alias("piece")).union(
        quoted.select("hash", "conv", "turn", F.lit(0).alias("kind"), "mid", "piece")
    )
    order = Window.partitionBy("conv", "hash").orderBy("turn", "kind", "mid").rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("to", F.last(F.when(F.col("kind") == 1, F.col("mid")), ignorenulls=True).over(order)).where("kind = 0")
    # else the smallest writer anywhere, one row per hash
    anywhere = wrote.groupBy("hash").agg(F.min(F.struct("conv", "turn", "mid")).alias("_w"))
    other = inside.where("to IS NULL").drop("to").join(anywhere, "hash").where(~F.col("conv").eqNullSafe(F.col("_w.conv")))
    linked = inside.where("to IS NOT NULL").select("mid", "piece.*", "to", F.lit(True).alias("same")).union(
        other.select("mid", "piece.*", F.col("_w.mid").alias("to"), F.lit(False).alias("same"))
    )
    # the whole passage covers all its lines; else the longest piece names the message
    best = F.min(F.struct(~F.col("whole"), ~F.col("same"), -F.col("n"), "a", "to", "same")).alias("_b")
    found = linked.groupBy("mid", "place", "level").agg(best, F.collect_list(F.sequence("a", "b")).alias("_gone"))
    return found.select("mid", "place", "level", "_b.to", "_b.same", F.array_distinct(F.flatten("_gone")).alias("gone"))


def _unlinked(raw: Column, gone: Column) -> Column:
    """The lines of a passage that are not ``gone``; null if none is left."""

    def kept(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.when(F.size(stay) > 0, F.array_join(F.transform(stay, lambda j: F.get(x["lines"], j)), "\n"))

    pair = F.struct(F.split(raw, "\n", -1).alias("lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))
    return F.transform(F.array(pair), kept)[0]


def _threads(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """``mid, root, depth`` by pointer jumping over ``mid, to``; the rounds grow with the logarithm of the depth."""
    now = materialize(
        rows.select("mid").join(replies, "mid", "left").select("mid", F.coalesce("to", "mid").alias("up"), F.col("to").isNotNull().cast("int").alias("depth")), "threads"
    )
    while True:
        above = now.where("depth > 0").select(F.col("mid").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        if not now.where("depth > 0").join(above, "up").limit(1).count():
            return now.select("mid", F.col("up").alias("root"), "depth")
        jumped = now.join(above, "up", "left")
        now = materialize(
            jumped.select("mid", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "threads"
        )


def _placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the place (from 0) of each row in its group, counted by ranges of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "placed")
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offsets = offsets.where("_before > 0").toDF(*[f"_g{i}" for i in range(len(group))], "_r", "_before")
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = ranged.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(offsets, same, "left").select(*rows.columns, (F.col("_k") + F.coalesce("_before", F.lit(0))).alias(name))


def reply_ordered(turns: DataFrame) -> DataFrame:
    """One row per message.

    ``conv_id, turn, role, copies``; ``reply_conv, reply_turn``: the message it answers; ``thread_turn``: first turn of
    its thread within the conversation; ``depth``: replies above it; ``position``: place in the reply-ordered
    conversation; ``n_quotes``, ``n_linked``: passages, and those linked as a whole or in part; ``text``: own words and
    what is quoted from nowhere.
    """
    rows = messages(turns)
    links = materialize(_links(rows), "links")
    # the first outermost passage with a link decides; a conversation is ordered by links inside it
    chosen = links.groupBy("mid").agg(
        F.min(F.struct("level", "place", "to", "same")).alias("b"), F.count(F.lit(1)).alias("n_linked"),
        F.map_from_entries(F.collect_list(F.struct("place", "gone"))).alias("gone"),
    )
    replies = materialize(chosen.select("mid", F.col("b.to").alias("to"), F.col("b.same").alias("same"), "n_linked", "gone"), "replies")
    threads = _threads(rows, replies.where("same").select("mid", "to"))
    keyed = rows.join(replies, "mid", "left").join(threads, "mid")
    target = rows.select(F.col("mid").alias("to"), F.col("conv").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    first = rows.select(F.col("mid").alias("root"), F.col("turn").alias("thread_turn"))
    full = keyed.join(target, "to", "left").join(first, "root")
    left = F.filter(
        F.transform("runs", lambda r, i: F.when(r["level"] == 0, r["raw"]).otherwise(_unlinked(r["raw"], F.try_element_at("gone", i)))),
        lambda x: x.isNotNull(),
    )
    full = full.select(
        "conv", "thread_turn", "root", "turn", "role", "body", "mid", "copies", "reply_conv", "reply_turn", "depth",
        F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.array_join(left, "\n").alias("text"),
    )
    placed = _placed(full, ["conv"], ["thread_turn", "root", "turn", "role", "body"], "position")
    return placed.select(
        F.col("conv").alias("conv_id"), "turn", "role", "copies", "reply_conv", "reply_turn", "thread_turn", "depth",
        F.col("position").cast("bigint").alias("position"), "n_quotes", "n_linked", "text",
    )


def op1_quotes(turns: DataFrame) -> DataFrame:
    """The reply-ordered messages with a digest in place of the text."""
    return reply_ordered(turns).select(
        "conv_id", "turn", "role", "copies", "reply_conv", "reply_turn", "thread_turn", "depth", "position", "n_quotes", "n_linked", F.sha2("text", 256).alias("text_sha256")
    )
