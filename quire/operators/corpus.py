"""Corpus operators: text containment, guards against leaked answers, robustness test, pass rates, question budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.core import pin
from quire.operators.runs import signed_ranks, wilcoxon_p
from quire.session import materialize
from quire.settings import DEFAULTS, Settings


def windows(text: Column, width: int) -> Column:
    """Distinct character windows of a text; empty when it is shorter. Cut from one-line chunks to stay linear."""
    # Substring by character position is linear in the position, so the text is first cut into blocks.
    block = 128
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(block))
    parts = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(block + width - 1)))
    cut = F.transform(
        parts,
        lambda p: F.when(F.length(p) < width, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.least(F.lit(block), F.length(p) - width + 1)), lambda i: F.substring(p, i, F.lit(width))
            )
        ),
    )
    return F.array_distinct(F.flatten(cut))


#: Needles and their pieces up to this many rows are sent to every executor; more are joined by shuffle.
BROADCAST_NEEDLES = 200_000


def _near(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    keys = materialize(keys.distinct(), "needles")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_NEEDLES else keys, on, "left_semi")


def containing(texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle: str, width: int) -> DataFrame:
    """Distinct ids of texts that contain some needle of exactly ``width`` characters.

    A text is cut into pieces of half a needle, end to end. Every occurrence of a needle covers one of them whole, so only around
    pieces that occur in a needle are all windows compared.
    """
    size = (width + 1) // 2
    block, side = 128 // size * size or size, width - size
    found = needles.where(F.length(needle) == width).select(F.col(needle).alias("_w"))
    pieces = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(side + 1)), lambda i: F.substring("_w", i, F.lit(size)))).alias("_p"))
    # Substring by character position is linear in the position, so the text is first cut into blocks, each with its surroundings.
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(block))
    parts = texts.select(text_id, F.explode(F.transform(starts, lambda s: _around(F.col(text), s, block, side))).alias("_b"))
    parts = parts.select(text_id, "_b.lead", "_b.part", F.explode(F.sequence(F.lit(0), F.lit(block - size), F.lit(size))).alias("_i"))
    at = F.col("lead") + F.col("_i")
    cut = parts.select(text_id, "part", at.alias("at"), F.substring(F.col("part"), at + 1, F.lit(size)).alias("_p")).where(F.length("_p") == size)
    first = F.greatest(F.col("at") - side, F.lit(0)) + 1
    near = _near(cut, pieces, "_p").select(text_id, "part", F.explode(F.sequence(first, F.col("at") + 1)).alias("_s"))
    near = near.select(text_id, F.substring(F.col("part"), F.col("_s"), F.lit(width)).alias("_w"))
    return _near(near, found, "_w").select(text_id).distinct()


def _around(text: Column, start: Column, block: int, side: int) -> Column:
    """A block of a text with up to ``side`` characters on either side, and how many of them stand before it."""
    lead = F.least(start, F.lit(side))
    return F.struct(lead.alias("lead"), F.substring(text, start - lead + 1, lead + block + side).alias("part"))


def guard_hits(docs: DataFrame, facts: DataFrame, doc_id: str = "doc_id", text: str = "text", fact: str = "fact", cfg: Settings = DEFAULTS) -> DataFrame:
    """Ids of documents that share a guard-width window with a fact, or contain a shorter fact whole."""
    width = cfg.guard_window
    long = pin(facts.where(F.length(fact) >= width).select(fact), "_f", windows(F.col(fact), width))
    found = containing(docs, long.select(F.explode("_f").alias("needle")), doc_id, text, "needle", width)
    short = facts.where((F.length(fact) > 0) & (F.length(fact) < width)).select(F.col(fact).alias("needle"))
    # At most width - 1 different lengths, each an equi-join of its own.
    for n in sorted(r[0] for r in short.select(F.length("needle")).distinct().collect()):
        found = found.unionByName(containing(docs, short, doc_id, text, "needle", n))
    return found.distinct()


def resolve_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Resolve (item, name) against known (doc_id, position): the same id, else the first that contains or is contained.

    Containment runs as an equi-join on substrings of the lengths that occur, not as a comparison of all pairs.
    Substrings compress so well that their shuffled size says little of their number, so the joins are by merge and none is sent whole.
    Names left without a match keep a null ``doc_id``.
    """
    lengths = [
        sorted(r[0] for r in df.select(F.length(c)).distinct().collect() if r[0])
        for df, c in ((known, "doc_id"), (wanted, "name"))
    ]

    def pieces(column: str, sizes: list[int]) -> Column:
        return F.array_distinct(
            F.flatten(
                F.transform(
                    F.array(*[F.lit(n) for n in sizes]),
                    lambda n: F.when(F.length(column) < n, F.array().cast("array<string>")).otherwise(
                        F.transform(
                            F.sequence(F.lit(1), F.greatest(F.length(column) - n + 1, F.lit(1))),
                            lambda i: F.substring(F.col(column), i, n),
                        )
                    ),
                )
            )
        )

    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as names are few bytes before they are cut
    names = wanted.select("name").where(F.length("name") > 0).repartition(parts, "name").distinct()
    inner = names.select("name", F.explode(pieces("name", lengths[0])).alias("doc_id")).join(known.hint("merge"), "doc_id")
    # Only the first known id per substring can win, so a substring that many ids share is one row before the join.
    outer = (
        known.select("doc_id", "position", F.explode(pieces("doc_id", lengths[1])).alias("name"))
        .groupBy("name")
        .agg(F.min(F.struct("position", "doc_id")).alias("k"))
        .select("name", "k.doc_id", "k.position")
        .join(names.hint("merge"), "name")
    )
    hits = inner.select("name", "doc_id", "position").unionByName(outer.select("name", "doc_id", "position"))
    best = hits.groupBy("name").agg(
        F.min(F.struct((F.col("name") != F.col("doc_id")).alias("inexact"), "position", "doc_id")).alias("m")
    )
    return wanted.join(best.select("name", F.col("m.doc_id").alias("doc_id")).hint("merge"), "name", "left")


def low_pass_rates(attempts: DataFrame, keys: list[str], at_least: int = 5, below: float = 0.3) -> DataFrame:
    """Groups with enough attempts whose pass rate is too low."""
    rows = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.col("passed").cast("long")).alias("passes")
    )
    return rows.withColumn("rate", F.col("passes") / F.col("attempts")).where(
        (F.col("attempts") >= at_least) & (F.col("rate") < below)
    )


def needle_verdict(stages: DataFrame, max_drop: float = 0.05, min_penetration: float = 0.10) -> DataFrame:
    """Robustness verdict over (stage, recall, mrr, penetrated) per query, stages clean, control and noisy."""
    def mean(stage: str, name: str) -> Column:
        return F.avg(F.when(F.col("stage") == stage, F.col(name)))

    row = stages.agg(
        *[mean(s, name).alias(f"{name}_{s}") for name in ("recall", "mrr") for s in ("clean", "control", "noisy")],
        F.coalesce(F.avg(F.when(F.col("stage") == "noisy", F.col("penetrated").cast("double"))), F.lit(0.0)).alias("penetration"),
    )
    drop = F.col("recall_control") - F.col("recall_noisy")
    return row.select(
        "*",
        (F.col("recall_clean") - F.col("recall_control")).alias("scale_drop"),
        drop.alias("interference_drop"),
        F.when(F.col("penetration") < min_penetration, "INCONCLUSIVE").when(drop < max_drop, "PASS").otherwise("FAIL").alias("verdict"),
    )


def staged_best(added: list[tuple[str, DataFrame]], k: int, key: str) -> DataFrame:
    """``stage, query_id, key, rank``: the best k of every stage of a growing corpus, from the best k of what each stage adds.

    ``added`` is (stage, hits with query_id, key and score) in order; a stage holds its own rows and those of all before. A group has
    k rows per stage at most.
    """
    rows, names = None, [name for name, _ in added]
    for i, (_, hits) in enumerate(added):
        part = hits.select("query_id", key, "score", F.explode(F.array(*[F.lit(n) for n in names[i:]])).alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("stage", "query_id").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("stage", "query_id", key, "rank")


def needle_p(stages: DataFrame, value: str = "recall") -> DataFrame:
    """``p_value`` of the signed-rank test between control and noisy, paired by query; 1 if no query changes, no row without pairs."""
    def side(stage: str, name: str) -> DataFrame:
        return stages.where(F.col("stage") == stage).select("query_id", F.col(value).cast("double").alias(name))

    pairs = side("control", "a").join(side("noisy", "b"), "query_id").withColumn("metric", F.lit(value))
    return signed_ranks(pairs).select(wilcoxon_p("n", "w_plus", "w_minus", "tie_term", "zeros").alias("p_value"))


def adjacent_pairs(parents: DataFrame) -> DataFrame:
    """Pairs of neighbouring parents (0,1), (2,3), ... per document for questions over two chunks.

    The two halves of a pair share the key (doc_id, number div 2), so they meet by an aggregation on that key and no
    window over a document is needed.
    """
    pair = F.floor(F.col("parent_no") / 2).cast("long").alias("pair_no")
    return parents.groupBy("doc_id", pair).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("chunk_id", "parent_no").alias("first_id"),
        F.max_by("chunk_id", "parent_no").alias("second_id"),
        F.concat_ws("\n\n---\n\n", F.min_by("content", "parent_no"), F.max_by("content", "parent_no")).alias("content"),
    ).where("_n = 2").drop("_n")


def stratified(df: DataFrame, stratum: str, order: str, sizes: dict[str, int]) -> DataFrame:
    """First rows per stratum in order; a stratum without a size is kept whole."""
    parts = [df.where(F.coalesce(~F.col(stratum).isin(*sizes), F.lit(True)))]
    parts += [df.where(F.col(stratum) == name).orderBy(order).limit(n) for name, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
