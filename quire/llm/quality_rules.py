"""Quality rules whose cutoffs are chosen with a bound on the share of good documents they reject.

Each text gets word, symbol, line and repetition counts in one row-local pass without any UDF. A rule rejects a
document when a share (symbols, capitals, repeated lines, repeated words) lies above a cutoff in percent. For every
stratum and rule the cutoffs of a fixed grid are tested from the loosest to the strictest on labelled documents: the
hypothesis "more than ``alpha`` of the good documents are rejected" is dropped when its exact binomial tail is at most
``delta`` divided by the number of (stratum, rule) pairs (Bonferroni), and the walk ends at the first cutoff that fails
(fixed sequence, so no further correction is needed along the grid). With probability ``1 - delta`` every cutoff that
passed rejects at most ``alpha`` of its stratum's good documents. Of those, the one that removes most more bad
than good labelled documents is used; a rule that helps nowhere stays off, and so does a stratum with too few labels.

Defined cases: a null or blank text has no words and fails the base rule; a null stratum is a stratum of its own;
documents with several labels count as good only if all say so; labels without a document and null labels are ignored;
repeated rows are judged alike; without labels no rule is on. Other columns are not touched by the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, broadcast_checked, materialize, pin, text_words

#: Cutoffs in percent, loosest first.
GRID = (90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10, 8, 5)
#: Rule name, numerator and denominator.
RULES = (
    ("symbols", "n_symbols", "word_chars"),
    ("capitals", "n_capitals", "word_chars"),
    ("lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA = 0.01
DELTA = 0.1


def _repeated_words(words: str) -> Column:
    """Words inside a three-word window that occurs at least twice, from an array column.

    Windows are compared by 64-bit hash. Texts without a repeat are settled by one distinct count. For the others the
    hash and the position share one long, so a primitive sort brings equal windows together; where the shortened
    hashes of two different windows meet, the text is done again with whole hashes.
    """
    grams = F.when(
        F.size(words) >= 3,
        F.transform(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(positions: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))

    def count(g: Column) -> Column:
        bits = F.ceil(F.log2(F.size(g) + 1.0)).cast("int")
        packed = F.sort_array(
            F.transform(g, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("bigint")))
        )

        def by_position(e: Column) -> Column:
            where = F.transform(e, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int"))

            def marked(p: Column) -> Column:
                hashes = F.transform(p, lambda q: F.get(g, q))

                def compare(h: Column) -> Column:
                    same = F.filter(
                        F.sequence(F.lit(0), F.size(p) - 1),
                        lambda k: (F.get(h, k) == F.get(h, k + 1)) | (F.get(h, k) == F.get(h, k - 1)),
                    )
                    met = F.exists(
                        F.sequence(F.lit(1), F.size(p) - 1),
                        lambda k: (F.get(h, k) != F.get(h, k - 1))
                        & (
                            F.call_function("shiftrightunsigned", F.get(e, k), bits)
                            == F.call_function("shiftrightunsigned", F.get(e, k - 1), bits)
                        ),
                    )
                    return F.when(met, whole(g)).otherwise(covered(F.transform(same, lambda k: F.get(p, k))))

                return _let(hashes, compare)

            return _let(where, marked)

        return _let(packed, by_position)

    def whole(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            pairs,
            lambda s: covered(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(s) - 1),
                        lambda k: (F.get(s, k)["h"] == F.get(s, k + 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k - 1)["h"]),
                    ),
                    lambda k: F.get(s, k)["i"],
                )
            ),
        )

    return _let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(count(g)),
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct column ``_stats`` with the fields of ``STATS`` (all long); no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = pin(docs, "_words", text_words(F.col(text)))
    kept_chars = F.length(F.regexp_replace(whole, SPACE + "+", ""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    cut = pin(cut, "_lines", F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0])
    stats = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        kept_chars.cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        _repeated_words("_words").cast("long").alias("n_repeat_words"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    return pin(cut, "_stats", stats).drop("_words", "_lines")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def _tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Binomial(n, alpha) <= k), summed term by term in logarithms; 1 where ``k`` is not below the mean."""
    odds = math.log(alpha / (1 - alpha))
    first = n * F.lit(math.log1p(-alpha))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        steps,
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda acc, i: _let(
            acc["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds),
            lambda t: F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s")),
        ),
        lambda acc: acc["s"],
    )
    return F.when(k >= n * F.lit(alpha), F.lit(1.0)).otherwise(total)


def good_labels(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row per labelled document: ``_id`` and ``_good``."""
    return (
        labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg((F.min(quality) == 1).alias("_good"))
    )


def calibrate(
    labelled: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, grid: tuple[int, ...] = GRID
) -> DataFrame:
    """Cutoffs per stratum from rows with ``_stats``, ``_good`` and the stratum column.

    Returns ``_stratum`` and one int column per rule (null: off). Everything after the first aggregation is a table of
    strata x rules x grid rows; no group of documents is gathered.
    """
    share = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                sum((100 * F.col(f"_stats.{num}") > c * F.col(f"_stats.{den}")).cast("int") for c in grid).alias("level"),
            )
            for name, num, den in RULES
        ]
    )
    counts = (
        labelled.where(~base_failed(F.col("_stats")))
        .select(F.col(stratum).alias("_stratum"), "_good", F.inline(share))
        .groupBy("_stratum", "rule", "level")
        .agg(F.sum(F.col("_good").cast("long")).alias("good"), F.sum((~F.col("_good")).cast("long")).alias("bad"))
    )
    group = Window.partitionBy("_stratum", "rule")
    # a level counts the cutoffs below a share, the strictest ones; cutoff j of n rejects the levels above n - j
    steps = counts.groupBy("_stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("level", "good", "bad")).alias("h"))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    above = lambda field: F.aggregate(
        F.filter("h", lambda x: x["level"] > F.lit(len(grid)) - F.col("step")), F.lit(0).cast("bigint"), lambda a, x: a + x[field]
    )
    steps = steps.select("_stratum", "rule", "step", "n", above("good").alias("k"), above("bad").alias("bad"))
    pairs = counts.select("_stratum").distinct().agg((F.count(F.lit(1)) * len(RULES)).alias("m"))
    tested = steps.join(F.broadcast(pairs)).withColumn(  # one row: the number of tests
        "failed", (_tail(F.col("n"), F.col("k"), alpha) * F.col("m") > delta).cast("int")
    )
    valid = tested.withColumn("stop", F.sum("failed").over(group.orderBy("step"))).where("stop = 0")
    chosen = valid.where("bad > k").groupBy("_stratum", "rule").agg(F.max_by("step", F.struct(F.col("bad") - F.col("k"), -F.col("step"))).alias("step"))
    percent = F.element_at(F.array(*[F.lit(c) for c in grid]), F.col("step"))
    per_rule = [F.max(F.when(F.col("rule") == name, percent)).alias(name) for name, _, _ in RULES]
    return chosen.groupBy("_stratum").agg(*per_rule)


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``_base_failed`` and ``_kept``. The cutoffs have one row per stratum and are sent out only if few."""
    table = cutoffs.select(F.col("_stratum").alias("_s"), F.struct(*[r[0] for r in RULES]).alias("_cut"))
    joined = stats.join(broadcast_checked(table), stats[stratum].eqNullSafe(F.col("_s")), "left")
    rejected = F.lit(False)
    for name, num, den in RULES:
        hit = 100 * F.col(f"_stats.{num}") > F.col(f"_cut.{name}") * F.col(f"_stats.{den}")
        rejected = rejected | F.coalesce(hit, F.lit(False))
    return joined.select(
        *[F.col(c) for c in stats.columns],
        base_failed(F.col("_stats")).alias("_base_failed"),
        (~(base_failed(F.col("_stats")) | rejected)).alias("_kept"),
    )


def labelled_docs(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The labelled documents with ``_good``; the labels are sent to the documents while their number allows it."""
    good = good_labels(labels, doc_id)
    return docs.join(broadcast_checked(good), docs[doc_id] == good["_id"]).drop("_id")


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang"
) -> DataFrame:
    """The documents that pass, with their columns. Counts are made twice for labelled texts, no text is shuffled."""
    names = docs.columns
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.col(stratum).alias("_lang"),
    )
    narrow = inner.select("_doc", "_text", "_lang")
    cutoffs = materialize(
        calibrate(with_stats(labelled_docs(narrow, labels.select(F.col("doc_id").alias("_doc"), "quality"), "_doc"), "_text"), "_lang"),
        "quality-cutoffs",
    )
    return judge(with_stats(inner, "_text"), cutoffs, "_lang").where("_kept").select("_row.*")


def op9_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict per document: ``doc_id``, the base counts, ``base_failed`` and ``kept``."""
    stats = with_stats(docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.col("lang").alias("_lang")), "_text")
    stats = materialize(stats.drop("_text"), "quality-stats")  # read by the calibration and by the verdict
    cutoffs = materialize(calibrate(labelled_docs(stats, labels.select(F.col("doc_id").alias("_doc"), "quality"), "_doc"), "_lang"), "quality-cutoffs")
    return judge(stats, cutoffs, "_lang").select(
        F.col("_doc").alias("doc_id"),
        *[F.col(f"_stats.{c}").alias(c) for c in STATS],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


GRID_SQL = "[" + ", ".join(map(str, GRID)) + "]"
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
   list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM d),
 g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
 g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
 r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY rid),
 s AS (SELECT d.rid, d.doc_id, d.lang, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
   len(ls) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
 gl AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
 x AS (SELECT lang, good, unnest([{{'rule': 'symbols', 'a': n_symbols, 'b': word_chars}}, {{'rule': 'capitals', 'a': n_capitals, 'b': word_chars}},
   {{'rule': 'lines', 'a': n_dup_lines, 'b': n_lines}}, {{'rule': 'repeats', 'a': n_repeat_words, 'b': n_words}}]) AS u FROM f JOIN gl USING (doc_id) WHERE NOT base_failed),
 y AS (SELECT lang, u.rule AS rule, step, c, count(*) FILTER (good) AS n, count(*) FILTER (good AND 100 * u.a > c * u.b) AS k, count(*) FILTER (NOT good AND 100 * u.a > c * u.b) AS bad
   FROM x, (SELECT unnest({GRID_SQL}) AS c, unnest(range(1, {len(GRID) + 1})) AS step) GROUP BY ALL),
 p AS (SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS tail FROM y),
 v AS (SELECT *, sum(CASE WHEN tail * (SELECT count(DISTINCT coalesce(lang, '~')) * 4 FROM y) > {DELTA} THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY step) AS stop FROM p),
 ch AS (SELECT lang, rule, arg_max(c, (bad - k) * 1000 - step) AS c FROM v WHERE stop = 0 AND bad > k GROUP BY lang, rule),
 cut AS (SELECT lang, max(c) FILTER (rule = 'symbols') AS c1, max(c) FILTER (rule = 'capitals') AS c2, max(c) FILTER (rule = 'lines') AS c3, max(c) FILTER (rule = 'repeats') AS c4 FROM ch GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed,
 NOT (base_failed OR coalesce(100 * n_symbols > c1 * word_chars, FALSE) OR coalesce(100 * n_capitals > c2 * word_chars, FALSE)
   OR coalesce(100 * n_dup_lines > c3 * n_lines, FALSE) OR coalesce(100 * n_repeat_words > c4 * n_words, FALSE)) AS kept
FROM f LEFT JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang"""
