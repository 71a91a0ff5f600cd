"""Line deduplication across documents: equal lines, and lines one edit apart by a segment-partition join.

Lines are cut at ``\\n`` and compared without white space at their ends. In the order of (document id, text hash, line
number) a line goes if an equal line came before, or if a line within ``THRESHOLD`` edit of it has an earlier first
occurrence. Near matching is for lines of at least ``MIN_CHARS`` characters; shorter ones and blank ones need equality,
blank ones always stay. All other lines keep their bytes, so texts without repeats come back unchanged.

Method. Two lines one edit apart share one of the ``THRESHOLD + 1`` segments of the shorter line at a known place, so
every line is indexed by its two halves and probed by the two halves it would share with a line one shorter. Only
buckets with two different lines go on. Buckets of up to ``BUCKET`` lines are joined on themselves and each pair
is verified by a banded bit-parallel distance on whole lines. In larger buckets the other half is cut into ``BLOCKS`` blocks
and lines meet if they agree on all but one block; where even that is large, they meet if they agree after deletion of one
character of the block. Lines that meet there are one edit apart as they stand, so each is compared with the earliest
only. No group is ever paired with itself beyond ``BUCKET`` lines, and no row is dropped for its frequency.

Everything is DataFrame code. Texts are shuffled once, to meet their lists of removed lines; lines travel as 128-bit
hashes, which also stand for equality. Frequent lines are merged before they are shuffled.

Defined cases: a null text stays null and has no lines, an empty text stays empty; a text that loses all its lines
becomes empty; repeated rows (same id and text) are one document to the order and get the same result; null ids are
ordinary ids that come first; ties cannot occur, as a line number is unique in a document; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE_CHARS, broadcast_checked, materialize

THRESHOLD = 1
MIN_CHARS = 16
BUCKET = 64
BLOCKS = 16


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _two(*parts: Column) -> list[Column]:
    """A 128-bit hash as two longs."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def edit_distance_within(a: Column, b: Column, limit: int = THRESHOLD) -> Column:
    """True if at most ``limit`` edits turn ``a`` into ``b``: bit-parallel columns of a band of ``2 * limit + 1`` rows.

    Bit ``k`` of a word stands for the row ``i - limit + k`` of column ``i``. The score follows the band's lowest
    diagonal and then the last row. Both strings need more than ``limit`` characters.
    """
    width = 2 * limit + 1
    full = F.lit((1 << width) - 1).cast("bigint")
    one = F.lit(1).cast("bigint")

    def run(pair: Column) -> Column:
        p, t = pair["p"], pair["t"]  # p is not shorter than t
        turn = F.size(p) - limit

        def step(acc: Column, i: Column) -> Column:
            hit = F.lit(0).cast("bigint")
            for k in range(width):
                same = F.coalesce(F.get(p, i - limit + k) == F.get(t, i), F.lit(False)) & (i - limit + k >= 0)
                hit = hit.bitwiseOR(F.when(same, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))

            def columns(x: Column) -> Column:
                d0 = ((x.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"])).bitwiseOR(x).bitwiseOR(acc["vn"]).bitwiseAND(full)

                def deltas(d: Column) -> Column:
                    hp = acc["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(acc["vp"])).bitwiseAND(full))
                    hn = d.bitwiseAND(acc["vp"])
                    down = F.shiftright(d, 1)
                    bit = F.call_function("shiftleft", one, F.greatest(F.lit(width - 2) - (i - turn), F.lit(0)))
                    late = i >= turn
                    gone = late & (F.lit(width - 2) - (i - turn) < 0)
                    score = (
                        acc["score"]
                        + F.when(~late & (d.bitwiseAND(F.lit(1 << (width - 1)).cast("bigint")) == 0), 1).otherwise(0)
                        + F.when(late & ~gone & (hp.bitwiseAND(bit) != 0), 1).otherwise(0)
                        - F.when(late & ~gone & (hn.bitwiseAND(bit) != 0), 1).otherwise(0)
                    )
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        score.alias("score"),
                    )

                return _let(d0, deltas)

            return _let(hit, columns)

        start = F.struct(
            F.lit(((1 << (limit + 1)) - 1) << limit).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(limit).alias("score")
        )
        score = F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, lambda acc: acc["score"])
        return F.when(F.size(p) - F.size(t) > limit, F.lit(False)).otherwise(score <= limit)

    def letters(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))

    longer = F.length(a) >= F.length(b)
    pair = F.struct(F.when(longer, letters(a)).otherwise(letters(b)).alias("p"), F.when(longer, letters(b)).otherwise(letters(a)).alias("t"))
    return _let(pair, run)


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row per line that is not blank: the document's key, the line number, the trimmed line and its hash."""
    ta, tb = _two(F.col(text))
    cut = docs.select(F.col(doc_id).alias("_d"), ta.alias("_ta"), tb.alias("_tb"), F.posexplode(F.split(text, "\n", -1)).alias("_ln", "_raw"))
    cut = cut.select("_d", "_ta", "_tb", "_ln", F.btrim("_raw", F.lit(SPACE_CHARS)).alias("_line")).where("_line <> ''")
    a, b = _two(F.col("_line"))
    return cut.withColumn("_a", a).withColumn("_b", b)


def _keys(line: Column) -> Column:
    """Index and probe keys of a line: structs of ``role`` (0: index, 1: probe for a line one shorter), ``half`` and ``key``."""
    n = F.length(line)

    def key(role: int, half: int) -> Column:
        size = n - role
        cut = F.floor(size / 2).cast("int")
        part = F.substring(line, F.lit(1), cut) if half == 0 else F.substring(line, cut + 1 + role, size - cut)
        return F.struct(F.lit(role).alias("role"), F.lit(half).alias("half"), F.xxhash64(size, F.lit(half), part).alias("key"))

    return F.array(*[key(r, h) for r in (0, 1) for h in (0, 1)])


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (``role``) of buckets that hold an index row and another row, with the bucket's size ``_n``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("role").alias("_r")).where("_n > 1 AND _r = 0").drop("_r")
    return rows.join(broadcast_checked(materialize(sizes, "line-buckets")), keys)


def _pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """Different lines of small buckets, earlier first; two probe rows never meet."""
    x = members.where(F.col("_n") <= BUCKET).select(*keys, F.col("role").alias("r1"), F.col("first").alias("f1"), F.struct("_a", "_b").alias("h1"))
    y = x.select(*keys, F.col("r1").alias("r2"), F.col("f1").alias("f2"), F.col("h1").alias("h2"))
    return x.join(y, keys).where("f1 < f2 AND (r1 = 0 OR r2 = 0)").select("h1", "h2").distinct()


def _near(lines: DataFrame, first: DataFrame) -> DataFrame:
    """Hashes of the lines that have an earlier line within one edit."""
    keyed = first.where(F.size("keys") > 0).select("_a", "_b", "first", F.inline("keys"))
    members = materialize(_shared(keyed, ["half", "key"]), "line-members")
    small = materialize(_pairs(members, ["half", "key"]), "line-pairs")
    large = members.where(F.col("_n") > BUCKET)

    wanted = small.select("h1.*").union(small.select("h2.*")).union(large.select("_a", "_b")).toDF("_a", "_b").distinct()
    wanted = materialize(wanted, "line-wanted")
    texts = lines.select("_a", "_b", "_line").join(broadcast_checked(wanted), ["_a", "_b"])
    texts = materialize(texts.dropDuplicates(["_a", "_b"]), "line-texts")

    # large buckets: the rest of the line in blocks of the shorter line's grid
    size = F.length("_line") - F.col("role")
    cut = F.floor(size / 2).cast("int")
    rest = F.when(F.col("half") == 0, F.substring("_line", cut + 1, F.length("_line"))).otherwise(F.substring("_line", F.lit(1), cut + F.col("role")))
    base = F.when(F.col("half") == 0, size - cut).otherwise(cut)
    step = F.ceil(F.col("_base") / F.lit(float(BLOCKS))).cast("int")
    blocks = (
        large.drop("_n").join(texts, ["_a", "_b"]).select("half", "key", "role", "_a", "_b", "first", rest.alias("_rest"), base.alias("_base"))
        .withColumn("_step", step)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_base") / F.col("_step")).cast("int") - 1)))
        .withColumn("_from", F.col("block") * F.col("_step"))
        .withColumn("_till", F.least(F.col("_from") + F.col("_step"), F.col("_base")) + F.col("role"))
        .select(
            "half", "key", "role", "_a", "_b", "first", "block",
            F.xxhash64(F.substring("_rest", F.lit(1), F.col("_from")), F.substring("_rest", F.col("_till") + 1, F.length("_rest"))).alias("around"),
            F.substring("_rest", F.col("_from") + 1, F.col("_till") - F.col("_from")).alias("_part"),
        )
    )
    keys = ["half", "key", "block", "around"]
    blocked = materialize(_shared(blocks, keys), "line-blocks")
    pairs = small.union(_pairs(blocked, keys)).distinct()

    # blocks that many lines fill: what is left after one deletion
    full = blocked.where(F.col("_n") > BUCKET)
    places = F.sequence(F.lit(1), F.length("_part"))
    without = F.transform(
        places,
        lambda i: F.struct(
            F.when(F.col("role") == 0, i).otherwise(0).alias("at"),
            F.concat(F.substring("_part", F.lit(1), i - 1), F.substring("_part", i + 1, F.length("_part"))).alias("left"),
        ),
    )
    itself = F.array(F.struct(F.lit(0).alias("at"), F.col("_part").alias("left")))
    spread = full.select(*keys, "role", "_a", "_b", "first", F.inline(F.when(F.col("role") == 0, F.concat(without, itself)).otherwise(without)))
    meet = [*keys, "at", "left"]
    # at > 0: index rows that differ in this one character; at = 0: one index row, the probe rows have one character more
    spread = spread.withColumn("side", F.when(F.col("at") > 0, 0).otherwise(F.col("role")))
    earliest = spread.groupBy(*meet, "side").agg(F.min("first").alias("_min"))
    other = earliest.withColumn("side", F.when(F.col("at") > 0, 0).otherwise(1 - F.col("side")))
    one_off = spread.join(materialize(other, "line-earliest"), [*meet, "side"]).where("_min < first").select("_a", "_b").distinct()

    left, right = (
        texts.select(F.struct("_a", "_b").alias(h), F.col("_line").alias(t)) for h, t in (("h1", "l1"), ("h2", "l2"))
    )
    verified = pairs.join(left, "h1").join(right, "h2").where(edit_distance_within(F.col("l1"), F.col("l2")))
    return verified.select("h2.*").toDF("_a", "_b").union(one_off).distinct()


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (``_d, _ta, _tb``) the numbers of the lines that go, as ``_gone``."""
    lines = _lines(docs, text, doc_id)
    keys = F.when(F.length("_line") >= MIN_CHARS, _keys(F.col("_line"))).otherwise(F.array().cast("array<struct<role:int,half:int,key:bigint>>"))
    first = materialize(
        lines.withColumn("_keys", keys)
        .groupBy("_a", "_b")
        .agg(F.min(F.struct("_d", "_ta", "_tb", "_ln")).alias("first"), F.count(F.lit(1)).alias("_count"), F.first("_keys").alias("keys")),
        "line-first",
    )
    near = materialize(_near(lines, first), "line-near").withColumn("_near", F.lit(True))
    table = first.select("_a", "_b", "first", "_count").join(broadcast_checked(near), ["_a", "_b"], "left").where("_count > 1 OR _near")
    table = materialize(table.select("_a", "_b", "first", F.coalesce("_near", F.lit(False)).alias("_near")), "line-table")
    seen = lines.select("_d", "_ta", "_tb", "_ln", "_a", "_b").join(broadcast_checked(table), ["_a", "_b"])
    gone = seen.where(F.col("_near") | (F.struct("_d", "_ta", "_tb", "_ln") > F.col("first")))
    return gone.groupBy("_d", "_ta", "_tb").agg(F.collect_set("_ln").alias("_gone"))


def clean_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``: the row as a struct with its text cleaned, ``n_lines`` with content before, and ``n_removed`` of them."""
    gone = removed_lines(docs, doc_id, text)
    ta, tb = _two(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_d"), ta.alias("_ta"), tb.alias("_tb"))
    lists = gone.select(F.col("_d").alias("_d2"), F.col("_ta").alias("_ta2"), F.col("_tb").alias("_tb2"), "_gone")
    same = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_ta") == F.col("_ta2")) & (F.col("_tb") == F.col("_tb2"))
    joined = rows.join(lists, same, "left")
    whole = F.col("_row").getField(text)
    kept = _let(
        F.split(whole, "\n", -1),
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"
        ),
    )
    clean = F.when(F.col("_gone").isNull(), whole).otherwise(kept)
    n = F.size(F.filter(F.split(F.coalesce(whole, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    return joined.select(
        F.struct(*[(clean if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns]).alias("row"),
        n.cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the column ``text`` cleaned."""
    return clean_rows(docs, doc_id, text).select("row.*")


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """Per document the lines with content, how many of them go, and the length and digest of what stays."""
    return clean_rows(docs.select("doc_id", "text")).select(
        "row.doc_id",
        "n_lines",
        "n_removed",
        F.length("row.text").cast("bigint").alias("n_chars_kept"),
        F.sha2("row.text", 256).alias("kept_sha256"),
    )
