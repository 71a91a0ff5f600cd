"""Grouping of spelling variants by permuterm rotations.

A word is marked with a terminator and rotated. Rotated so that one of its letters comes last, ``xcy`` is ``y$x`` + ``c``: all words
that differ from it in that letter only have rotations in the range of the prefix ``y$x``, and the word without the letter, ``xy``,
has that prefix as a whole rotation. So every word gives its rotations without the last letter (the edited one skipped) and its whole
rotations; sorted, the rows of a prefix range are neighbours, and one scan of the range gives each member its number of neighbours
and the best of them. A range holds at most one word per letter of the alphabet and the word without the letter, so it is small
whatever the corpus is, and no pairs are laid out. A replacement pair meets in one range. An insertion pair meets once per equal letter
in a row (``aab`` and ``ab``) and counts only at the first of these.

Prefixes of more than ``WRITTEN`` code points are not written out but named by 128 bits of rolling hashes of ``y`` and ``x`` and by their
lengths, so that a very long word costs time and space in proportion to its length. The choice hangs on the prefix alone, so both
sides of a pair make the same one.

Words are counted over all texts with partial sums first, so a frequent word is no burden. A form has ten times the count of its
word, so chains of forms are short: their length is bounded by the logarithm of the largest count, and they are followed by doubling.

Defined cases: a null or empty text has no words; a row without an id has nothing deleted; repeated rows count each; of equally frequent
neighbours the smallest in code-point order is the form; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import broadcast_checked, materialize
from quire.llm.words import mixed
from quire.session import ship_by_value

#: Fixed values of the query: letters, the share of runs that lose a letter, and the least length and count of a word.
LETTERS = r"A-Za-z\x{C0}-\x{FF}"
DROPPED = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
END = "$"
WRITTEN = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALTS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``doc, word`` per maximal run of letters with ``least`` code points or more, A to Z lower-cased."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least},}}+)"), F.lit(1))
    low = F.translate("_run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(doc_id).alias("doc"), F.explode(found).alias("_run")).select("doc", low.alias("word"))


def misspelt(rows: DataFrame, dropped: int = DROPPED) -> DataFrame:
    """``word`` with one letter deleted where ``dropped`` divides the checksum of id and word."""
    sum_ = F.crc32(F.concat(F.col("doc").cast("string"), F.lit(":"), F.col("word")))
    at = (F.col("_h") % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.select("word", sum_.alias("_h")).select(F.when(F.col("_h") % dropped == 0, less).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words with enough code points and occurrences."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _skipping(word: Column, length: Column) -> Column:
    """The prefix per letter that a rotation ends with, and if the letter before it is another one."""

    def one(i: Column) -> Column:
        first = (i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1)))
        return F.struct(F.concat(F.substring(word, i + 1, length), F.lit(END), F.substring(word, F.lit(1), i - 1)).alias("key"), F.lit(True).alias("skip"), first.alias("first"))

    return F.transform(F.sequence(F.lit(1), length), one)


def _whole(word: Column, length: Column) -> Column:
    def one(i: Column) -> Column:
        return F.struct(F.concat(F.substring(word, i, length), F.lit(END), F.substring(word, F.lit(1), i - 1)).alias("key"), F.lit(False).alias("skip"), F.lit(False).alias("first"))

    return F.transform(F.sequence(F.lit(1), length + 1), one)


def long_prefixes(word: str, skip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Names (two numbers each) of a word's prefixes, and if the skipped letter differs from the one before it."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    i = np.arange(n if skip else n + 1)
    y = i + 1 if skip else i
    names = []
    for salt in _SALTS:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(points * _BASE ^ salt) * up[:n], out=sums[1:])
        left, right = sums[i], (sums[n] - sums[y]) * down[y]
        names.append(mixed(left ^ mixed(right ^ mixed(i.astype(np.uint64) ^ mixed((n - y).astype(np.uint64) ^ salt)))))
    first = np.concatenate([[True], points[1:] != points[:-1]]) if skip else np.zeros(n + 1, bool)
    return np.stack(names, 1), first


def _named(words: DataFrame, skip: bool) -> DataFrame:
    """Rows of the prefixes that are too long to be written out."""
    for module in (__name__, "quire.llm.words"):
        ship_by_value(module)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, first = long_prefixes(word, skip)
                for a in range(0, len(names), 4096):
                    keys = [f"#{x:016x}{y:016x}" for x, y in names[a : a + 4096].tolist()]
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([word] * m), pa.array([n] * m, pa.int64()), pa.array(keys), pa.array([skip] * m), pa.array(first[a : a + m])],
                        names=["word", "n", "key", "skip", "first"],
                    )

    return words.mapInArrow(run, "word string, n bigint, key string, skip boolean, first boolean")


def rotations(words: DataFrame, written: int = WRITTEN) -> DataFrame:
    """``word, n, key, skip, first``: a row per prefix range that a word of ``word, n`` lies in."""
    length = F.length("word")

    def rows(part: DataFrame, keys) -> DataFrame:
        return part.select("word", "n", F.explode(keys(F.col("word"), F.length("word"))).alias("_r")).select("word", "n", "_r.*")

    out = rows(words.where(length <= written), _skipping).union(rows(words.where(length < written), _whole))
    if words.where(length >= written).isEmpty():
        return out
    return out.union(_named(words.where(length > written), True)).union(_named(words.where(length >= written), False))


def scan(rotated: DataFrame) -> DataFrame:
    """``word, n_near, best`` by one scan of the sorted prefix ranges; ``best`` is (minus the count, word) of the best neighbour."""
    span = Window.partitionBy("key")
    order = span.orderBy(F.col("skip").desc(), F.col("n").desc(), "word")
    me = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    seen = rotated.withColumn("_size", F.count(F.lit(1)).over(span)).where("_size > 1")
    seen = seen.withColumns(
        {
            "_place": F.row_number().over(order),
            "_top": F.first(me).over(order),
            "_next": F.lead(F.when(F.col("skip"), me)).over(order),
            "_peers": F.count(F.when(F.col("skip"), 1)).over(span),
            "_firsts": F.count(F.when(F.col("first"), 1)).over(span),
            "_short": F.min(F.when(~F.col("skip"), me)).over(span),
            "_longer": F.min(F.when(F.col("first"), me)).over(span),
        }
    )
    peer = F.when(F.col("_place") == 1, F.col("_next")).otherwise(F.col("_top"))
    shorter = F.when(F.col("first"), F.col("_short"))
    near = F.when(F.col("skip"), F.col("_peers") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("_firsts"))
    best = F.when(F.col("skip"), F.least(peer, shorter)).otherwise(F.col("_longer"))
    return seen.select("word", near.alias("_near"), best.alias("_best")).where("_near > 0").groupBy("word").agg(F.sum("_near").alias("n_near"), F.min("_best").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` for rows ``word, form`` whose chains have at most ``steps`` links."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        now = materialize(now, "spelling-roots")
        far = broadcast_checked(now.select(F.col("word").alias("root"), F.col("root").alias("_far")))
        now = now.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"))
    return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a written vocabulary ``word, n``."""
    near = scan(rotations(words))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("_f"))
    known = materialize(known.select("word", "n", "n_near", F.col("_f.w").alias("form"), (-F.col("_f.m")).alias("form_n")), "spelling-forms")
    most = words.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(most[0] / most[1], ratio)) + 1 if most[0] else 0
    linked = materialize(roots(known.where("form IS NOT NULL"), steps), "spelling-linked")
    return known.join(broadcast_checked(linked), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(docs: DataFrame) -> DataFrame:
    """Variants among the words of all texts, some runs of which have lost a letter."""
    return variants(materialize(vocabulary(misspelt(runs(docs))), "spelling-words"))


_BITS = "flatten(list_transform(flatten(list_transform(string_split(doc_id || ':' || word, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)), lambda x: [x & 1, (x >> 1) & 1, (x >> 2) & 1, (x >> 3) & 1, (x >> 4) & 1, (x >> 5) & 1, (x >> 6) & 1, (x >> 7) & 1]))"
ORACLE = rf"""WITH RECURSIVE t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents),
 c AS (SELECT doc_id, word, count(*) AS k FROM t GROUP BY ALL),
 h AS (SELECT word, k, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}::BIGINT[]), lambda s, b: xor(s >> 1, CASE WHEN xor(s & 1, b) = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) AS h FROM c),
 m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, k FROM h),
 v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
 s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
 d AS (SELECT DISTINCT s.word AS a, v.word AS b FROM s JOIN v ON v.word = s.less),
 p AS (SELECT a.word, b.word AS near FROM s a JOIN s b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION ALL SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
 g AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY v.n DESC, near) AS best, max(v.n) AS most FROM p JOIN v ON v.word = p.near GROUP BY p.word),
 f AS MATERIALIZED (SELECT v.word, CASE WHEN most >= 10 * v.n THEN best END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN g USING (word)),
 r AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS open FROM f UNION ALL SELECT r.word, f.form, true FROM r JOIN f ON f.word = r.root WHERE r.open AND f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT r.word, arg_max(r.root, w.n) AS root FROM r JOIN v w ON w.word = r.root GROUP BY r.word) z ON z.word = f.word"""
