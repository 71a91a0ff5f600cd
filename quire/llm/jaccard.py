"""Exact Jaccard self-join of word shingle sets by partition and pigeonhole.

A set of size n and a similar one differ in at most ``budget`` elements. For each band of sizes the universe of shingles is
cut by hash into more segments than any budget of the band; similar sets then hold equal segments. Of its segments a
set indexes only the ``budget + 1`` cheapest, by content: largest first (a large segment is rarely shared by chance), then by
key. Among the equal segments the cheapest one is passed over by neither side, so it is always met. Sets whose budget
is one use the whole set and its one-deletion neighbourhood instead.

Buckets with two different sets go on: first each member is compared with the bucket's pivot, the member that shares most
with others, and what is linked is merged into components. Only buckets that still hold different components are looked at
again. Those of more than ``BUCKET`` sets, as frequent passages make them, are refined: their members meet again only if
they agree, up to one deletion, in a segment twice as large of a second, independent partition. What still meets is
compared in blocks of sets around the same pivot; a block's comparisons return links only. Every comparison is exact on
64-bit shingle hashes (two different shingles are taken for one with a chance of about 2 ** -64).

Copies (equal sets) are one node throughout. Tasks work on slices of Arrow batches; nothing else is gathered.

Defined cases: a null, empty or blank text has an empty set, is linked with nothing and is its own component; a text with
fewer words than a shingle has its whole word sequence as one shingle; repeated rows are copies; a null id never names a
component that has another id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_checked, materialize
from quire.llm.components import components
from quire.llm.words import NOT_SPACE, cut_words, mixed, shards
from quire.session import ship_by_value

SIZE = 4
PERCENT = 85
BUCKET = 64
#: Elements of all sets of a block.
BLOCK = 40_000
#: Ratio of the first sizes of neighbouring bands, and segments per element of the budget.
GROWTH = 1.5
SLACK = 1.3
#: Keys of shared buckets that may be broadcast (two longs each); beyond that the join is shuffled.
KEY_ROWS = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def budget(total: int, percent: int) -> int:
    """Largest symmetric difference of two similar sets whose sizes add up to ``total``."""
    return total + 2 * (-percent * total // (100 + percent))  # minus twice the smallest allowed intersection


class Schemes:
    """Sizes of bands and what a set of a given size indexes in each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.whole = 1  # the first band ends where a set may differ in two elements
        while max(budget(self.whole + b, percent) for b in range(self.whole, self.whole * 100 // percent + 1)) < 2:
            self.whole += 1
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def start(self, band: int) -> int:
        return 1 if band == 0 else int(self.whole * GROWTH ** (band - 1))

    def segments(self, band: int) -> int:
        last = self.start(band + 1) - 1
        return int(SLACK * (max(budget(last + b, self.percent) for b in range(last, last * 100 // self.percent + 1)) + 1)) + 1

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, budget) of the schemes in which a set of ``n`` elements takes part. Band 0 has one segment."""
        if n not in self.known:
            band = 0
            while self.start(band + 1) <= n:
                band += 1
            out = []
            for k in (band, band - 1):
                low, high = self.start(k) if k >= 0 else 1, n * 100 // self.percent if k == band else self.start(band) - 1
                low = max(low, -(-n * self.percent // 100))
                if k >= 0 and low <= high:
                    most = max(budget(n + p, self.percent) for p in range(low, high + 1))
                    out.append((k, 1 if k == 0 else self.segments(k), most))
            self.known[n] = out
        return self.known[n]


def _salt(*numbers: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(numbers).encode(), digest_size=8).digest(), "little"))


def _segments(s: np.ndarray, m: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements' order by segment, and number, start and size of the segments that are not empty."""
    where = (mixed(s ^ salt) >> np.uint64(11)) % np.uint64(m)
    order = np.argsort(where, kind="stable")
    segment, start, size = np.unique(where[order], return_index=True, return_counts=True)
    return order, segment, start, size


def set_keys(s: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds (0: content, 1: one element deleted) of a sorted set."""
    keys, kinds = [], []
    value = mixed(s * _ODD)
    for band, m, most in plan:
        if band == 0:
            total = value.sum(dtype=np.uint64)
            keys.append(mixed(np.concatenate([[total], total - value]) ^ _salt(0)))
            kinds.append(np.concatenate([[0], np.ones(len(s), np.int8)]).astype(np.int8))
            continue
        order, segment, start, size = _segments(s, m, _salt(band))
        sums, sizes = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        sums[segment], sizes[segment] = np.add.reduceat(value[order], start), size
        key = mixed(sums + mixed(np.arange(m, dtype=np.uint64) ^ _salt(1, band)))
        best = np.lexsort((key, -sizes))[: most + 1]
        keys.append(key[best])
        kinds.append(np.zeros(len(best), np.int8))
    return np.concatenate(keys), np.concatenate(kinds)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, powers: dict, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a shard."""
    hashes, _, _, counts = cut_words(data, offsets, powers, NOT_SPACE)
    first = np.cumsum(counts) - counts
    n = len(hashes)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        whole = mixed(whole * _ODD + hashes[j : n - size + 1 + j] + np.uint64(size)) if n >= size else whole
    out = []
    for a, k in zip(first.tolist(), counts.tolist(), strict=True):
        if k >= size:
            s = np.sort(whole[a : a + k - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif k:
            short = np.zeros(1, np.uint64)
            for j in range(k):
                short = mixed(short * _ODD + hashes[a + j] + np.uint64(k))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set as two longs."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))


def _ship() -> None:
    for module in (__name__, "quire.llm.words"):
        ship_by_value(module)


def _sets(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, sid, tag`` for every row: the set's size and its 128-bit name."""
    _ship()
    narrow = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            for a, b, data, offsets in shards(batch.column(1)):
                sets = shingle_sets(data, offsets, powers, size)
                names = np.array([_name(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1])],
                    names=["doc_id", "n", "sid", "tag"],
                )

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['_doc'].dataType.simpleString()}, n bigint, sid bigint, tag bigint")


def _index(docs: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """Index rows ``key, sid, kind`` of all texts with words."""
    _ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        plans = Schemes(percent)
        for batch in batches:
            for _, _, data, offsets in shards(batch.column(0), 1_000_000):
                keys, kinds, sids, many = [], [], [], []
                for s in shingle_sets(data, offsets, powers, size):
                    if len(s):
                        k, kind = set_keys(s, plans.of(len(s)))
                        keys.append(k)
                        kinds.append(kind)
                        sids.append(_name(s)[0])
                        many.append(len(k))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [_long(np.concatenate(keys)), pa.array(np.repeat(np.array(sids, np.int64), many)), pa.array(np.concatenate(kinds), pa.int8())],
                        names=["key", "sid", "kind"],
                    )

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "key bigint, sid bigint, kind tinyint")


def _contents(docs: DataFrame, wanted: DataFrame, members: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """``sid, tag, n, data`` (hashes) of the wanted sets, read again from one text each."""
    _ship()
    named = members.join(broadcast_checked(wanted), "sid")
    chosen = named.groupBy("sid", "tag").agg(F.min("doc_id").alias("_d"))
    ids = broadcast_checked(materialize(chosen.select("_d").distinct(), "set-texts"))
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(ids, F.col("_doc").eqNullSafe(F.col("_d")), "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            for _, _, data, offsets in shards(batch.column(0), 1_000_000):
                sets = [s for s in shingle_sets(data, offsets, powers, size) if len(s)]
                names = np.array([_name(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)],
                    names=["sid", "tag", "n", "data"],
                )

    rows = texts.mapInArrow(run, "sid bigint, tag bigint, n bigint, data array<bigint>").join(broadcast_checked(wanted), "sid")
    return materialize(rows.dropDuplicates(["sid", "tag"]), "set-contents")


def _verify(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` (of sids) whose sets are similar."""
    a = contents.select(F.col("sid").alias("u"), F.col("data").alias("d1"))
    b = contents.select(F.col("sid").alias("v"), F.col("data").alias("d2"))
    sizes = contents.select("sid", "n")
    fitting = (  # sizes alone settle many pairs; they are narrow, the contents are not
        pairs.join(sizes.select(F.col("sid").alias("u"), F.col("n").alias("m1")), "u")
        .join(sizes.select(F.col("sid").alias("v"), F.col("n").alias("m2")), "v")
        .where(100 * F.least("m1", "m2") >= percent * F.greatest("m1", "m2"))
        .select("u", "v")
        .distinct()
    )
    common = F.size(F.array_intersect("d1", "d2"))
    similar = 100 * common >= percent * (F.size("d1") + F.size("d2") - common)
    return materialize(fitting, "set-pairs").join(a, "u").join(b, "v").where(similar).select("u", "v")


def _refined(sids: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Second keys ``key, sid, kind, comp`` of the sets ``sid, comp`` in large buckets.

    Similar sets share a second key whatever their first bucket was, so each set is cut once. A set brings its component along,
    so its many keys need no join.
    """
    _ship()
    sets = contents.join(broadcast_checked(sids), "sid").select("sid", "data", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = Schemes(percent)
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.sort(batch.column(1)[i].values.to_numpy().view(np.uint64))
                key, kind = second_set_keys(s, plans)
                sid, comp = (pa.array(np.full(len(key), batch.column(j)[i].as_py(), np.int64)) for j in (0, 2))
                yield pa.RecordBatch.from_arrays([_long(key), sid, pa.array(kind, pa.int8()), comp], names=["key", "sid", "kind", "comp"])

    return sets.mapInArrow(run, "key bigint, sid bigint, kind tinyint, comp bigint")


def second_set_keys(s: np.ndarray, plans: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds of the refinement: half as many segments as the budget asks for, each with one deletion allowed."""
    keys, kinds = [], []
    value = mixed(s * _ODD)
    for band, _, _ in plans.of(len(s)):
        last = plans.start(band + 1) - 1
        most = max(budget(last + b, plans.percent) for b in range(last, last * 100 // plans.percent + 1))
        m = max(1, -(-(most + 1) // 2))
        order, segment, start, size = _segments(s, m, _salt(2, band))
        sums = np.zeros(m, np.uint64)
        sums[segment] = np.add.reduceat(value[order], start)
        at = np.repeat(segment, size).astype(np.int64)
        content = np.concatenate([sums, sums[at] - value[order]])
        number = np.concatenate([np.arange(m), at]).astype(np.uint64)
        keys.append(mixed(content + mixed(number ^ _salt(3, band))))
        kinds.append(np.concatenate([np.zeros(m, np.int8), np.ones(len(s), np.int8)]))
    return np.concatenate(keys), np.concatenate(kinds)


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    roots = comps.select(F.col("node").alias("sid"), F.col("root"))
    return rows.join(broadcast_checked(roots), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets that still hold different components and a content key, with the bucket's size ``_n``."""
    sizes = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("kind").alias("_k")
    ).where("_lo < _hi AND _k = 0").select("key", "_n")
    return rows.join(broadcast_checked(materialize(sizes, "set-sizes")), "key")


def _pivots(rows: DataFrame) -> DataFrame:
    """``key, u``: the member of a bucket that shares most with others, by the sizes of all its buckets."""
    weight = rows.groupBy("sid").agg(F.sum("_n").alias("_w"))
    return rows.join(weight, "sid").groupBy("key").agg(F.max(F.struct("_w", "sid"))["sid"].alias("u"))


def _stars(rows: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivot."""
    pivots = materialize(_pivots(rows), "set-pivots")
    return rows.join(pivots, "key").where("u <> sid").select(F.least("u", "sid").alias("u"), F.greatest("u", "sid").alias("v")).distinct()


def _blocks(rows: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between different components of the same pivot's buckets, compared block by block.

    The members of all buckets with one pivot are one cluster. It is cut into blocks of about ``BLOCK`` elements, and a row
    holds two blocks, so neither pairs nor a whole cluster are ever laid out; only links come back.
    """
    _ship()
    pivots = materialize(_pivots(rows), "set-pivots")
    members = materialize(rows.join(pivots, "key").select("u", "sid", "comp").distinct(), "set-clusters")
    weighed = members.join(contents.select("sid", "n"), "sid")
    sizes = weighed.groupBy("u").agg(F.sum("n").alias("_c"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    count = F.ceil(F.col("_c") / F.lit(float(BLOCK))).cast("bigint")
    placed = members.join(broadcast_checked(materialize(sizes.select("u", count.alias("_b")), "set-cluster-sizes")), "u")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("sid", "u"), F.col("_b")))
    filled = placed.join(contents.select("sid", "data"), "sid")
    blocks = materialize(filled.groupBy("u", "_b", "block").agg(F.collect_list(F.struct("sid", "comp", "data")).alias("sets")), "set-blocks")
    left = blocks.select("u", F.explode(F.sequence(F.col("block"), F.col("_b") - 1)).alias("block"), F.col("sets").alias("one"))
    both = left.join(blocks.select("u", "block", F.col("sets").alias("two")), ["u", "block"]).select("one", "two")

    def unpack(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        row = column[i].values
        data = row.field("data")
        return row.field("sid").to_numpy(), row.field("comp").to_numpy(), [data[k].values.to_numpy().view(np.uint64) for k in range(len(data))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sid1, comp1, sets1 = unpack(batch.column(0), i)
                sid2, comp2, sets2 = unpack(batch.column(1), i)
                many = np.array([len(s) for s in sets2])
                owner, flat = np.repeat(np.arange(len(sets2)), many), np.concatenate(sets2)
                u, v = [], []
                for a, c, s in zip(sid1, comp1, sets1, strict=True):
                    s = np.sort(s)
                    found = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
                    common = np.bincount(owner[found], minlength=len(sets2))
                    near = np.flatnonzero((100 * common >= percent * (len(s) + many - common)) & (comp2 != c))
                    u += [int(a)] * len(near)
                    v += sid2[near].tolist()
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.mapInArrow(run, "u bigint, v bigint")


def linked_sets(docs: DataFrame, members: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``node`` and ``root`` of the sets that are linked with another set."""
    index = _index(docs, size, percent, text)
    keys = index.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.min("kind").alias("k")).where("lo < hi AND k = 0")
    keys = broadcast_checked(materialize(keys.select("key"), "set-keys"), KEY_ROWS)
    rows = materialize(_index(docs, size, percent, text).join(keys, "key").distinct(), "set-buckets")
    contents = _contents(docs, materialize(rows.select("sid").distinct(), "set-wanted"), members, size, doc_id, text)

    stars = _stars(materialize(_open(rows.withColumn("comp", F.col("sid"))), "set-open"))
    links = materialize(_verify(stars, contents, percent), "set-links")
    comps = components(links)
    still = materialize(_open(_with_comp(rows, comps)), "set-open")
    many = materialize(still.where(F.col("_n") > BUCKET).select("sid", "comp").distinct(), "set-many")
    second = materialize(_open(_refined(many, contents, percent)), "set-second")
    columns = ["key", "sid", "comp", "_n"]
    rest = still.where(F.col("_n") <= BUCKET).select(*columns).union(second.select(*columns))
    return components(materialize(links.union(_blocks(rest, contents, percent)), "set-links"))


def similar_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    members = materialize(_sets(docs, size, doc_id, text), "set-members")
    comps = linked_sets(docs, members.where("n > 0").select("doc_id", "sid", "tag"), size, percent, doc_id, text)
    comps = materialize(comps.distinct(), "set-components")
    # a group is named by a root, or by the set itself; texts without words stay alone
    grouped = members.where("n > 0").join(broadcast_checked(comps), F.col("sid") == F.col("node"), "left")
    grouped = grouped.select("doc_id", "n", F.coalesce("root", "sid").alias("_g"), F.when(F.col("root").isNull(), F.col("tag")).otherwise(0).alias("_t"))
    least = materialize(grouped.groupBy("_g", "_t").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_c")), "set-least")
    return (
        grouped.join(least, ["_g", "_t"])
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .union(members.where("n = 0").select("doc_id", "n", "doc_id"))
    )


def op6_jaccard(docs: DataFrame) -> DataFrame:
    """Set size and component per document: four words, 85 percent."""
    return similar_groups(docs)


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(ws, p, p + 3), ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.n + y.n - o)),
 e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
 r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
 c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""
