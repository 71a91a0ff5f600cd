"""Benchmark decontamination with suffix arrays over the training texts.

Texts are taken in shards of a few megabytes (a slice of an Arrow batch, never a whole partition). A shard's words are
numbered by the benchmark's vocabulary; other words and ends of documents are breaks that no match can cross. The
suffixes of what remains are sorted (packed words first, then rank doubling among ties), and every suffix of every
benchmark text is searched in that array, one word deeper per step with a binary search per step, for all suffixes at
once. The interval at depth ten gives all places of a window, the depth where it runs empty the longest verbatim match.
Documents with a window are marked or removed in the same pass: no shuffle, no pair list, and a lost executor repeats
only its own shards.

The benchmark is broadcast in blocks of about ``BLOCK_BYTES`` of text, each a further pass over the rows that remain. A pass
before the last is written, and its block dropped before the next is collected, so the driver and the executors hold one
block whatever the number of items. Words are compared by 64-bit hash and length.

Defined cases: words are maximal runs of ``[0-9a-z]`` and characters from U+0080 after lower-casing A to Z; a null or
empty text has none and is never contaminated; items without words are ignored, an item of fewer than ten words is one
window; items with the same id count once, a null id is counted under the empty name; repeated rows are marked
alike; an empty table or benchmark gives no rows or no hits. Column names of the documents do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize
from quire.llm.words import cut_words, shards
from quire.session import ship_by_value

WINDOW = 10
BLOCK_BYTES = 32_000_000


def index_items(items: list[tuple[str, str]]) -> dict:
    """Vocabulary, numbered words and windows of benchmark texts: what a task needs to search them."""
    rows = [t.encode("utf-8") for _, t in items]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    hashes, first_byte, stop, counts = cut_words(np.frombuffer(b"".join(rows), np.uint8), offsets, {})
    lengths = stop - first_byte
    vocabulary, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])[:-1].astype(np.int64)
    words = np.zeros(int((counts + 1).sum()), np.int64)
    words[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = numbers + 1
    place = np.flatnonzero(words)
    left = np.repeat(starts + counts, counts) - place  # words from here to the end of the item
    whole = np.repeat(counts, counts)
    window = np.where(left >= WINDOW, WINDOW, np.where((whole < WINDOW) & (left == whole), whole, 0))
    return {
        "vocabulary": vocabulary, "lengths": lengths[first], "words": words, "place": place, "window": window,
        "item": np.repeat(np.arange(len(counts)), counts), "names": [n for n, _ in items], "deepest": int(counts.max(initial=0)), "powers": {},
    }


def suffix_array(words: np.ndarray, deepest: int, largest: int) -> np.ndarray:
    """Places of all non-zero words, sorted by the words from there up to the next zero (``deepest`` words at most)."""
    n = len(words)
    zero = np.where(words == 0, np.arange(n), n)
    run = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(n)
    place = np.flatnonzero(words)
    if not len(place):
        return place
    bits = max(1, int(largest).bit_length())
    wide = max(1, 62 // bits)
    key = np.zeros(len(place), np.int64)
    for j in range(wide):
        here = np.where(run[place] > j, words[np.minimum(place + j, n - 1)], 0)
        key = (key << bits) | here
    order = np.argsort(key)
    place, key = place[order], key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[place] = head + 1
    depth = wide
    while depth < deepest:
        size = np.diff(np.append(np.flatnonzero(fresh), len(place)))
        tied = np.flatnonzero((np.repeat(size, size) > 1) & (run[place] >= depth))
        if not len(tied):
            break
        p = place[tied]
        group, nxt = rank[p], rank[p + depth]
        # a run that ends here goes on with rank 0 and so comes first; shorter runs differ from all others already
        order = np.lexsort((nxt, group))
        place[tied] = p = p[order]
        group, nxt = group[order], nxt[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        fresh[tied] = new
        rank[p] = tied[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))] + 1
        depth *= 2
    return place


def search(words: np.ndarray, places: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of every benchmark suffix, word by word.

    Returns low and high end of the interval at the depth of the suffix's window (equal ends: the window does not
    occur), and depth, low and high end of the longest match.
    """
    wanted, tests = index["words"], index["place"]
    n = len(tests)
    low, high = np.zeros(n, np.int64), np.full(n, len(places), np.int64)
    win_low, win_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth, at_low, at_high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n)
    j = 0
    while len(alive):
        value = wanted[tests[alive] + j]
        alive, value = alive[value > 0], value[value > 0]
        a = _bisect(words, places, low[alive], high[alive], value, j, False)
        b = _bisect(words, places, a, high[alive], value, j, True)
        keep = a < b
        alive, a, b = alive[keep], a[keep], b[keep]
        j += 1
        low[alive], high[alive] = a, b
        depth[alive], at_low[alive], at_high[alive] = j, a, b
        done = index["window"][alive] == j
        win_low[alive[done]], win_high[alive[done]] = a[done], b[done]
    return win_low, win_high, depth, at_low, at_high


def _bisect(words, places, low, high, value, j, above):
    low, high = low.copy(), high.copy()
    if not len(places):
        return low
    open_ = low < high
    while open_.any():
        mid = (low + high) >> 1
        seen = words[places[np.minimum(mid, len(places) - 1)] + j]
        right = open_ & ((seen <= value) if above else (seen < value))
        high = np.where(open_ & ~right, mid, high)
        low = np.where(right, mid + 1, low)
        open_ = low < high
    return low


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all intervals, and the interval each belongs to."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size), owner


def scan_shard(data: np.ndarray, offsets: np.ndarray, index: dict, longest: bool = False) -> dict:
    """Search one shard. Per text: number of words, merged hit intervals (in words), item numbers.

    With ``longest`` also the longest match of every benchmark suffix as (suffix, words, text, word) arrays.
    """
    hashes, first_byte, stop, counts = cut_words(data, offsets, index["powers"])
    lengths = stop - first_byte
    docs = len(counts)
    vocabulary = index["vocabulary"]
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    known = (vocabulary[at] == hashes) & (index["lengths"][at] == lengths) if len(vocabulary) else np.zeros(len(hashes), bool)
    # one empty place after each text, and enough at the end for the deepest look
    first = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    words = np.zeros(int(first[-1]) + index["deepest"] + 2, np.int64)
    words[np.arange(len(hashes)) + np.repeat(np.arange(docs), counts)] = np.where(known, at + 1, 0)
    places = suffix_array(words, index["deepest"], len(vocabulary))
    win_low, win_high, depth, low, _ = search(words, places, index)
    found = np.flatnonzero(win_high > win_low)
    out = {"n_words": counts, "spans": {}, "items": {}}
    if len(found):
        # equal windows share an interval: mark its places once, then name the items
        spot, back = np.unique(np.stack([win_low[found], win_high[found], index["window"][found]]), axis=1, return_inverse=True)
        slot, owner = _spread(spot[0], spot[1])
        place, size = places[slot], spot[2][owner]
        edge = np.bincount(place, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(place + size, minlength=len(words) + 1)[: len(words) + 1]
        inside = np.cumsum(edge) > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        for a, b in zip(turn[::2], turn[1::2], strict=True):
            d = int(np.searchsorted(first, a, "right")) - 1
            out["spans"].setdefault(d, []).append((int(a - first[d]), int(b - first[d])))
        doc = np.searchsorted(first, place, "right") - 1
        pairs = np.unique(np.stack([doc, owner]), axis=1)
        by_window: dict[int, set[int]] = {}
        for w, item in zip(back.ravel().tolist(), index["item"][found].tolist(), strict=True):
            by_window.setdefault(w, set()).add(item)
        for d, w in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
            out["items"].setdefault(d, set()).update(by_window[w])
    if longest:
        has = np.flatnonzero(depth)
        place = places[low[has]] if len(has) else has
        doc = np.searchsorted(first, place, "right") - 1
        out["longest"] = (has, depth[has], doc, place - first[doc])
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items as (id, text) in blocks of bounded size, each with whether it is the last; one is collected at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_i"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("b")).first()["b"]
    n = -(-int(total) // BLOCK_BYTES) if total else 0
    for k in range(n):
        yield [(r["_i"], r["_t"]) for r in rows.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(n)) == k).collect()], k == n - 1


def _ship() -> None:
    ship_by_value(__name__)
    ship_by_value("quire.llm.words")


def _broadcasts(docs: DataFrame, benchmark: DataFrame, empty: bool = False) -> Iterator[tuple[Broadcast, bool]]:
    """The index of each block and whether it is the last; others are destroyed on the next turn, so their pass must be
    written by then. With ``empty`` a benchmark without texts gives one empty index."""
    context = docs.sparkSession.sparkContext
    last = False
    for block, last in benchmark_blocks(benchmark):
        shared = context.broadcast(index_items(block))
        yield shared, last
        if not last:
            shared.destroy()
    if empty and not last:
        yield context.broadcast(index_items([])), True


def _merge(old: list[int], new: list[tuple[int, int]]) -> list[int]:
    spans = sorted([*zip(old[::2], old[1::2], strict=True), *new])
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def mark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``hits`` (starts and ends of hit words, flat) and ``items`` (names) for every row."""
    _ship()
    id_type = docs.schema[doc_id].dataType.simpleString()
    state = docs.select(
        F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    for shared, last in _broadcasts(docs, benchmark, empty=True):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                n_words, hits, items = [], [], []
                old_hits, old_items = batch.column(3), batch.column(4)
                for a, b, data, offsets in shards(batch.column(1)):
                    got = scan_shard(data, offsets, index)
                    n_words += got["n_words"].tolist()
                    for i in range(b - a):
                        was = old_hits[a + i].as_py()
                        hits.append(_merge(was, got["spans"][i]) if i in got["spans"] else was)
                        names = old_items[a + i].as_py()
                        items.append(sorted({*names, *(index["names"][k] for k in got["items"][i])}) if i in got["items"] else names)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    names=["_doc", "_text", "n_words", "hits", "items"],
                )

        state = state.mapInArrow(run, f"_doc {id_type}, _text string, n_words bigint, hits array<bigint>, items array<string>")
        if not last:
            state = materialize(state, "decontaminated")
    return state.select(F.col("_doc").alias("doc_id"), "n_words", "hits", "items")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark window, with all their columns."""
    _ship()
    inner = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    schema = inner.schema
    for shared, last in _broadcasts(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in shards(batch.column(0)):
                    for i in scan_shard(data, offsets, index)["spans"]:
                        keep[a + i] = False
                yield batch.filter(pa.array(keep))

        inner = inner.mapInArrow(run, schema)
        if not last:
            inner = materialize(inner, "decontaminated")
    return inner.select("_row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every benchmark suffix with any match its longest one over all shards and one place of it.

    Columns ``item_id`` (as text), ``offset`` (word of the item), ``n_words``, ``doc_id``, ``position`` (word of the
    document). Shards send one row per suffix, the best is taken after partial maxima; ties go to the smallest document.
    """
    _ship()
    id_type = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    parts = []
    for shared, last in _broadcasts(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            head = np.flatnonzero(np.diff(index["item"], prepend=-1))
            start = index["place"][head] if len(head) else head
            item_at = np.searchsorted(index["item"][head], index["item"]) if len(head) else head
            for batch in batches:
                for a, _, data, offsets in shards(batch.column(1)):
                    suffix, size, doc, position = scan_shard(data, offsets, index, longest=True)["longest"]
                    names = [index["names"][k] for k in index["item"][suffix].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.string()), pa.array(index["place"][suffix] - start[item_at[suffix]], pa.int64()),
                            pa.array(size, pa.int64()), batch.column(0).take(pa.array(doc + a)), pa.array(position, pa.int64()),
                        ],
                        names=["item_id", "offset", "n_words", "doc_id", "position"],
                    )

        part = narrow.mapInArrow(run, f"item_id string, offset bigint, n_words bigint, doc_id {id_type}, position bigint")
        parts.append(part if last else materialize(part, "longest-matches"))
    if not parts:
        return narrow.where("false").selectExpr("'' AS item_id", "0L AS offset", "0L AS n_words", "_doc AS doc_id", "0L AS position")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    best = rows.groupBy("item_id", "offset").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "position")).alias("b"))
    return best.select("item_id", "offset", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.position")


def op2_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items per document."""
    hits = F.aggregate(
        F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), F.lit(0).cast("bigint"), lambda a, i: a + F.get("hits", i + 1) - F.get("hits", i)
    )
    n_hit = F.when(F.size("hits") > 0, hits).otherwise(F.lit(0).cast("bigint"))
    return mark(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = rf"regexp_extract_all({_LOW.format('coalesce(text, chr(10))')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CUT} AS ws FROM documents),
 i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_CUT} AS ws FROM benchmark),
 iw AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(list_slice(ws, p, p + 9), ' ') AS win
   FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
 ks AS (SELECT DISTINCT k FROM iw),
 dw AS (SELECT rid, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS win FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
 h AS (SELECT rid, p, dw.k AS k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
 hw AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS w FROM h) GROUP BY rid),
 hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""
