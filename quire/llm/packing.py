"""Best-two-fit packing of tokenized documents into sequences of one capacity.

A sequence is filled greedily, the longest piece that still fits first. Where a gap stays, the smallest piece of the sequence is
taken out again if two unpacked pieces fit the widened gap more tightly, and this is repeated while it helps. The plan of the greedy
filling alone is made as well (both are small) and taken only if it needs fewer sequences.

Only lengths decide, and there are no more of them than the capacity. So the tasks count pieces per length, the driver packs
these counts (a pattern of lengths is used as often as the counts allow, since nothing that changes meanwhile could change the
choice), and every piece takes its place by its rank among the pieces of its length. What goes through the driver is bounded by
the capacity, whatever the number of documents. Ranks come from ranges that are numbered apart, in the order of id, piece and
checksum, so the packing does not hang on files or partitions, and a frequent length is spread over the tasks.

Ids are those of the ``tokenizers`` library. A text is cut at single spaces between two characters that are no white space, which
are borders of byte-level pieces in any text; equal chunks are encoded once and remembered. If a rank file of the same vocabulary
is given, chunks of ASCII and Latin letters go to ``tiktoken``, which has the same ids for a third of the time; the rest, and
without ranks all, goes to ``tokenizers``.

Defined cases: a null or empty text is the end token alone; the string of a special token in a text is ordinary text; texts of any length are encoded whole; a document longer than the
capacity is cut, full pieces last, so its first piece may be shorter; rows with equal ids are packed each; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import read_ranks
from quire.llm.common import materialize, placed
from quire.llm.words import shards
from quire.session import ship_by_value

CAPACITY = 1024
END = 2
#: Chunks that a worker remembers, and the longest that it does.
MEMO = 1_000_000
MEMO_CHARS = 64
#: Bytes of the texts that are encoded together, one text at least.
SHARD = 16_000_000
#: All white space but the space, and the spaces at which a text with other white space next to some may be cut.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Chunks of ASCII and Latin letters, on which every version of the character tables agrees.
_PLAIN = re.compile(r"[!-~\n\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_RANK_BITS = 48


class Chunks:
    """Token ids of text columns. Chunks are kept without the space before them, their ids packed as little-endian 32 bits."""

    def __init__(self, tokenizer, ranks=None):
        self.tokenizer, self.ranks, self.chunks = tokenizer, ranks, {}
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of every text."""
        texts = column.to_pylist()
        odd = {i: _BORDER.split(t) for i, t in enumerate(texts) if is_odd(t)}
        if odd:
            column = pa.array([t if i not in odd else "" for i, t in enumerate(texts)], column.type)
        parts = pc.split_pattern(column, " ")
        counts, words = np.diff(parts.offsets.to_numpy()), parts.flatten()
        if odd:
            rows = [odd.get(i) for i in range(len(texts))]
            sizes = np.array([c if r is None else len(r) for r, c in zip(rows, counts.tolist(), strict=True)], np.int64)
            place = np.cumsum(counts) - counts
            words = pa.concat_arrays([words[p : p + c] if r is None else pa.array(r, words.type) for r, p, c in zip(rows, place.tolist(), counts.tolist(), strict=True)])
            counts = sizes
        coded = words.dictionary_encode()
        codes, unique = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        first = np.cumsum(counts) - counts  # a text's first chunk has no space before it
        heads = [unique[c] for c in codes[first].tolist()]
        codes[first] = len(unique) + np.arange(len(heads))
        ids = self.known(unique, heads).__getitem__
        codes, ends = codes.tolist(), np.cumsum(counts).tolist()
        return [b"".join(map(ids, codes[end - n : end])) for n, end in zip(counts.tolist(), ends, strict=True)]

    def known(self, unique: list[str], heads: list[str]) -> list[bytes]:
        """The ids of chunks and of heads."""
        memo = self.chunks
        fresh = [c for c in unique if c not in memo]
        rest = fresh
        if self.ranks is not None:
            plain, rest, encode = _PLAIN.fullmatch, [], self.ranks.encode_ordinary
            for c in fresh:
                if plain(c):
                    memo[c] = pack_ids(encode(" " + c))
                else:
                    rest.append(c)
        memo.update(zip(rest, self.by_tokenizer([" " + c for c in rest]), strict=True))
        out = [*map(memo.__getitem__, unique), *self.by_tokenizer(heads)]
        for long in [c for c in fresh if len(c) > MEMO_CHARS]:
            del memo[long]
        if len(memo) > MEMO:  # the older half goes; frequent chunks soon come back
            self.chunks = dict(islice(memo.items(), len(memo) // 2, None))
        return out

    def by_tokenizer(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def chunks_of(described: str, ranks: dict[bytes, int] | None, pattern: str) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tiktoken
    from tokenizers import Tokenizer

    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None
    return Chunks(Tokenizer.from_str(described), fast)


def is_odd(text: str) -> bool:
    """True if white space stands next to a space, or a space at an end: not all spaces are borders."""
    return "  " in text or text[:1] == " " or text[-1:] == " " or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def lengths_of(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: full ones last."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def pieces_of(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text",
    ranks_path: str | None = None, pattern: str = "",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (on request ``ids``) of all pieces; paths are read on the driver only."""
    for module in (__name__, "quire.llm.words"):
        ship_by_value(module)
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast({"json": file.read(), "ranks": read_ranks(ranks_path) if ranks_path else None})
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # a worker keeps its chunks for the next task
        if "chunks" not in held:
            held["chunks"] = chunks_of(held["json"], held["ranks"], pattern)
        chunks = held["chunks"]
        for batch in batches:
            for a, b, _, _ in shards(batch.column(1), SHARD):
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, packed in enumerate(chunks.encode(batch.column(1)[a:b].fill_null(""))):
                    packed += tail
                    at = 0
                    for k, n in enumerate(lengths_of(len(packed) // 4, capacity)):
                        part = packed[4 * at : 4 * (at + n)]
                        owner.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        at += n
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    schema = f"doc_id {narrow.schema['_doc'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return narrow.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def _widest_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two free lengths whose sum is the largest up to ``room``; of equal sums the one with the longest piece."""
    there = np.flatnonzero(free[: room + 1])
    best, pair = 0, None
    low, high = 0, len(there) - 1
    while low <= high:
        a, b = int(there[low]), int(there[high])
        if a + b > room or (low == high and free[a] < 2):
            high -= 1
            continue
        if a + b > best:
            best, pair = a + b, (a, b)
        low += 1
    return pair


def _fill(free: np.ndarray, capacity: int, swap: bool = True) -> dict[int, int]:
    """One sequence as counts per length; ``free`` (counts by length) is left as it was."""
    free, gap, packed = free.copy(), capacity, {}

    def put(n: int, times: int) -> None:
        nonlocal gap
        free[n] -= times
        gap -= n * times
        packed[n] = packed.get(n, 0) + times
        if not packed[n]:
            del packed[n]

    while gap > 0 and len(fits := np.flatnonzero(free[: gap + 1])):
        n = int(fits[-1])
        put(n, min(int(free[n]), gap // n))
    while swap and gap > 0 and packed:
        least = min(packed)
        put(least, -1)
        pair = _widest_pair(free, gap)
        if pair is None or sum(pair) <= least:
            put(least, 1)
            break
        put(pair[0], 1)
        put(pair[1], 1)
    return packed


def patterns(counts: dict[int, int], capacity: int = CAPACITY, swap: bool = True) -> list[tuple[int, dict[int, int]]]:
    """(times used, counts per length) until all pieces are packed."""
    free = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        free[n] = k
    out = []
    while free.any():
        packed = _fill(free, capacity, swap)
        times = min(int(free[n]) // k for n, k in packed.items())
        for n, k in packed.items():
            free[n] -= times * k
        out.append((times, packed))
    return out


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """The patterns with replacements, or those of the greedy filling alone in the rare case that they need fewer sequences."""
    plans = patterns(counts, capacity), patterns(counts, capacity, swap=False)
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _ranges(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Sorted rows: length and first rank in one number, first sequence, pieces of the length per sequence, their first offset."""
    rows, used, sequence = [], {}, 0
    for times, packed in plan:
        offset = 0
        for n in sorted(packed, reverse=True):
            rows.append(((n << _RANK_BITS) + used.get(n, 0), used.get(n, 0), sequence, packed[n], offset))
            used[n] = used.get(n, 0) + times * packed[n]
            offset += n * packed[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    ship_by_value(__name__)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    shared = pieces.sparkSession.sparkContext.broadcast(_ranges(fewest(counts, capacity)))
    ranked = placed(pieces, "length", ["doc_id", "piece", "ids_crc32"]).drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, low, sequence, each, offset = shared.value.T
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            i = np.searchsorted(first, (length << _RANK_BITS) + rank, "right") - 1
            nth, slot = np.divmod(rank - low[i], each[i])
            rest = [c for c in batch.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(sequence[i] + nth), pa.array(offset[i] + slot * length)], names=[*rest, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "at")
    return ranked.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` of pieces that were packed with their ids; a sequence holds ``capacity`` tokens at most."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))


def op11_packing(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1,024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path
    pieces = pieces_of(docs, path("byte_bpe_50k.json"), ranks_path=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return pack(materialize(pieces, "packing-pieces"))
