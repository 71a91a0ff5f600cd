"""Byte-level BPE by longest matches and backtracking.

A rank file defines the merges. For each token the table ``left, right`` holds its last merge, so whether two tokens may
stand next to each other in the result of the merges can be read off the tokens alone: walk down their borders and see
if any merge across the border would have come first. A text piece is then encoded in one pass: take the longest
token that matches (an Aho-Corasick automaton over the bytes, written as Latin-1 characters), fall back to shorter
prefixes while the pair with the token before is not allowed, and step back where none is. Positions found to be dead
ends are marked, so no position is left twice and the work is linear in the piece. Pair answers are memoised; whole
pieces are, too, since words repeat.

The rank file is parsed on the driver and broadcast (about 1 MB, a vocabulary has a fixed size); executors need no file.
Each task works on Arrow batches; nothing is shuffled. Memory of a task is one batch, the automaton and two memos that are
emptied at a fixed size (this changes no result).

Defined cases: a null or empty text has no tokens; characters outside the basic plane are ordinary bytes; repeated
rows are encoded alike; an empty table gives no rows. Only texts are read from the other columns.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship_by_value

#: Pieces and pairs that a Python worker remembers at most.
MEMO = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tokenizer:
    """Encoder and decoder of one rank table; all 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # Python counts four control characters as white space that Unicode and the rank files' splitter do not
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(spaces).findall
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _PieceMemo(self)
        self.automaton = ahocorasick.Automaton()
        self.halves |= {ranks[bytes([i])]: (ranks[bytes([i])],) * 2 for i in range(256)}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) == 1 or self._learn_merge(token, rank):
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        for rank in self.halves:  # the next token to try when this one does not fit
            token = self.tokens[rank]
            for cut in range(len(token) - 1, 0, -1):
                if (at := ranks.get(token[:cut])) in self.halves:
                    self.shorter[rank] = at
                    break

    def _learn_merge(self, token: bytes, rank: int) -> bool:
        """Find the two tokens whose merge makes this one; False for a token that no merges can reach."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank and a in self.halves and b in self.halves and self._may_touch(a, b):
                self.merged[a, b] = rank
                self.halves[rank] = (a, b)
                return True
        return False

    def _may_touch(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens together would leave exactly these two tokens."""
        limit = 1 << 60
        while True:
            if self.merged.get((a, b), 1 << 60) < limit:
                return False
            for side in (0, 1) if a > b else (1, 0):  # open the younger token first, the other if it is a byte
                old = (a, b)[side]
                left, right = self.halves[old]
                if left != right or left != old:
                    if side == 0:
                        limit, a = old, right
                    else:
                        limit, b = old + 1, left
                    break
                limit = old if side == 0 else old + 1
            else:
                return True

    def pair_fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self._may_touch(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens that the merges give for one piece of text."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        letters = piece.decode("latin-1")
        greedy = [rank for _, (rank, _) in self.automaton.iter_long(letters)]
        if self._is_result(greedy, piece):
            return greedy
        n = len(piece)
        longest = [0] * n
        for end, (rank, length) in self.automaton.iter(letters):
            longest[end + 1 - length] = rank  # ends rise, so the last match that starts here is the longest
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, nxt = 0, longest[0]
        tokens, shorter = self.tokens, self.shorter
        while True:
            token: int | None = nxt
            while token is not None:
                end = at + len(tokens[token])
                if alive[end] and (not out or self.pair_fits(out[-1], token)):
                    break
                token = shorter.get(token)
            if token is None:  # no token fits here: this place is dead, shorten the one before
                alive[at] = 0
                nxt = out.pop()
                at -= len(tokens[nxt])
                continue
            out.append(token)
            at = end
            if at == n:
                return out
            nxt = longest[at]

    def _is_result(self, ids: list[int], piece: bytes) -> bool:
        """A list of tokens is the result of the merges exactly if it spells the piece and all neighbours fit."""
        return all(map(self.pair_fits, ids, ids[1:])) and self.decode(ids) == piece

    def encode_bytes(self, text: str) -> bytes:
        """The token ids of a text as little-endian unsigned 32-bit integers."""
        memo = self.pieces
        return b"".join([memo[piece] for piece in self.find(text)])

    def encode(self, text: str) -> array:
        return unpack(self.encode_bytes(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _PieceMemo(dict):
    """Packed ids by piece; of what is known, the older half is forgotten when ``MEMO`` pieces have come."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}

    def __missing__(self, piece: str) -> bytes:
        known = self.old.get(piece)
        if known is None:
            known = struct.pack(f"<{len(ids)}I", *ids) if (ids := self.tokenizer.encode_piece(piece.encode("utf-8"))) else b""
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = known
        return known


def unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    if sys.byteorder != "little":
        ids.byteswap()
    return ids


def shared_ranks(spark: SparkSession, path: str):
    """The rank table as a broadcast variable; the path is read on the driver only."""
    return spark.sparkContext.broadcast({"ranks": read_ranks(path)})


def tokenizer_of(shared, pattern: str) -> Tokenizer:
    """The tokenizer of a Python worker. It is kept in the worker's copy of the broadcast table for the next task."""
    held = shared.value
    if held.get("pattern") != pattern:
        held["tokenizer"], held["pattern"] = Tokenizer(held["ranks"], pattern), pattern
    return held["tokenizer"]


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for every row."""
    ship_by_value(__name__)
    shared = shared_ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(shared, pattern)
        for batch in batches:
            ids = [tok.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``data`` (binary) for every row of token ids."""
    ship_by_value(__name__)
    shared = shared_ranks(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: b for b, i in shared.value["ranks"].items()}
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, x.as_py() or [])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.binary())], names=["doc_id", "data"])

    narrow = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass and keep the counts and digests of both, so ids never leave the task."""
    ship_by_value(__name__)
    shared = shared_ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(shared, pattern)
        for batch in batches:
            counts, ids_digest, back_digest = [], [], []
            for t in batch.column(1):
                packed = tok.encode_bytes(t.as_py() or "")
                counts.append(len(packed) // 4)
                ids_digest.append(hashlib.sha256(packed).hexdigest())
                back_digest.append(hashlib.sha256(tok.decode(unpack(packed))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(back_digest, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col("doc_id"), F.col("text").alias("_text"))
    return narrow.mapInArrow(
        run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op3_bpe(docs: DataFrame) -> DataFrame:
    """Token counts and digests per document with the 50k multilingual rank file."""
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
