"""Byte-level BPE by a monoid tree: texts and pieces are halved, the halves encoded, and neighbours joined.

A text's value is its list of pieces (matches of the split pattern); a piece's value is its list of token ids. Both
have an associative join. It keeps what the seam can't change and works out anew what it can, in a window around the
seam that grows until its ends are proven to stand:

* Pieces. A match depends on the text from its start to at most LOOK characters beyond its end, so pieces of the left
  half that end LOOK characters before the seam stand. Matching goes on from the last of them. Where a new piece that
  stands ends at a place where a piece of the right half begins, all further pieces are those of the right half.
* Tokens. A list of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of their
  own bytes. So a window of tokens around the seam is encoded anew; its result stands once its first token pairs with
  the token before it, and its last one with the token after it. Otherwise the window doubles.

Decoding is the free monoid's: bytes are concatenated up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, spread

#: Characters beyond a match's end that can have a say in it.
LOOK = 3
#: Characters of a text, and bytes of a piece, that are encoded without halving.
TEXT_LEAF, PIECE_LEAF = 4096, 48
#: Encodings of short pieces that a worker remembers.
REMEMBERED = 400_000


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.never = max(self.tokens, default=0) + 1  # the rank of what isn't a token
        self.paired: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(i) for t, i in (x.split() for x in lines if x.strip())}, pattern)

    # Tokens of one piece

    def leaf(self, data: bytes) -> list[int]:
        """Merge the neighbours of the lowest rank, the leftmost first, until none merge."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > PIECE_LEAF:
            return self.long_leaf(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, never = self.ranks.get, self.never
        # The rank of each part with the next; a merge changes those of its neighbours alone
        ranks = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], never)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], never)
        return [self.ranks[p] for p in parts]

    def long_leaf(self, data: bytes) -> list[int]:
        """As leaf, in n log n steps: merges wait in a heap by rank and place, and stale ones are skipped."""
        n, rank = len(data), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := rank(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = after[i]
        return out

    def pairs(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes."""
        if (found := self.paired.get((a, b))) is None:
            if len(self.paired) > REMEMBERED:
                self.paired.clear()
            found = self.paired[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.pairs(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            head, tail = left[:-size], right[size:]
            window = self.leaf(b"".join(map(self.tokens.__getitem__, chain(left[-size:], right[:size]))))
            if (not head or self.pairs(head[-1], window[0])) and (not tail or self.pairs(window[-1], tail[0])):
                return head + window + tail
            size *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= PIECE_LEAF:
            return self.leaf(data)
        half = 1 << (len(data) - 1).bit_length() - 1  # runs of one byte merge by powers of two, and so fit together here
        return self.join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    # Pieces of a text

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        cut, loose = len(left), 0
        while cut and loose < LOOK:
            cut -= 1
            loose += len(left[cut])
        # loose: characters from the first piece that may change; one more piece may end exactly LOOK before the seam
        kept, rest, size = left[:cut], "".join(left[cut:]), 1
        while True:
            text = rest + "".join(right[:size])
            if size >= len(right):
                return kept + self.pattern.findall(text)
            starts, at = {}, len(rest)
            for i, p in enumerate(right[: size + 1]):
                starts[at] = i
                at += len(p)
            at, new = 0, []
            for p in self.pattern.findall(text):
                at += len(p)
                if at + LOOK > len(text):
                    break
                new.append(p)
                if (i := starts.get(at)) is not None:
                    return kept + new + right[i:]
            size *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= TEXT_LEAF:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> list[int]:
        known, lists = self.known, []
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode())
                if len(p) <= PIECE_LEAF:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[p] = ids
            lists.append(ids)
        return list(chain.from_iterable(lists))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TEXT_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec.load(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: doc_id, token_ids (if ids), n_tokens, ids_sha256, decoded_sha256.

    path is a rank file that workers can open. A null text counts as empty: no tokens, and the digests of nothing. A
    null id stays null; repeated rows each get a row; an empty table gives an empty result; further columns are left
    aside. The cost of a text grows with its length alone, also for one piece without any break.
    """
    names = ["doc_id", *["token_ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [f"doc_id {df.schema[id_col].dataType.simpleString()}", *["token_ids array<int>"] * ids, "n_tokens long, ids_sha256 string, decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            made, counts, shas, back = [], [], [], []
            for text in batch.column(1):
                out = codec.encode(text.as_py() or "")
                counts.append(len(out))
                shas.append(hashlib.sha256(",".join(map(str, out)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(out)).hexdigest())
                if ids:
                    made.append(out)
            columns = [batch.column(0), *[pa.array(made, pa.list_(pa.int32()))] * ids, pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))).mapInArrow(run, ", ".join(kinds))


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Per row: doc_id and the bytes (payload) that its token ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def back(column):
        codec = _codec(path, pattern)
        return column.map(lambda x: None if x is None else codec.decode(list(x)))

    return df.select(df[id_col].alias("doc_id"), back(df[ids_col]).alias("payload"))


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), *default_files(), ids=False)
