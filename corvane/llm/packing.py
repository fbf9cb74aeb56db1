"""Packing: Karmarkar-Karp multiway differencing of document pieces into windows.

A document of more than one window gives whole windows first; what remains is cut into pieces of
at most ``piece`` ids. A pool of pieces is differenced over m windows: the two partial partitions
of the largest spread are merged, the fullest windows of one with the emptiest of the other, until
one partition is left. Where its fullest window exceeds the capacity, m rises and the pool is
differenced again. Pools are made and packed inside the task that tokenizes, so nothing is
shuffled, and a lost task is made again from its own input split.

Null and empty texts hold the end id alone; repeated rows are packed as often as they occur; a null
doc_id is carried as null; an empty table gives no rows; other columns are not read. Piece order in a
window is by pool order.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import CACHES, emitted, serving

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
END_ID = 1
#: Cached words of a worker; beyond it the cache starts again.
CACHED = 400_000
#: All white space but the space and the line feed: what str.split takes, which includes what the vocabulary's pattern takes.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]


def located(vocabulary: str | None) -> str | None:
    """A path as it is; the name of a public vocabulary as its path on the machine that asks."""
    if not vocabulary or "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def regular(text: str) -> bool:
    """Whether the white space of a text is single spaces and line feeds between words.

    Without other white space, a text of n spaces and line feeds has at most n + 1 words, and just
    as many only where each of them stands alone between two words.
    """
    if any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)):
        return False
    return len(text.split()) == text.count(" ") + text.count("\n") + 1


class Tokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those of ``tokenizers``.

    In a text whose white space is single spaces and line feeds between words, no token of the
    byte-level vocabulary crosses a break, so each word (with its leading space) is encoded once
    and cached. Any other text is encoded as a whole.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer as Whole

        self.whole = Whole.from_file(located(vocabulary))
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.ordinary = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(located(ranks), "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ordinary = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

        self.feed = self._ids("\n")[0]

    def _ids(self, text: str) -> list[int]:
        return self.ordinary.encode_ordinary(text) if self.ordinary else self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        """One call for all new words, apart by line feeds, which are tokens of their own there."""
        ids = np.array(self._ids("\n".join(new)), "<u4")
        begin = 0
        for word, end in zip(new, [*np.flatnonzero(ids == self.feed).tolist(), len(ids)], strict=True):
            self.words[word] = ids[begin:end].tobytes()
            begin = end + 1

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not regular(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > CACHED:
            self.words.clear()
        if not self.words:
            self.words["\n"] = np.array([self.feed], "<u4").tobytes()
        cut = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00") if "\x00" not in text else _cut(text)
        if new := [w for w in dict.fromkeys(cut) if w not in self.words]:
            self._learn(new)
        return b"".join(map(self.words.__getitem__, cut))


def _cut(text: str) -> list[str]:
    """Words with their leading spaces, line feeds apart, of a text that holds NUL."""
    out, begin = [], 0
    for at, char in enumerate(text):
        if char == " ":
            out.append(text[begin:at])
            begin = at
        elif char == "\n":
            out += [text[begin:at], "\n"]
            begin = at + 1
    return [x for x in [*out, text[begin:]] if x]


@cache
def tokenizer(vocabulary: str, ranks: str | None) -> Tokenizer:
    return Tokenizer(vocabulary, ranks)


CACHES["packing"] = tokenizer.cache_clear


def differencing(sizes: list[int], windows: int) -> list[tuple[int, tuple]]:
    """Karmarkar-Karp over ``windows`` parts: (sum, tree of indices) for each part that isn't empty."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:  # the emptiest of a meet the fullest of b: opposing imbalances
            keep_a, keep_b = len(a) - over, len(b) - over
            meet = [(x + y, (n, m)) for (x, n), (y, m) in zip(a[keep_a:], reversed(b[keep_b:]))]
            merged = a[:keep_a] + meet + b[:keep_b]
        merged.sort(key=_sum, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        count += 1
        heapq.heappush(heap, (-spread, count, merged))
    return heap[0][2] if heap else []


def _sum(part: tuple) -> int:
    return part[0]


def leaves(tree: int | tuple) -> list[int]:
    out, stack = [], [tree]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack += top
        else:
            out.append(top)
    return sorted(out)


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by window, no window over ``capacity``; the count starts at the least possible and rises when needed."""
    total = sum(sizes)
    count = -(-total // capacity)
    while sizes:
        parts = differencing(sizes, count)
        if parts[0][0] <= capacity:
            return [leaves(tree) for _, tree in parts]
        count += max(1, count * (parts[0][0] - capacity) // (4 * capacity))
    return []


def packer(vocabulary: str, ranks: str | None, capacity: int, piece: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("packing")
        encode = tokenizer(vocabulary, ranks).encode
        first = TaskContext.get().partitionId() << 32
        end = np.array([END_ID], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            number, waiting = first, []

            def packed() -> Iterator[tuple]:
                nonlocal number
                for window in windows_of([p[2] for p in waiting], capacity):
                    offset = 0
                    for i in window:
                        yield (*waiting[i], number, offset)
                        offset += waiting[i][2]
                    number += 1

            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "") + end
                    total = len(ids) // 4
                    start = 0
                    while total - start >= capacity:
                        yield doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, number, 0
                        number += 1
                        start += capacity
                    while start < total:
                        length = min(piece, total - start)
                        waiting.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                        start += length
                    if len(waiting) >= pool:
                        yield from packed()
                        waiting = []
            yield from packed()

        yield from emitted(rows(), ARROW)

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 2048, piece: int = 512, pool: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: SCHEMA.

    vocabulary: a path that all machines have, or the name of a public vocabulary, found where the task runs.
    ranks: the same vocabulary for the faster word encoder, or None.
    """
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(packer(vocabulary, ranks, capacity, piece, pool), SCHEMA)
