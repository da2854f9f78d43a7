"""Byte-pair encoding with a public vocabulary: a priority queue of merges over a doubly linked symbol list.

The vocabulary file is a parameter; the driver reads it and its bytes, about one MB, go to the executors once. A pre-token is first cut wherever no token
of the vocabulary holds the two bytes that meet there: no merge can ever cross such a place, so the parts are
encoded on their own, are short, and recur - which is what makes the cache of encoded parts effective.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable
from functools import lru_cache

import regex

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZERS = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
CACHE_PARTS = 200_000


def merge_symbols(symbols: list, rank_of: Callable[[object, object], int | None], join: Callable[[object, object], object]) -> list:
    """Merge neighbours in order of rank, leftmost first among equals, until no pair has a rank.

    The symbols are a doubly linked list, the possible merges a heap; an entry whose symbols have changed since it
    was pushed is stale and skipped.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, object, object]] = []
    for i in range(n - 1):
        rank = rank_of(symbols[i], symbols[i + 1])
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i] = join(left, right)
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            rank = rank_of(symbols[i], symbols[after[i]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[after[i]]))
        p = before[i]
        if p >= 0:
            rank = rank_of(symbols[p], symbols[i])
            if rank is not None:
                heapq.heappush(heap, (rank, p, symbols[p], symbols[i]))
    return [s for s, a in zip(symbols, alive) if a]


class BytePairs:
    """Encoder and decoder for the contents of a rank file."""

    def __init__(self, ranks: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.meets = {token[i : i + 2] for token in self.ranks for i in range(len(token) - 1)}
        self.split = regex.compile(PATTERN)
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _part(self, part: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(part)
        if rank is not None and len(part) == 1:
            return (rank,)
        ranks = self.ranks
        symbols = merge_symbols([part[i : i + 1] for i in range(len(part))], lambda a, b: ranks.get(a + b), lambda a, b: a + b)
        return tuple(ranks[s] for s in symbols)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        ids: list[int] = []
        meets, parts, start = self.meets, self.parts, 0
        for i in range(1, len(data) + 1):
            if i == len(data) or data[i - 1 : i + 1] not in meets:
                part = data[start:i]
                got = parts.get(part)
                if got is None:
                    got = self._part(part)
                    if len(part) <= 64:
                        if len(parts) >= CACHE_PARTS:
                            parts.clear()
                        parts[part] = got
                ids.extend(got)
                start = i
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """The ids of the text without special tokens; a null or empty text has none."""
        if not text:
            return []
        ids: list[int] = []
        pieces = self.pieces
        for piece in self.split.findall(text):
            got = pieces.get(piece)
            if got is None:
                got = self._piece(piece)
                if len(piece) <= 32:
                    if len(pieces) >= CACHE_PARTS:
                        pieces.clear()
                    pieces[piece] = got
            ids.extend(got)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: their vocabulary strings one after the other."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder_of(ranks: bytes) -> BytePairs:
    """The encoder of the contents of a rank file, one per Python worker."""
    return BytePairs(ranks)


def encoder(path: str) -> BytePairs:
    """The encoder of a rank file on this machine."""
    with open(path, "rb") as file:
        return encoder_of(file.read())


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")
