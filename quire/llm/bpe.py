"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of n bytes has n - 1 adjacent pairs.  Leaf i of the tree holds the rank
of the pair that starts at the live part at byte i (or NONE); each inner node
holds the least rank below it, so the root gives the next merge and a descent
that prefers the left child gives its leftmost place.  A merge is three point
updates (the merged part, its left neighbour, the part that vanished), each
logarithmic in n: a run of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from quire.llm._batches import RESIDENT, map_chunks, texts
from quire.llm.pieces import PieceCache

NONE = 1 << 60
# Fixed value: the public pattern whose pieces never go on past a single space.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space: there a piece may go on past it.
_RUNS = regex.compile(r"\s | \s")


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """The ranks of a `.tiktoken` file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, blob.splitlines()))}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: merge the pair of least rank, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    get = ranks.get
    size = 1
    while size < n - 1:
        size <<= 1
    tree = [NONE] * size
    tree += [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    tree += [NONE] * (2 * size - len(tree))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))  # where the live part at i ends
    before = list(range(-1, n))  # where the live part left of the one at i starts
    while (least := tree[1]) != NONE:
        i = 1
        while i < size:
            i += i
            if tree[i] != least:
                i += 1
        i -= size
        j = after[i]  # the part that vanishes
        end = after[j]
        after[i] = end
        before[end] = i
        left = before[i]
        tree[size + i] = get(piece[i : after[end]], NONE) if end < n else NONE
        if j < n - 1:
            at = size + j
            tree[at] = NONE
            while at > 1:
                at >>= 1
                a, b = tree[at + at], tree[at + at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
        at = size + i
        while at > 1:
            at >>= 1
            a, b = tree[at + at], tree[at + at + 1]
            if b < a:
                a = b
            if tree[at] == a:
                break
            tree[at] = a
        if left >= 0:
            at = size + left
            tree[at] = get(piece[left:end], NONE)
            while at > 1:
                at >>= 1
                a, b = tree[at + at], tree[at + at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encode and decode whole texts; `pattern` splits a text into pieces.

    Where the pattern is CUTS, a text without a space beside other white space is cut
    before each space, as no piece goes on past one there, and each cut is cached.
    Other texts, and all texts of other patterns, are split whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 150_000) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.cuts = pattern == CUTS
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.names = {str(v): k for k, v in ranks.items()}
        piece = PieceCache(lambda p: " ".join(map(str, encode_piece(p.encode("utf-8"), ranks))), 2 * cached)
        self.piece = piece
        self.chunk = PieceCache(lambda c: " ".join([piece[p] for p in self.split(c)]), cached)

    def encode_text(self, text: str) -> str:
        """Decimal ids, joined by one space."""
        if not text:
            return ""
        if not self.cuts or _RUNS.search(text) or text[-1].isspace():
            piece = self.piece
            return " ".join([piece[p] for p in self.split(text)])
        first, *rest = text.split(" ")
        chunk = self.chunk
        out = [chunk[" " + w] for w in rest]
        if first:
            out.insert(0, chunk[first])
        return " ".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec a Python worker: its caches serve all tasks that the worker runs."""
    return Codec(load_ranks(ranks), pattern)


RESIDENT["bpe"] = codec.cache_clear


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the decimal ids of the whole text, joined by one space), n_tokens, ids_sha256, decoded_sha256.

    `ranks` is the content of a `.tiktoken` file, of fixed size, and is broadcast.
    A null or empty text has no ids; its digests are those of the empty string.
    A repeated row is encoded as often as it occurs.  There is no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def make():
        own = codec(held.value, pattern)
        names = own.names

        def step(ids, blobs):
            out = {"doc_id": ids, "ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for blob in blobs:
                said = own.encode_text(blob.decode("utf-8", "replace"))
                parts = said.split()
                out["ids"].append(said)
                out["n_tokens"].append(len(parts))
                out["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([names[p] for p in parts])).hexdigest())
            return out

        return step

    return map_chunks(texts(docs, id_col, text_col), "doc_id long, ids string, n_tokens long, ids_sha256 string, decoded_sha256 string", make, owner="bpe")
