"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece of bytes is halved down to leaves of a few bytes, which are merged
directly; the encodings of two halves are joined by encoding a window around the boundary anew. The window starts
with one token from each side and doubles on a side until the window's outer
token there is the token that stood there before (or the side is used up).
Then nothing outside can change: a sequence is the encoding of its bytes
exactly if every two neighbours are the encoding of theirs (merges are taken
by rank, leftmost first, so a merge across a boundary shows up in the two
tokens beside it alone), and each pair of the result lies within an old
encoding or within the window. Joining is associative, so halves of any text
may be encoded anywhere; here a row's text is one tree in one task and Spark
spreads the rows.

Decoding looks up blocks of ids and concatenates them up a tree.

Ids are stored as little-endian unsigned 32-bit integers in a binary column,
the usual form of token shards.

Defined results:

* a null text counts as empty; an empty text has no ids and decodes to no
  bytes; null ids decode to no bytes;
* texts of any length are taken whole, cut internally only where no match of
  the split pattern can cross; a piece of any length is one tree;
* strings of special tokens are ordinary text;
* rows are handled one by one: repeated rows give repeated results, an empty
  table an empty one, and all other columns stay as they are;
* an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import heapq
import re

from pyspark.sql import Column, SparkSession, functions as F

from .common import list_udf, share

LONGEST_KEPT = 48
LEAF = 12
LONGEST_WINDOW = 8
KEPT = 1 << 17
NO_RANK = 1 << 62
SEGMENT = 1 << 20
BLOCK = 1 << 16
DIRECT = 48


def keep(known: dict, key, value) -> None:
    """Remember a result; a full table starts anew."""
    if len(known) >= KEPT:
        known.clear()
    known[key] = value


class Codec:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, table: bytes, pattern: str):
        import regex

        self.ranks = {}
        for line in table.splitlines():
            token, rank = line.split()
            self.ranks[base64.b64decode(token)] = int(rank)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank table lacks single bytes")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = [bytes([b]) for b in range(256)]
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.chunk = regex.compile(r"\s*\S+|\s+")
        self.cut = regex.compile(r"(?<=\S) ")
        # What this process has met: windows, pieces, words after a space.
        self.windows: dict[bytes, list[bytes]] = {}
        self.pieces: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}

    # Encoding of byte pieces.

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a window: lowest rank first, leftmost first among equals."""
        known = self.windows.get(data) if len(data) <= LONGEST_WINDOW else None
        if known is not None:
            return known
        if len(data) > DIRECT:
            return self._merged_long(data)
        rank_of, parts = self.ranks.get, [self.single[b] for b in data]
        ranks = [rank_of(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]  # of each part with the next
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            whole = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(whole + parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + whole, NO_RANK)
        if len(data) <= LONGEST_WINDOW:
            keep(self.windows, data, parts)
        return parts

    def _merged_long(self, data: bytes) -> list[bytes]:
        """As :meth:`merged`, with a heap over the neighbours of a linked list."""
        ranks, n = self.ranks, len(data)
        parts: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [p for p in parts if p is not None]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self.merged(b"".join(left[-a:] + right[:b]))
            stable_left = window[0] == left[-a] or a == len(left)
            stable_right = window[-1] == right[b - 1] or b == len(right)
            if stable_left and stable_right:
                return left[:-a] + window + right[b:]
            if not stable_left:
                a = min(2 * a, len(left))
            if not stable_right:
                b = min(2 * b, len(right))

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merged(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def encode_piece(self, piece: str) -> bytes:
        """Packed ids of one match of the pattern; a piece that is a token is that token."""
        known = self.pieces.get(piece)
        if known is None:
            data = piece.encode("utf-8")
            known = self.packed.get(data) or b"".join([self.packed[t] for t in self.tree(data)])
            if len(piece) <= LONGEST_KEPT:
                keep(self.pieces, piece, known)
        return known

    # Encoding of texts.

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join([self.encode_piece(m) for m in self.split.findall(chunk)])

    def _encode_segment(self, text: str) -> bytes:
        """No match reaches from other characters into white space, so each such place may be cut."""
        if re.search(r"\s ", text):
            return b"".join([self.encode_chunk(c) for c in self.chunk.findall(text)])
        words = text.split(" ")
        known = self.after_space
        found = [known.get(w) for w in words[1:]]
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i + 1]
                    found[i] = known.get(word) or self.encode_chunk(" " + word)
                    if len(word) <= LONGEST_KEPT:
                        keep(known, word, found[i])
        return self.encode_chunk(words[0]) + b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out, start = [], 0
        while start < len(text):
            place = self.cut.search(text, start + SEGMENT) if len(text) - start > SEGMENT else None
            end = place.start() if place else len(text)
            out.append(self._encode_segment(text[start:end]))
            start = end
        return b"".join(out)

    # Decoding.

    def decode(self, ids: bytes | None) -> bytes:
        import numpy as np

        return self._decode(np.frombuffer(ids or b"", "<u4"))

    def _decode(self, ids) -> bytes:
        if len(ids) > BLOCK:
            middle = len(ids) // 2
            return self._decode(ids[:middle]) + self._decode(ids[middle:])
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Bpe:
    """Column functions for one vocabulary: ``Bpe(spark, path, pattern).encode(col)``.

    The rank file (under a megabyte; its size is that of the vocabulary) is
    read once on the driver and broadcast.
    """

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            self._table = share(spark, file.read())
        self._pattern = pattern

    def _udf(self, function, kind, returns: str):
        shared, pattern = self._table, self._pattern

        def setup():
            own = Codec(shared(), pattern)  # a task's own, freed with it
            return lambda values: [function(own, v) for v in values]

        return list_udf(setup, kind, returns)

    def encode(self, text: Column) -> Column:
        """Binary column of packed ids."""
        import pyarrow as pa

        return self._udf(Codec.encode, pa.binary(), "binary")(text)

    def decode(self, ids: Column) -> Column:
        """Binary column of the bytes that packed ids stand for."""
        import pyarrow as pa

        return self._udf(Codec.decode, pa.binary(), "binary")(ids)

    def round_trip(self, text: Column) -> Column:
        """Struct column: ids, and the bytes that decoding them gives, in one pass of the task's worker."""
        import pyarrow as pa

        def both(own: Codec, value: str | None) -> dict[str, bytes]:
            ids = own.encode(value)
            return {"ids": ids, "bytes": own.decode(ids)}

        kind = pa.struct([("ids", pa.binary()), ("bytes", pa.binary())])
        return self._udf(both, kind, "ids binary, bytes binary")(text)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
