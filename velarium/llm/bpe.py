"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is encoded by itself. Its bytes form a linked list; every adjacent pair that has a merge
rank puts the position of its left part into that rank's bucket, and a two-level bitmap over the ranks marks the buckets that are
not empty. Find-first-set on the upper and the lower word gives the next rank. An entry is stale if its left part has gone or
its pair has another rank by now; such entries are skipped. A merge adds at most two entries, so a piece of n bytes costs
O(n) queue operations, however long it is.

Null and empty texts give no ids. Ids are whole-text results; decoding goes from the ids back to bytes. Texts of any length are read whole, and a piece of any length is one list in a task. Rows
that repeat id and text are encoded each. An empty table gives an empty result. Other columns stay as they are, whatever their names, but for a column with the name of the result's, which it replaces. The
rank file has to be at the same path on every executor.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.shared import ship

#: Pieces that one worker remembers before it starts anew.
REMEMBERED = 1_000_000
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}


#: A split pattern, and the same for texts below U+02B0 in classes that the faster `re` knows (fixed values).
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
BEYOND_LATIN = re.compile("[\u02b0-\U0010ffff]")


class Codec:
    """Encoding and decoding by a rank table; pieces seen before come from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # every way to cut a token in two known tokens: the pair's ids make one key
        self.pair_rank = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.byte_id = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.general = regex.compile(pattern).findall
        self.latin = re.compile(LATIN).findall if pattern == GENERAL else None
        self.memory: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of least rank, leftmost first, is merged until no pair has a rank.

        `part` holds the id at each position of the linked list, -1 where a part was merged into its left one. `buckets` has
        the positions of each rank; `low` and `top` are the two levels of the bitmap over ranks, 256 ranks to a word.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        byte_id, rank_of = self.byte_id, self.pair_rank.get
        part = [byte_id[b] for b in piece]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        left = part[0]
        for i in range(1, n):
            right = part[i]
            rank = rank_of(left << 32 | right)
            left = right
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i - 1)
                else:
                    buckets[rank] = [i - 1]
                    block = rank >> 8
                    low[block] = low.get(block, 0) | 1 << (rank & 255)
                    top |= 1 << block
        while top:
            block = (top & -top).bit_length() - 1
            word = low[block]
            rank = block << 8 | ((word & -word).bit_length() - 1)
            word &= word - 1
            low[block] = word
            if not word:
                top &= top - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                j = after[i]
                if part[i] < 0 or j >= n or rank_of(part[i] << 32 | part[j]) != rank:
                    continue  # stale
                part[i], part[j] = rank, -1
                k = after[i] = after[j]
                h = before[i]
                found = []
                if k < n:
                    before[k] = i
                    found.append((rank_of(rank << 32 | part[k]), i))
                if h >= 0:
                    found.append((rank_of(part[h] << 32 | rank), h))
                for other, at in found:
                    if other is not None:
                        if other in buckets:
                            buckets[other].append(at)
                        else:
                            buckets[other] = [at]
                            block = other >> 8
                            low[block] = low.get(block, 0) | 1 << (other & 255)
                            top |= 1 << block
        return [p for p in part if p >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memory, out = self.memory, []
        pieces = self.latin if self.latin and not BEYOND_LATIN.search(text) else self.general
        for piece in pieces(text):
            ids = memory.get(piece)
            if ids is None:
                ids = array("I", self.merge(piece.encode("utf-8"))).tobytes()
                if len(piece) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, one in each Python worker."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, pattern] = Codec(read_ranks(f.read()), pattern)
    return _CODECS[path, pattern]


def _struct_udf(kind: str, work):
    from pyspark.sql.functions import arrow_udf

    return arrow_udf(kind)(work)


def _digests(path: str, pattern: str):
    def digests(text: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        n, ids_hex, text_hex = [], [], []
        for x in text:
            ids = own.encode_bytes(x.as_py() or "")
            n.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            text_hex.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, SHA-256 of the ids and of the bytes that they decode to."""
    ship(docs.sparkSession)
    found = _struct_udf(RESULT, _digests(path, pattern))(F.col(text_col))
    return docs.select(F.col(id_col), found.alias("__bpe")).select(id_col, "__bpe.n_tokens", "__bpe.ids_sha256", "__bpe.decoded_sha256")


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the token ids of the text as an array."""
    ship(docs.sparkSession)

    def ids_of(text: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([list(array("I", own.encode_bytes(x.as_py() or ""))) for x in text], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, _struct_udf("array<int>", ids_of)(F.col(text_col)))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`rows` with the text that the ids stand for; bytes that are not UTF-8 become U+FFFD. Null ids give null."""
    ship(rows.sparkSession)

    def text_of(ids: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([None if (v := x.as_py()) is None else own.decode_bytes(array("I", v).tobytes()).decode("utf-8", "replace") for x in ids], pa.string())

    return rows.withColumn(text_col, _struct_udf("string", text_of)(F.col(ids_col)))
