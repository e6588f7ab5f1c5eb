"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every leaf of the tree holds the rank of one adjacent pair (and its place, so that the leftmost of equal ranks
wins); a node holds the least of its FAN children and the root yields the next merge. A merge changes three leaves at
most, each by a point update in logarithmic time, until no mergeable pair remains.

The identifiers of pre-tokens are remembered in a worker up to a bound in bytes. Special tokens inside a text get
their own identifier.
"""

from __future__ import annotations

import array
import json
import sys

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Batches, Recent, sha256, utf8

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Bytes of remembered pre-tokens in a Python worker, about what one takes besides its text, and the longest one kept.
REMEMBERED, ENTRY, LONGEST = 64 << 20, 190, 256
#: Children of a node of the segment tree. A leaf holds rank << SHIFT | place, or FREE and more if its pair doesn't merge.
FAN, SHIFT, FREE = 16, 32, 1 << 60
LOW = (1 << SHIFT) - 1
_loaded: dict[int, "Codec"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec(Recent):
    """Pre-token -> its identifiers as packed little-endian 32-bit integers."""

    def __init__(self, vocabulary: bytes, bound: int = REMEMBERED):
        super().__init__(bound)
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.first = [ids[c] for c in letters]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.table[i] = b"".join(back[c] for c in token)
        for token, i in self.added.items():
            self.table[i] = token.encode()
        #: Adjacent pair (left << width | right) -> rank << SHIFT, and rank -> merged identifier.
        self.width = len(self.table).bit_length()
        self.ranks: dict[int, int] = {}
        self.products: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(ids[left] << self.width | ids[right], rank << SHIFT)
            self.products.append(ids[left + right])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merged(self, data: bytes) -> list[int]:
        """Identifiers of one pre-token."""
        ids = list(map(self.first.__getitem__, data))
        n = len(ids)
        if n < 2:
            return ids
        rank, width, products = self.ranks.get, self.width, self.products
        leaves = [rank(ids[i] << width | ids[i + 1], FREE) + i for i in range(n - 1)]
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        top, deep = levels[-1], len(levels) > 1
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(top)) < FREE:
            i = root & LOW
            j = following[i]
            k = following[i] = following[j]
            new = ids[i] = products[root >> SHIFT]
            ids[j] = -1
            if k < n:
                before[k] = i
                leaves[i] = rank(new << width | ids[k], FREE) + i
                leaves[j] = FREE
            else:
                leaves[i] = FREE
                if j < n - 1:
                    leaves[j] = FREE
            h = before[i]
            if h >= 0:
                leaves[h] = rank(ids[h] << width | new, FREE) + h
            if deep:
                for at in {i // FAN, min(j, n - 2) // FAN, max(h, 0) // FAN}:
                    for below, level in zip(levels, levels[1:]):
                        least = min(below[at * FAN : (at + 1) * FAN])
                        if level[at] == least:
                            break
                        level[at] = least
                        at //= FAN
        return [x for x in ids if x >= 0]

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            data = text.encode()
            packed = array.array("I", self.merged(data))
            if sys.byteorder == "big":
                packed.byteswap()
            out = packed.tobytes()
            if len(data) > LONGEST:
                return out
        self.keep(text, out, ENTRY + 2 * len(text) + len(out))
        return out

    def plain(self, text: str) -> bytes:
        """Packed identifiers of a text without special tokens."""
        return b"".join(map(self.__getitem__, PATTERN.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(parts))

    def decode(self, packed: bytes) -> str:
        ids = array.array("I")
        ids.frombytes(packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def loaded(vocabulary: bytes) -> Codec:
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(vocabulary)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (if wanted), ids_sha256, decoded_sha256.

    Null and empty texts encode to no identifiers; a null id stays null; repeated rows are encoded each; an empty
    table gives no rows; other columns of docs are not read. There is no shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else []), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Batches) -> Batches:
        codec = loaded(vocabulary)
        for b in batches:
            packed = [codec.encode(t.decode()) for t in utf8(b.column(1))]
            columns = [b.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if ids:
                columns.append(pa.array([memoryview(p).cast("i").tolist() if p else [] for p in packed], pa.list_(pa.int32())))
            columns += [pa.array([sha256(p) for p in packed], pa.string()), pa.array([sha256(codec.decode(p).encode()) for p in packed], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, vocabulary: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of the identifiers in ids_col; null and empty lists decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Batches) -> Batches:
        codec = loaded(vocabulary)
        for b in batches:
            rows = [array.array("I", [i for i in x or [] if i is not None]) for x in b.column(1).to_pylist()]
            texts = [b"".join(map(codec.table.__getitem__, r)).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    picked = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, text string")
