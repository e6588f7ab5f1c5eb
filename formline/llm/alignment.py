"""Cross-tokenizer alignment of byte-level tokens (A) and pieces (B) by as-of joins.

The tokens of both sides tile the same bytes, a space and the text. In each batch, keyed by document, every token start
of one side is joined by pandas' merge_asof to the other side's last start that isn't behind it, which is the
covering token. Both directions together give all overlaps; overlaps whose ends are equal are the links, and they cut
both sides into groups.

Neither vocabulary joins a space to what stands before it (checked on load), so that a text's tokens are those of its
words, each with the space before it. A worker remembers words within a bound in bytes, and asks the libraries for
all new words of a batch at once.

The bytes of two linked tokens end together, so that one's are a suffix of the other's: the pairs that can be linked
are known from both vocabularies (some hundreds of thousands). Their corpus-wide counts are one number for each
such pair, which bounds what is gathered and sent to the tasks whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import token_count
from .bpe import byte_letters
from .repeats import spooled
from .textops import BASE, Batches, Recent, utf8

SPACE = "▁"
#: Characters of text aligned at once, bytes of remembered words in a worker, and about what a word takes besides its letters.
SLICE, REMEMBERED, ENTRY, LONGEST = 1 << 18, 192 << 20, 200, 256
#: The bit that marks B's identifiers, and the mark of a word whose bytes differ between the sides.
SIDE, ODD_ID = 1 << 31, (1 << 31) - 1
ODD = (SIDE | ODD_ID).to_bytes(4, "little")
#: What keeps a text from being cut at every single space, and where it's cut then: before a space that follows no white space.
RAGGED = re.compile(r" \s")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
LONG = re.compile(r"(?<=\S)(?= \S)")
_loaded: dict[int, "Words"] = {}


def byte_tokens(vocabulary: bytes) -> list[bytes]:
    """The bytes of each identifier of a plain byte-level vocabulary."""
    spec = json.loads(vocabulary)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("only plain byte-level vocabularies are supported")
    ids, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    out = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in ids.items():
        if i not in added.values():
            out[i] = b"".join(back[c] for c in token)
    return out


def piece_tokens(processor: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece; control and unknown pieces have none."""
    n = processor.get_piece_size()
    pieces = [processor.id_to_piece(i) for i in range(n)]
    none = [processor.is_control(i) or processor.is_unknown(i) for i in range(n)]
    return [b"" if none[i] else bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]


class Pairs:
    """The numbers of the pairs of tokens of which one ends with the other, found by hashing."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        by_a, by_b = {}, {}
        for side, by in ((a_bytes, by_a), (b_bytes, by_b)):
            for i, token in enumerate(side):
                if token:
                    by.setdefault(token, []).append(i)
        found = set()
        for i, token in enumerate(a_bytes):
            for k in range(len(token)):
                found.update(i << 32 | j for j in by_b.get(token[k:], ()))
        for j, token in enumerate(b_bytes):
            for k in range(len(token)):
                found.update(i << 32 | j for i in by_a.get(token[k:], ()))
        #: a << 32 | b of each number, in order.
        self.keys = np.array(sorted(found), np.int64)
        self.bits = max(4, (4 * len(self.keys)).bit_length())
        self.slots, self.numbers = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        rest, at = np.arange(len(self.keys), dtype=np.int32), self._first(self.keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = self.keys[rest[free]]  # one of those that want the same place gets it
            won = self.slots[at] == self.keys[rest]
            self.numbers[at[won]] = rest[won]
            rest, at = rest[~won], (at[~won] + 1) & (1 << self.bits) - 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of pairs that are known."""
        keys = a.astype(np.int64) << 32 | b
        at = self._first(keys)
        off = np.flatnonzero(self.slots[at] != keys)
        while len(off):
            at[off] = (at[off] + 1) & (1 << self.bits) - 1
            off = off[self.slots[at[off]] != keys[off]]
        return self.numbers[at]


class Words(Recent):
    """Word -> its identifiers with a space before it, packed: A's, then B's with the highest bit set; ODD if the sides' bytes differ."""

    def __init__(self, vocabulary: bytes, model: bytes, bound: int = REMEMBERED):
        super().__init__(bound)
        token_count.Counts(model)  # raises for models whose pieces join words or change texts
        self.a = Tokenizer.from_str(vocabulary.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes, self.b_bytes = byte_tokens(vocabulary), piece_tokens(self.b)
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        self.pairs = Pairs(self.a_bytes, self.b_bytes)
        width = len(str(max(len(self.a_bytes), len(self.b_bytes))))
        #: Identifiers in decimal digits, one row each with room for a sign, and how many bytes of a row are used.
        numbers = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.decimals = np.frombuffer("".join(x.ljust(width + 1) for x in numbers).encode(), np.uint8).reshape(-1, width + 1)
        self.digits = np.array([len(x) for x in numbers], np.int8)

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of both sides of a space and the text."""
        return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.uint32), np.array(self.b.encode(text, num_threads=1), np.uint32)

    def alone(self, word: str) -> bytes:
        a, b = self.both(word)
        data = b" " + word.encode()
        same = b"".join(map(self.b_bytes.__getitem__, b)) == data == b"".join(map(self.a_bytes.__getitem__, a))
        return a.tobytes() + (b | SIDE).tobytes() if same else ODD

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Words that aren't remembered, as one text where they are plain."""
        made = {}
        plain = [w for w in new if w and SPACE not in w and not w[0].isspace() and not w[-1].isspace()]
        if plain:
            text = " ".join(plain)
            a, b = self.both(text)
            ends = np.cumsum([len(w.encode()) + 1 for w in plain])
            a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
            a_at, b_at = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
            if a_at[-1] < len(a) and b_at[-1] < len(b) and (a_ends[a_at] == ends).all() and (b_ends[b_at] == ends).all() and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == b" " + text.encode():
                a_packed, b_packed = a.tobytes(), (b | SIDE).tobytes()
                i = j = 0
                for w, x, y in zip(plain, (4 * a_at + 4).tolist(), (4 * b_at + 4).tolist()):
                    made[w] = a_packed[i:x] + b_packed[j:y]
                    i, j = x, y
        for w in new:
            if w not in made:
                made[w] = self.alone(w)
        return made

    def found(self, words: list[str]) -> list[bytes]:
        """What each of some words is encoded to."""
        got = list(map(self.get, words))
        if None in got:
            missing = [i for i, x in enumerate(got) if x is None]
            here = {w: self.older.get(w) for w in map(words.__getitem__, missing)}
            here |= self.learn({w for w, x in here.items() if x is None})
            for i in missing:
                got[i] = here[words[i]]
            for w, x in here.items():
                if len(w) <= LONGEST:
                    self.keep(w, x, ENTRY + 2 * len(w) + len(x))
        return got


def loaded(vocabulary: bytes, model: bytes) -> Words:
    key = hash((vocabulary, model))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Words(vocabulary, model)
    return _loaded[key]


def words_of(text: str) -> list[str]:
    """A text with a space in front, cut before spaces where both sides' tokens end; the spaces are left out."""
    ragged = text[:1].isspace() or RAGGED.search(text)
    words = [w[1:] for w in BEFORE_SPACE.split(" " + text)] if ragged else text.split(" ")
    if len(words) > 1 and not words[-1]:
        words[-2:] = [words[-2] + " "]
    return words


def parts(text: str, most: int = SLICE) -> Iterator[str]:
    """A text in parts of about `most` characters, cut before single spaces, which are left out."""
    at = 0
    while len(text) - at > most and (end := LONG.search(text, at + most)):
        yield text[at : end.start()]
        at = end.start() + 1
    yield text[at:]


def overlaps(a_doc: np.ndarray, a_ends: np.ndarray, a_length: np.ndarray, b_doc: np.ndarray, b_ends: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of overlapping tokens, in order of both; the documents' bytes follow one another on both sides."""
    left = pd.DataFrame({"doc": a_doc, "at": a_ends - a_length, "a": np.arange(len(a_ends))})
    right = pd.DataFrame({"doc": b_doc, "at": b_ends - b_length, "b": np.arange(len(b_ends))})
    covering = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy()
    covered = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy()
    new = left["at"].to_numpy()[covered] != right["at"].to_numpy()  # equal starts are found from both sides
    a, b = np.r_[left["a"].to_numpy(), covered[new]], np.r_[covering, right["b"].to_numpy()[new]]
    order = np.argsort(a + b, kind="stable")  # each step along both sides adds one to either place, or to both
    return a[order], b[order]


def grouped_text(words: Words, a_ids: np.ndarray, b_ids: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as bytes a1,a2|b1;a3|b2; and the end of each group in them. la, lb: places of the groups' last tokens."""
    a_in, b_in = np.diff(la, prepend=-1), np.diff(lb, prepend=-1)
    a_place = np.arange(len(a_ids)) + np.repeat(lb + 1 - b_in, a_in)
    b_place = np.arange(len(b_ids)) + np.repeat(la + 1, b_in)
    ids, sign = np.empty(len(a_ids) + len(b_ids), np.int32), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    ids[a_place], ids[b_place] = a_ids, b_ids
    sign[a_place[la]], sign[b_place[lb]] = ord("|"), ord(";")
    rows, digits = words.decimals[ids], words.digits[ids]
    rows[np.arange(len(ids)), digits] = sign
    used = np.arange(rows.shape[1], dtype=np.int8) <= digits[:, None]
    return rows[used], np.cumsum(digits + 1, dtype=np.int64)[b_place[lb]]


class Document:
    """What is known of one row so far."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.hash, self.links, self.detail, self.sound = hashlib.sha256(), [], [], True


def align_slice(words: Words, rows: list[tuple[Document, str]], detail: bool) -> None:
    """Aligns parts of documents, each with its document, and adds what is found to these."""
    cut = [words_of(text) for _, text in rows]
    got, at, sides = words.found(list(chain.from_iterable(cut))), 0, []
    for (doc, _), c in zip(rows, cut):
        packed = np.frombuffer(b"".join(got[at : at + len(c)]), np.uint32)
        at += len(c)
        is_b = packed >= SIDE
        b = packed[is_b] ^ SIDE
        doc.sound = doc.sound and ODD_ID not in b
        if doc.sound:
            sides.append((doc, packed[~is_b].astype(np.int32), b.astype(np.int32)))
    if not sides:
        return
    a_ids, b_ids = (np.concatenate([s[k] for s in sides]) for k in (1, 2))
    a_n, b_n = (np.array([len(s[k]) for s in sides]) for k in (1, 2))
    number = np.arange(len(sides))
    a_length, b_length = words.a_length[a_ids], words.b_length[b_ids]
    a_ends, b_ends = np.cumsum(a_length, dtype=np.int64), np.cumsum(b_length, dtype=np.int64)
    a, b = overlaps(np.repeat(number, a_n), a_ends, a_length, np.repeat(number, b_n), b_ends, b_length)
    equal = a_ends[a] == b_ends[b]
    la, lb = a[equal], b[equal]
    linked = words.pairs.of(a_ids[la], b_ids[lb])
    text, group_ends = grouped_text(words, a_ids, b_ids, la, lb)
    a_stop, b_stop = np.cumsum(a_n), np.cumsum(b_n)
    g_stop = np.searchsorted(la, a_stop - 1) + 1
    o_stop = np.searchsorted(a, a_stop)
    t = g = o = 0
    for k, (doc, _, _) in enumerate(sides):
        if doc.n_groups:
            doc.hash.update(b";")
        t_end = int(group_ends[g_stop[k] - 1])
        doc.hash.update(memoryview(text[t : t_end - 1]))
        doc.links.append(linked[g : g_stop[k]].tobytes())
        if detail:
            a0, b0 = int(a_stop[k] - a_n[k]), int(b_stop[k] - b_n[k])
            byte = int(a_ends[a0 - 1]) if a0 else 0
            before = doc.detail[-1]["a_ends"][-1] if doc.detail else 0
            doc.detail.append({"a_ids": a_ids[a0 : a_stop[k]], "b_ids": b_ids[b0 : b_stop[k]], "a_ends": a_ends[a0 : a_stop[k]] - byte + before, "b_ends": b_ends[b0 : b_stop[k]] - byte + before, "a": a[o : o_stop[k]] - a0 + doc.n_a, "b": b[o : o_stop[k]] - b0 + doc.n_b})
        doc.n_a, doc.n_b, doc.n_groups = doc.n_a + int(a_n[k]), doc.n_b + int(b_n[k]), doc.n_groups + int(g_stop[k] - g)
        t, g, o = t_end, int(g_stop[k]), int(o_stop[k])


def _sliced(texts: list[bytes], most: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, part of its text) of about `most` characters."""
    held, size = [], 0
    for i, data in enumerate(texts):
        if data:
            for part in parts(data.decode(), most):
                held.append((i, part))
                size += len(part)
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


DETAIL = [("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("a_ends", pa.list_(pa.int64())), ("b_ends", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]


def align(docs: DataFrame, vocabulary: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text", detail: bool = False, most: int = SLICE) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, groups_sha256, links (packed numbers of linked pairs, see `linked_pairs`).

    detail adds the tokens and their ends in bytes (a_ids, b_ids, a_ends, b_ends) and the places of the overlapping
    tokens (a, b). Null and empty texts, and texts whose bytes on either side aren't a space and the text, have no
    tokens: zeros, no links, an empty digest. A null id stays null; repeated rows are aligned each; an empty table
    gives no rows; other columns of docs aren't read. Very long texts are aligned in parts of about `most`
    characters where they have spaces. There is no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), *(DETAIL if detail else [])])
    kinds = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", a_ids array<int>, b_ids array<int>, a_ends array<long>, b_ends array<long>, a array<int>, b array<int>" * detail

    def run(batches: Batches) -> Batches:
        words = loaded(vocabulary, model)
        for b in batches:
            texts = utf8(b.column(1))
            made = [Document() for _ in texts]
            for rows in _sliced(texts, most):
                align_slice(words, [(made[i], part) for i, part in rows], detail)
            for doc in made:
                if not doc.sound:
                    doc.__init__()
            columns = [b.column(0), *(pa.array([getattr(d, c) for d in made], pa.int64()) for c in ("n_a", "n_b", "n_groups"))]
            columns += [pa.array([d.hash.hexdigest() if d.n_groups else "" for d in made], pa.string()), pa.array([b"".join(d.links) for d in made], pa.binary())]
            if detail:
                columns += [pa.array([np.concatenate([np.zeros(0, np.int64), *(x[c] for x in d.detail)]) for d in made], kind) for c, kind in DETAIL]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, kinds)


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each linked pair, counted in each task before anything is shuffled."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for b in batches:
            for links in b.column(0).to_pylist():
                if links:
                    n = np.bincount(np.frombuffer(links, np.int32), minlength=len(total))
                    n[: len(total)] += total
                    total = n
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], schema=schema)

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(aligned: DataFrame, vocabulary: bytes, model: bytes) -> DataFrame:
    """(a_id, b_id, n) of the linked identifiers, corpus-wide."""
    schema = pa.schema([("a_id", pa.int32()), ("b_id", pa.int32()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        pairs = loaded(vocabulary, model).pairs.keys
        for b in batches:
            at = pairs[b.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)), b.column(1)], schema=schema)

    return linked_pairs(aligned).mapInArrow(run, "a_id int, b_id int, n long")


def digest(docs: DataFrame, vocabulary: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs; see `align` for odd rows.

    An id pair's count is the number of links that hold it in the whole corpus; a link is best if no other pair of its
    B id has a higher count. Alignments are written once, with four bytes for each link; the counts of the pairs that can be
    linked (bounded by the vocabularies) go to the tasks that sum them up for each document.
    """
    aligned = spooled(align(docs, vocabulary, model, id_col, text_col))
    counted = linked_pairs(aligned).toPandas()  # at most a row for each pair of tokens of which one ends with the other
    count = np.zeros(int(counted["pair"].max()) + 1 if len(counted) else 0, np.int64)
    count[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(batches: Batches) -> Batches:
        b_of = loaded(vocabulary, model).pairs.keys[: len(count)] & 0xFFFFFFFF
        highest = np.zeros(int(b_of.max(initial=0)) + 1, np.int64)
        np.maximum.at(highest, b_of, count)
        best = count == highest[b_of]
        for b in batches:
            links = [np.frombuffer(x or b"", np.int32) for x in b.column("links").to_pylist()]
            sums = [pa.array([f(x) for x in links], pa.int64()) for f in (len, lambda x: int(best[x].sum()), lambda x: int(count[x].sum()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *sums, b.column("groups_sha256")], schema=schema)

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
