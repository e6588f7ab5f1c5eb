"""Personal data: four base patterns, and a bootstrapped contextual extraction that finds unseen identifiers.

Base entities are the seeds, and so are secrets of a sure form (long runs of hexadecimal digits), which are added spans
of a kind of their own. Each induces lexical patterns: what stands before it (one word, two words) and after
it. Other identifier-like words (with a digit) that occur in the same patterns are candidate instances. Spark scores
the pattern-instance graph in rounds: a pattern's confidence is the mean score of its instances, an instance's score
is one minus the product of (1 - confidence) over its patterns, both for each kind of seed; seeds score one. Candidates
that trusted patterns support in the end are spans of that kind, added to the base spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textops import Batches, free_name, sliced, utf8

#: The contract's kinds in order, and their patterns, written so that no character is a start twice.
BASE_KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What the method adds to the kinds: seeds of 32 hexadecimal digits or more, with letters and digits.
KINDS = [*BASE_KINDS, "secret"]
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")

DIGIT_WORD = re.compile(r"(?<!\S)(?=[^\s0-9]*+[0-9])\S+")
WORD = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>|*#%&$="
#: Longer words and instances are known by their hash.
NAMED = 64
#: Discovered instances that are sent to the tasks, at most (65 characters each); more are joined.
SENT = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses: each @ with the longest local part that begins after the last address, and a domain.

    A local part holds no @, and whether a domain follows doesn't depend on where it begins.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS), leftmost non-overlapping within a kind; failing matches are dropped."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SECRET.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]


def _named(value: str) -> str:
    """A value, or its hash if it is long."""
    return value if len(value) <= NAMED else "#" + sha256(value.encode()).hexdigest()


def _norm(word: str) -> str:
    return _named(word.strip(EDGE).lower())


class Words:
    """The words of a text, for the neighbours of its spans."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in found], [e for _, e in found]

    def around(self, start: int, end: int) -> tuple[str, str, str]:
        """One word before, two words before (of the last four tokens), one token after; empty where there is none."""
        k = bisect_left(self.starts, start)
        left = [self.text[self.starts[i] : min(self.ends[i], start)] for i in range(max(0, k - 4), k)]
        words = [w for w in map(_norm, left) if w][-2:]
        k = bisect_right(self.ends, end)
        after = _norm(self.text[max(self.starts[k], end) : self.ends[k]]) if k < len(self.ends) else ""
        return (words[-1] if words else "", " ".join(words) if len(words) == 2 else "", after)


def candidates(text: str, spans: list[tuple[int, int, int]], least: int = 5) -> list[tuple[int, int]]:
    """Identifier-like words outside the base spans: with a digit, `least` characters or more after trimming."""
    out, k = [], 0
    ordered = sorted(spans)
    for m in DIGIT_WORD.finditer(text):
        s, e = m.span()
        word = m[0]
        s += len(word) - len(word.lstrip(EDGE))
        e -= len(word) - len(word.rstrip(EDGE))
        while k < len(ordered) and ordered[k][1] <= s:
            k += 1
        if e - s >= least and not any(a < e and s < b for a, b, _ in ordered[max(0, k - 3) : k + 4]):
            out.append((s, e))
    return out


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the base spans and secrets."""
    return base_spans(text) + [(s, e, len(BASE_KINDS)) for s, e in secrets(text)] if re.search("[0-9@]", text) else []


OCCURRENCE = "doc_id long, row long, key long, start int, end int, kind int, instance string, before1 string, before2 string, after string"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base entities (kind >= 0), candidates (kind -1) and one row for each document (kind null), with their contexts."""
    text_type = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), *[(n, text_type) for n in ("instance", "before1", "before2", "after")]])

    def run(batches: Batches) -> Batches:
        for b in sliced(batches):
            rows = []
            for doc, row, key, raw in zip(*(b.column(i).to_pylist() for i in range(3)), utf8(b.column(3))):
                rows.append((doc, row, key, None, None, None, None, None, None, None))
                text = raw.decode()
                spans = known_spans(text)
                marks = spans + [(s, e, -1) for s, e in candidates(text, spans)]
                words = Words(text) if marks else None
                for s, e, kind in marks:
                    rows.append((doc, row, None, s, e, kind, _named(text[s:e].lower()), *words.around(s, e)))
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, OCCURRENCE)


def trusted(found: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """(kind, pattern, instance, score): the candidate instances that trusted patterns support, with the best kind.

    A pattern is trusted if its confidence is high enough and it holds `support` different seeds of the kind. The rounds
    end where no candidate has a score, since all others would be the same.
    """
    side = F.explode(F.array(F.struct(F.lit("1").alias("s"), F.col("before1").alias("w")), F.struct(F.lit("2").alias("s"), F.col("before2").alias("w")), F.struct(F.lit("3").alias("s"), F.col("after").alias("w")))).alias("p")
    edges = cut(
        found.where("kind is not null")
        .select("kind", "instance", side)
        .where("p.w <> ''")
        .groupBy("kind", "instance", F.concat("p.s", F.lit(":"), "p.w").alias("pattern"))
        .agg(F.count("*").alias("n"))
    )
    seeds, others = edges.where("kind >= 0"), edges.where("kind = -1").select("instance", "pattern")
    # what can be discovered stands in a pattern of enough seeds: the rest of the graph is left out exactly
    seeded = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    sizes = edges.select("pattern", F.when(F.col("kind") >= 0, F.col("kind")).alias("own"), "instance").groupBy("pattern").agg(F.count("*").alias("instances"))
    patterns = cut(seeded.join(sizes, "pattern"))
    graph = cut(others.join(patterns, "pattern"))
    score = None
    for _ in range(rounds):
        if score is None:
            conf = patterns.select("pattern", "kind", (F.col("seeds") / F.col("instances")).alias("confidence"))
        else:
            gained = graph.join(score, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            conf = patterns.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("instances")).alias("confidence"))
        conf = conf.where(F.col("confidence") >= confidence / 2)
        score = cut(
            graph.join(conf, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("score"), F.max("confidence").alias("best"))
        )
        if score.isEmpty():
            break
    return score.where(F.col("best") >= confidence).groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("found"), F.max("score").alias("score"))


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """doc_id, key (the text's hash), spans array<struct<start, end, kind, base>> in code points for each row of docs, in order.

    Null and empty texts have no spans; a null id stays null; repeated rows are searched each, but count as one
    occurrence of an instance in a pattern; texts of any length are searched whole, in linear time; an empty table
    gives no rows; other columns aren't read. A discovered span overlaps no base span or secret; a secret may hold a base span.
    """
    found = cut(occurrences(docs, id_col, text_col))
    more = trusted(found, rounds, support, confidence).select("instance", "found")
    added = found.where("kind = -1").join(more, "instance").select("row", F.struct("start", F.col("found").alias("kind"), "end", F.lit(False).alias("base")).alias("span"))
    base = found.where("kind >= 0").select("row", F.struct("start", "kind", "end", (F.col("kind") < len(BASE_KINDS)).alias("base")).alias("span"))
    spans = base.unionByName(added).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    rows = found.where("kind is null").select("doc_id", "row", "key")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")
    return rows.join(spans, "row", "left").select("doc_id", "key", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of personal_data."""
    base = F.filter("spans", lambda x: x["base"])

    def number(kind: int) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.exists("spans", lambda x: ~x["base"]).alias("has_added"))


def hidden(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each of the spans (start, kind, end), in order, replaced by its kind; overlapping ones become one."""
    parts, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(parts) + text[at:] if parts else text


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT, **settings) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; overlapping spans become one; columns as given.

    Discovered instances, if they are `sent` at most, go to the tasks, which find a text's spans where they read it: texts
    aren't shuffled. More instances are joined by shuffles. Both ways give the same texts.
    Null and empty texts stay as they are, rows of a null id and repeated rows are treated each, and an empty table gives
    no rows. No rows are lost.
    """
    more = trusted(occurrences(docs, id_col, text_col), **settings).select("instance", "found")
    few = more.limit(sent + 1).collect()
    if len(few) > sent:
        return _redacted_by_joins(docs, id_col, text_col, settings)
    kinds = {r["instance"]: r["found"] for r in few}

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is not None:
                spans = known_spans(text)
                added = [(s, e, kinds.get(_named(text[s:e].lower()))) for s, e in candidates(text, spans)] if kinds else []
                text = hidden(text, sorted((s, k, e) for s, e, k in spans + added if k is not None))
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.select(*[replaced(F.col(c).cast("string")).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _redacted_by_joins(docs: DataFrame, id_col: str, text_col: str, settings: dict) -> DataFrame:
    """As redact, for any number of discovered instances: spans are joined to the texts."""
    found = personal_data(docs, id_col, text_col, **settings).where(F.size("spans") > 0)
    own_id, own_key, own_spans = (free_name(docs.columns, c) for c in ("id", "key", "spans"))
    spans = found.groupBy(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).agg(F.first("spans").alias(own_spans))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        marks = ([(m["start"], m["kind"], m["end"]) for m in x] if x is not None else [] for x in spans)
        return pd.Series([hidden(t, x) for t, x in zip(texts, marks)], dtype=object)

    text = F.col(text_col)
    marked = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(text.cast("string")).eqNullSafe(F.col(own_key)), "left")
    return marked.select(*[F.when(F.col(own_spans).isNull(), text).otherwise(replaced(text, own_spans)).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
