"""One query for each corpus operator, over its whole table, and the SQL twins that exist."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir, table
from . import alignment, automaton, bpe, codes, decontam, pii, pivots, simhash, suffix_merge, textops, token_count, toxicity, url_rules, warc


#: The listed rules of the contract.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    mined = url_rules.mine(pages.select("page_id", "url").join(bad, "page_id"))
    return url_rules.judge(pages, HOST_RULES, cut(mined))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = textops.vocabulary_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.token_counts(table(spark, sf_dir, "documents"), model)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.removed(table(spark, sf_dir, "documents"), digest=True)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit(docs, labels, ["low_quality", "toxic"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.removed(table(spark, sf_dir, "documents"), digest=True)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = textops.vocabulary_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary, ids=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, model = (textops.vocabulary_bytes(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.digest(table(spark, sf_dir, "documents"), vocabulary, model)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_simhash": op10_simhash,
    "op11_warc_writer": op11_warc_writer,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}

def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and integer means, one after the other."""
    assign = "SELECT row, part, p, min({{'d': list_dot_product(p, p) - 2 * list_dot_product(p, e) + list_dot_product(e, e), 'entry': entry}}) AS b FROM parts JOIN e{0} USING (part) GROUP BY ALL"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS ({assign.format(r)})")
        steps.append(f"m{r} AS (SELECT part, entry, list(x ORDER BY i) AS e FROM (SELECT part, b.entry AS entry, i, floor(sum(p[i]) / count(*)) AS x FROM a{r}, unnest(range(1, len(p) + 1)) AS t(i) GROUP BY ALL) GROUP BY ALL)")
        steps.append(f"e{r + 1} AS (SELECT part, entry, coalesce(m{r}.e, e{r}.e) AS e FROM e{r} LEFT JOIN m{r} USING (part, entry))")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS (SELECT row, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS p FROM v, unnest(range(0, {parts})) AS t(part)),
  e0 AS (SELECT part, row AS entry, p AS e FROM parts WHERE row < {entries}),
  {", ".join(steps)},
  z AS ({assign.format(rounds)}),
  c AS (SELECT row, string_agg(lower(printf('%02X', b.entry)), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM z GROUP BY row),
  h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, i, e[i] AS x FROM e{rounds}, unnest(range(1, len(e) + 1)) AS t(i)))
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN v USING (row), h"""


#: Exact twins in SQL. The others hash, merge or learn in ways that SQL lacks; their tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, greatest(len(w) - 48, 1))) AS t(i)),
  gone AS (SELECT a.doc_id, a.i FROM win AS a JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) AS b USING (h) WHERE first < a.doc_id),
  cut AS (SELECT DISTINCT doc_id, i + d AS i FROM gone, unnest(range(0, 50)) AS t(d)),
  marks AS (SELECT doc_id, list(i) AS c FROM cut GROUP BY doc_id),
  kept AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM cut) GROUP BY doc_id)
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(c), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op11_warc_writer": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
  r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p)
  SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to FROM r""",
    "op13_vector_codes": _codes_sql(),
}
