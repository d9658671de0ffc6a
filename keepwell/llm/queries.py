"""The queries of this subpackage: name -> (callable, SQL for DuckDB or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm import (
    exact,
    language,
    merkle,
    mixing,
    pieces,
    secrets,
    shards,
    simhash,
    token_files,
    topk,
    urls,
    vector_codes,
    warc,
)
from keepwell.llm.store import shared_folder, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read(spark, folder, with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs)).drop("sig")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/ledger")
    spans = F.coalesce("spans", F.array().cast(secrets.SPANS))
    base = F.filter(spans, lambda x: x["kind"].isin([r.kind for r in secrets.BASE_RULES]))

    def count(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(spans).alias("spans"), "blob")


def op5_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


_OP6 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
  k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


#: Fixed values.
URL_RULES = """VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules (host, path, action)"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {URL_RULES}")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


_OP7 = rf"""
WITH rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r (host, path, action)),
  s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
  f AS (SELECT p.page_id, r.host || r.path AS rule, action,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
    FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND k = 1
"""


#: Wanted shares of the tokens.
TARGETS = {"good": 0.93, "poor": 0.05, "toxic": 0.02}


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.document_rates(table(spark, sf_dir, "documents"),
                                  mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)
    return rates.select("doc_id", "tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}")
                                              for k, d in enumerate(TARGETS)], "rate")


#: A tenth of the merges is dropped.
DROPOUT_SEED = 17


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    back = pieces.encode(docs, model, seed=DROPOUT_SEED, back=True)
    return back.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"),
                       F.xxhash64("pieces").alias("pieces_hash"),
                       F.length("decoded").cast("long").alias("n_chars"),
                       F.sha2("decoded", 256).alias("text_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Bytes of text in a shard at most.
SHARD_BYTES = 64 << 20


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/shards"
    shards.write(table(spark, sf_dir, "documents"), path, SHARD_BYTES)
    rows = spark.read.parquet(path).select(
        "doc_id", F.col("shard").substr(F.lit(2), F.length("shard")).alias("shard"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + shards.ROW).cast("long").alias("n_bytes"))
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(sizes, "shard").select("doc_id", "shard", "n_bytes", "shard_bytes", "shard_rows")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", urls.UPPER, urls.LOWER)
    made = merkle.manifest(table(spark, sf_dir, "documents"), changes={"text": lowered},
                           where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, copies=False)
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _merkle_sql(levels: int, top_levels: int) -> str:
    """The SQL of op11 for at most 8 ** levels rows of a language and 8 ** top_levels languages."""
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    plain = " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", "text"))
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT for d in string_split(doc_id::VARCHAR, '')]), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)")
    out = [f"""WITH d AS (SELECT doc_id, lang, sha256({plain}) AS leaf, {crc} % 3 = 0 AS hit,
    sha256({plain.replace(field("text"), field(f"translate(text, '{urls.UPPER}', '{urls.LOWER}')"))}) AS low FROM documents),
  v0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    CASE WHEN hit THEN low ELSE leaf END AS fold, '' AS proof FROM d),
  n0 AS MATERIALIZED (SELECT lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM v0)"""]

    def rise(rows: str, nodes: str, k: int, tree: str) -> None:
        key = f"b.{tree} IS NOT DISTINCT FROM r.{tree}" if tree else "true"
        tree_, by = (f"{tree}, ", f"{tree}, pos // 8, n") if tree else ("", "pos // 8, n")
        out.append(f"""  r_{nodes}{k} AS (SELECT {tree_}pos // 8 AS pos, n, list(h ORDER BY pos) AS hs FROM {nodes}{k} GROUP BY {by}),
  {nodes}{k + 1} AS MATERIALIZED (SELECT {tree_}pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h,
    (n + 7) // 8 AS n FROM r_{nodes}{k}),
  {rows}{k + 1} AS MATERIALIZED (SELECT b.* EXCLUDE (pos, fold, proof), b.pos // 8 AS pos,
    CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string(hs[:b.pos % 8], '') || fold || array_to_string(hs[b.pos % 8 + 2:], ''))
    END AS fold, CASE WHEN n = 1 THEN proof
    ELSE proof || array_to_string(hs[:b.pos % 8], '') || array_to_string(hs[b.pos % 8 + 2:], '') END AS proof
    FROM {rows}{k} b JOIN r_{nodes}{k} r ON {key} AND r.pos = b.pos // 8)""")

    for k in range(levels):
        rise("v", "n", k, "lang")
    out.append(f"""  m0 AS MATERIALIZED (SELECT lang, h AS subroot, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n FROM n{levels}),
  w0 AS MATERIALIZED (SELECT v.* EXCLUDE (pos), m0.pos, subroot FROM v{levels} v JOIN m0 ON v.lang IS NOT DISTINCT FROM m0.lang)""")
    for k in range(top_levels):
        rise("w", "m", k, "")
    end = f"""
SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = m.h AS verified
FROM w{top_levels} JOIN m{top_levels} m ON true"""
    return ",\n".join(out) + end


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.assemble(warc.records(spark, path, with_payload=False)))


_OP12 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def _vector_code_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES,
                     rounds: int = vector_codes.ROUNDS) -> str:
    out = [f"""WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS no,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS MATERIALIZED (SELECT vec_id, label, no, part,
    e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] AS e FROM v, range({parts}) AS r (part)),
  b0 AS MATERIALIZED (SELECT part, no - 1 AS entry, e FROM x WHERE no <= {entries})"""]
    for k in range(rounds + 1):
        out.append(f"""  a{k} AS MATERIALIZED (SELECT x.no, x.part, min((list_sum(list_transform(list_zip(x.e, b.e),
      lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry)) AS best FROM x JOIN b{k} b ON x.part = b.part
    GROUP BY x.no, x.part)""")
        if k < rounds:
            out.append(f"""  c{k} AS (SELECT a.part, a.best[2] AS entry, i, floor(sum(x.e[i])::DECIMAL(38, 0) / count(*))::BIGINT AS m
    FROM a{k} a JOIN x ON a.no = x.no AND a.part = x.part, range(1, len(x.e) + 1) AS d (i) GROUP BY ALL),
  b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(c.e, b.e) AS e FROM b{k} b LEFT JOIN
    (SELECT part, entry, list(m ORDER BY i) AS e FROM c{k} GROUP BY ALL) c ON b.part = c.part AND b.entry = c.entry)""")
    end = f"""  o AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
    FROM a{rounds} a JOIN v ON a.no = v.no GROUP BY v.no, v.vec_id, v.label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM o"""
    return ",\n".join([*out, end])


QUERIES = {
    "op1_token_files": (op1_token_files, None),
    "op2_language_id": (op2_language_id, None),
    "op3_merge_dropout": (op3_merge_dropout, None),
    "op4_secret_scan": (op4_secret_scan, None),
    "op5_simhash_links": (op5_simhash_links, None),
    "op6_exact_dedup": (op6_exact_dedup, _OP6),
    "op7_url_filter": (op7_url_filter, _OP7),
    "op8_soft_mixing": (op8_soft_mixing, None),
    "op9_topk_search": (op9_topk_search, _OP9),
    "op10_extendible_shards": (op10_extendible_shards, None),
    "op11_merkle_manifest": (op11_merkle_manifest, _merkle_sql(7, 2)),
    "op12_warc_captures": (op12_warc_captures, _OP12),
    "op13_vector_codes": (op13_vector_codes, _vector_code_sql()),
}
