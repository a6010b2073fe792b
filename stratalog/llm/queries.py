"""The opN queries: each applies its operator to a whole table and derives the
digest columns of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.llm import brown, embed_dedup, html, packing, pii, secrets, simhash, spm, topk, toxicity
from stratalog.llm.common import read


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir):
    out = spm.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model_path())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.col("ids_exact").alias("round_trip"))


def op2_topk(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op3_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_embedding(spark, sf_dir):
    out = embed_dedup.embedding_links(read(spark, sf_dir, "embeddings"), cosine=0.95)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def low_quality_and_toxic(labels):
    """The chain's categories in the table ``labels``: it names one toxicity
    category; low quality is the link before it."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ["low_quality", "toxic"]


def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, low_quality_and_toxic(read(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op6_secrets(spark, sf_dir):
    out = secrets.scan(read(spark, sf_dir, "documents"), vocabulary=tokenizer_path())
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", F.array_max(F.transform("values", lambda v: v.cost)).alias("highest_cost"))


def op7_html(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


def op8_pii(spark, sf_dir):
    return pii.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), count_col="n_entities")


def op9_brown(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    scored, model, _ = brown.fit_and_score(docs, held_out)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), end=2, limit=1024)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_simhash, op4_embedding, op5_toxicity, op6_secrets, op7_html, op8_pii, op9_brown, op10_packing)}


#: Vectors that take part: no null or non-finite component.
_ABLE = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding IF x IS NULL OR NOT isfinite(x)]) = 0"

ORACLES = {
    "op2_topk": f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x) for x in CAST(embedding AS DOUBLE[])] AS x FROM embeddings WHERE {_ABLE}),
 s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
 n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
 SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20""",
    "op4_embedding": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {_ABLE} AND len(embedding) > 0 AND len([x for x in embedding IF x <> 0]) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
 SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c = e.vec_id, true) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id""",
}


def oracle_sql() -> dict:
    return dict(ORACLES)
