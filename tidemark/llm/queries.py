"""The numbered queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from . import divergence, jaccard, language, licenses, mixing, packing, quality, resampling, sharding, sql, tokens, vectors, warc
from .common import table


def op1_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding")


def op4_embedding_near_dedup(spark, sf_dir):
    return vectors.link(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op5_warc(spark, sf_dir):
    r = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    p = language.predict(docs.drop("lang"), model)
    return p.select("doc_id", language.held_out(p["doc_id"]).alias("held_out"), "lang_pred", "score")


def op7_mix_sources(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_jaccard(spark, sf_dir):
    j = jaccard.join(table(spark, sf_dir, "documents"))
    return j.select("doc_id", "class_id", "n_links", "component_id", "kept")


def op9_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "lang"])


def op10_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hash_tree_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_warc": op5_warc,
        "op6_language_id": op6_language_id,
        "op7_mix_sources": op7_mix_sources,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_quality": op9_quality,
        "op10_token_counts": op10_token_counts,
        "op11_source_divergence": op11_source_divergence,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_hash_tree_sharding": op13_hash_tree_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": sql.licenses_sql(),
        "op4_embedding_near_dedup": sql.EMBEDDINGS,
        "op5_warc": sql.PAGES,
        "op8_ngram_jaccard": sql.JACCARD,
        "op11_source_divergence": sql.DIVERGENCE,
        "op12_importance_resampling": sql.RESAMPLING,
        "op13_hash_tree_sharding": sql.sharding_sql(),
    }
