"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm._common import table
from tracewright.llm.best_fit_packing import pack_documents
from tracewright.llm.embedding_whitening import whiten
from tracewright.llm.exact_dedup import exact_dedup
from tracewright.llm.language_id import language_id
from tracewright.llm.license_scan import license_scan
from tracewright.llm.license_scan import oracle as license_oracle
from tracewright.llm.line_dedup import line_dedup_report
from tracewright.llm.ngram_jaccard_join import ngram_jaccard_join
from tracewright.llm.quality_classifier import classify_quality
from tracewright.llm.secret_scan import scan_secrets
from tracewright.llm.sentencepiece_codec import sentencepiece_digests
from tracewright.llm.topk_search import topk_search
from tracewright.llm.url_filter import filter_urls, repeated_addresses, rules_frame
from tracewright.llm.url_filter import oracle as url_oracle
from tracewright.llm.vector_codes import compress_vectors
from tracewright.llm.vector_codes import oracle as codes_oracle


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the addresses that several pages share; all but their first page are blocked where no rule speaks."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, rules_frame(spark), repeated_addresses(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_language_id,
        op4_exact_dedup,
        op5_secret_scan,
        op6_license_scan,
        op7_quality_classifier,
        op8_sentencepiece_codec,
        op9_line_dedup,
        op10_topk_search,
        op11_embedding_whitening,
        op12_vector_codes,
        op13_url_filter,
    )
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
        FROM d WINDOW w AS (PARTITION BY s)""",
    "op6_license_scan": license_oracle(),
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        b AS (SELECT line, min({'d': doc_id, 'i': i}) AS first FROM l WHERE trim(line) <> ''
              GROUP BY line HAVING count(DISTINCT site) >= 10),
        f AS (SELECT l.doc_id, l.i, l.line, b.line IS NOT NULL AND {'d': l.doc_id, 'i': l.i} <> b.first AS gone
              FROM l LEFT JOIN b ON l.line = b.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_sha256
        FROM f GROUP BY doc_id""",
    "op10_topk_search": """
        WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_vector_codes": codes_oracle(),
    "op13_url_filter": url_oracle(),
}
