"""SQL functions and table functions for a session, so that a query in SQL alone can search and filter, also with LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession, chunks: str, documents: str, most: int = 50) -> None:
    """cosine_of(a, b); search_similar_chunks(query, threshold, kind): the `most` nearest rows of the view chunks (chunk_id, document_id, embedding, document_type), kind null for any;
    filter_by_temporal_validity(as_on): rows of the view documents (id, document_type, metadata as JSON) and whether they hold on that day."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION cosine_of(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN try_divide(
            aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x),
            sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * sqrt(aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION search_similar_chunks(query ARRAY<FLOAT>, threshold DOUBLE, kind STRING)
        RETURNS TABLE(chunk_id BIGINT, document_id BIGINT, similarity_score DOUBLE, document_type STRING)
        RETURN SELECT chunk_id, document_id, cosine_of(embedding, query) AS similarity_score, document_type FROM {chunks}
            WHERE cosine_of(embedding, query) > threshold AND (kind IS NULL OR document_type = kind) ORDER BY similarity_score DESC, chunk_id LIMIT {most}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION filter_by_temporal_validity(as_on DATE) RETURNS TABLE(document_id BIGINT, document_type STRING, is_valid BOOLEAN)
        RETURN SELECT id, document_type, CASE
            WHEN document_type IN ('statute', 'bns') THEN CAST(get_json_object(metadata, '$.effective_from') AS DATE) <= as_on
                AND (get_json_object(metadata, '$.effective_to') IS NULL OR CAST(get_json_object(metadata, '$.effective_to') AS DATE) > as_on)
            WHEN document_type = 'judgment' THEN CAST(get_json_object(metadata, '$.decision_date') AS DATE) <= as_on
            ELSE true END FROM {documents}""")
