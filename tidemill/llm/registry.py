"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.collocations import collocations
from tidemill.llm.concat_cut import concatenate_and_cut
from tidemill.llm.entropy_mix import entropy_mix, source_key, weighted_targets, words
from tidemill.llm.html_content import main_text
from tidemill.llm.jaccard_join import near_duplicates
from tidemill.llm.kneser_ney import STATS, quality
from tidemill.llm.license_rules import license_scan, scan_sql
from tidemill.llm.linear_packing import linear_packing
from tidemill.llm.pii_votes import BASE, listed, pii_spans
from tidemill.llm.stages import staged
from tidemill.llm.threshold_topk import exact_topk
from tidemill.llm.url_templates import judged_urls
from tidemill.llm.warc_chunks import chunked, read_archives, write_archives
from tidemill.llm.whitening import whiten
from tidemill.registry.query import Query
from tidemill.session import workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(_table(spark, folder, "documents"))
    return found.toDF("doc_id", "n_shingles", "component_id")


def topk(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_topk(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.toDF("query_id", "rank", "vec_id", "score")


def urls(spark: SparkSession, folder: str) -> DataFrame:
    """Labels are those of the document that a page shows, whose id ends its path."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    shown = F.expr(r"try_cast(regexp_extract(split(url, '[?#]', 2)[0], '/([0-9]+)(?:[.][a-z]+)?/?$', 1) as bigint)")
    labels = _table(spark, folder, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.withColumn("shown", shown).join(labels.withColumnRenamed("doc_id", "shown"), "shown", "left")
    judged = judged_urls(labelled, bad_column="bad")
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(_table(spark, folder, "documents").select("doc_id", "text"))


def html(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(_table(spark, folder, "pages")).toDF("page_id", "url", "text", "n_chars")


def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality(_table(spark, folder, "documents").select("doc_id", "lang", "text"), keep_text=False)
    return judged.select("doc_id", *STATS, "base_failed", "kept", "log_perplexity", "lowest", "highest")


def mix(spark: SparkSession, folder: str) -> DataFrame:
    sized = staged(
        _table(spark, folder, "documents").select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sized"
    )
    key = source_key(F.col("source")).alias("key")
    targets = staged(weighted_targets(sized.groupBy(key).agg(F.sum("size").alias("words"))), "mix-targets")
    mixed = entropy_mix(sized, targets).select("*", key).join(targets, "key", "left")
    taken = F.col("copies") * F.col("size")
    return mixed.select("doc_id", "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "source", "rate", "copies")


def packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = linear_packing(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.toDF("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_spans(_table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def warc(spark: SparkSession, folder: str) -> DataFrame:
    path = workspace(spark, "warc")
    write_archives(chunked(_table(spark, folder, "pages")), path)
    return read_archives(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"
    )


def whitened(spark: SparkSession, folder: str) -> DataFrame:
    """A deviation that does not fit a long is NULL."""
    found = whiten(_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)")).withColumnRenamed("id", "vec_id")


def concatenated(spark: SparkSession, folder: str) -> DataFrame:
    cut = concatenate_and_cut(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return cut.toDF("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


QUERIES = {
    "op1_threshold_topk": Query(
        topk,
        """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5
        """,
    ),
    "op2_url_templates": Query(urls),
    "op3_html_content": Query(html),
    "op4_kneser_ney": Query(perplexity),
    "op5_entropy_mix": Query(mix),
    "op6_linear_packing": Query(packing),
    "op7_pii_votes": Query(pii),
    "op8_jaccard_join": Query(jaccard_join),
    "op9_license_rules": Query(licenses, scan_sql()),
    "op10_warc": Query(
        warc,
        """
        WITH rows AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages
        ), firsts AS (
            SELECT digest, min(page_id) AS first FROM rows WHERE octet_length(payload) >= 100 GROUP BY digest HAVING count(*) > 1
        )
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
            CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM rows LEFT JOIN firsts USING (digest)
        """,
    ),
    "op11_chebyshev_whitening": Query(whitened),
    "op12_concat_cut": Query(concatenated),
    "op13_collocations": Query(
        phrases,
        r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL
        ), words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS ws FROM pieces
        ), totals AS (
            SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang
        ), grams AS (
            SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
            FROM words, (VALUES (1), (2), (3), (4)) AS sizes(size)
        ), found AS (
            SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
        ), cuts AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM found WHERE size >= 2
        ), cut_scores AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
            FROM cuts c
            JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
            JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
        ), scored AS (
            SELECT lang, phrase, a, l, r, score FROM cut_scores
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), spans AS (
            SELECT lang, f, string_split(phrase, ' ') AS ws, size, unnest(range(1, size)) AS i FROM found WHERE size > 2
        ), inside AS (
            SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(f) AS outer_f
            FROM (SELECT lang, f, ws, size, i, unnest(range(i + 1, size + 1)) AS j FROM spans) WHERE j - i + 1 < size GROUP BY ALL
        ), kept AS (
            SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE i.outer_f IS NULL OR 100 * i.outer_f < 80 * s.a
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
        """,
    ),
    "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
