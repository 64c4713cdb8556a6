"""The operators of this subpackage as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bequest.session import fresh_folder

from . import pii
from .alignment import alignment
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .html_text import visible_text
from .line_dedup import drop_recurring_lines
from .ngram_join import jaccard_components
from .packing import best_fit_packing, clustered
from .prefix_trie import paths, prefix_trie, shared_starts, turn_digests
from .secrets import secrets
from .substring_dedup import remove_repeated_passages
from .token_files import read_token_files, write_token_files
from .toxicity import fit, held_out, scored


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, 0.7).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"), window=13)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).drop("found")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing(clustered(table(spark, sf_dir, "documents")), 2048)
    return packed.withColumnRenamed("id", "doc_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_text(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_folder(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer, end=2, folder=folder)
    return read_token_files(spark, folder)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment(table(spark, sf_dir, "documents"), a, b)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_digests(table(spark, sf_dir, "conversations"))
    return prefix_trie(paths(shared_starts(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontaminate,
        op3_substring_dedup,
        op4_secrets,
        op5_line_dedup,
        op6_best_fit_packing,
        op7_personal_data,
        op8_html_text,
        op9_ngram_jaccard_join,
        op10_exact_dedup,
        op11_token_files,
        op12_tokenizer_alignment,
        op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH cut AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS words
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM cut)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
            FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS holder FROM windows)
            WHERE holder < doc_id
        ), words AS (
            SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM cut
        ), marked AS (
            SELECT w.*, g.place IS NOT NULL AS lost
            FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place
        ), counted AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (lost) AS n_removed,
                   string_agg(word, ' ' ORDER BY place) FILTER (NOT lost) AS kept
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
    """,
    "op10_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM normal
        WINDOW same AS (PARTITION BY t)
    """,
    "op13_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS path,
                   list_reduce(
                       [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                       lambda crc, byte: list_reduce(
                           [xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                           lambda x, i: xor(x >> 1, (x & 1) * 3988292384)
                       )
                   ) AS crc
            FROM turns GROUP BY conv_id
        ), rebuilt AS (
            SELECT o.conv_id, xor(o.crc, 4294967295) % 4 AS h,
                   CASE WHEN h = 0 OR o.conv_id % 20 = 0 THEN o.path
                        ELSE coalesce(l.path, [])[1:h] || o.path[h + 1:] END AS path
            FROM own o LEFT JOIN own l ON l.conv_id = o.conv_id - o.conv_id % 20
        ), prefixes AS (
            SELECT conv_id, depth, path[1:depth] AS prefix, len(path) = depth AS ends
            FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt)
        ), nodes AS (
            SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   (count(*) - 1) * coalesce(len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')), 0) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM prefixes GROUP BY prefix, depth
        ), kids AS (
            SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), below AS (
            SELECT prefix[1:d] AS prefix, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT n.prefix, saved, n_children, unnest(range(0, depth + 1)) AS d
                  FROM nodes n LEFT JOIN kids k ON n.prefix = k.prefix)
            GROUP BY ALL
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON n.prefix = b.prefix LEFT JOIN kids k ON n.prefix = k.prefix
        LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
    """,
}
