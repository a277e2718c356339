"""The queries opN_<name>, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, kneser_ney, langid, lexical, licenses, packing, pii, quality, secrets, simhash, spelling, warc
from .common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's vocabulary on this machine; every worker has the same."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of every document and whether it is kept."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of every document with its sequence and place."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op1_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per place in a document that a license template covers."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts, a digest, and all spans."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from its archive."""
    return warc.read_records(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op3_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and number of links."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts, a digest, and all spans."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores under the model of the training documents."""
    return kneser_ney.lm_scores(table(spark, sf_dir, "documents"))


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_wildcard_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents' vocabulary with its near words, form and root."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_patience_licenses": op1_patience_licenses,
    "op2_crf_language": op2_crf_language,
    "op3_bayes_jaccard_join": op3_bayes_jaccard_join,
    "op4_crf_secrets": op4_crf_secrets,
    "op5_weak_supervision_pii": op5_weak_supervision_pii,
    "op7_qgram_decontamination": op7_qgram_decontamination,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_warc_index": op9_warc_index,
    "op10_residual_packing": op10_residual_packing,
    "op6_compression_bands": op6_compression_bands,
    "op11_bit_sliced_search": op11_bit_sliced_search,
    "op12_wildcard_spelling": op12_wildcard_spelling,
    "op13_tiled_simhash": op13_tiled_simhash,
}

ORACLE: dict[str, str] = {
    # Five hexadecimal digits are four letters of base 32.
    "op9_warc_index": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS sha FROM pages
        ), f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
        SELECT page_id, n::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    ((('0x' || substr(sha, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM p JOIN f USING (sha)
    """,
    "op11_bit_sliced_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents WHERE text IS NOT NULL
        ), total AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
        tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), scored AS (
            SELECT item_id, r, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * docs) // words))))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r) CROSS JOIN total GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM scored JOIN d USING (r) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
    """,
    # crc32 byte by byte with the table of its polynomial; near words as pairs, which the operator never lists.
    "op12_wildcard_spelling": """
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bytes
        ), runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
            ) WHERE length(run) >= 7 GROUP BY ALL
        ), coded AS (
            SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs
        ), hashed AS (
            SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded CROSS JOIN crc
        ), v AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
            ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), places AS (SELECT word, unnest(range(length(word))) AS i FROM v),
        opened AS (SELECT word, left(word, i) || '*' || substr(word, i + 2) AS key FROM places),
        deleted AS (SELECT DISTINCT word, left(word, i) || substr(word, i + 2) AS key FROM places),
        near AS (
            SELECT a.word, b.word AS other FROM opened a JOIN opened b USING (key) WHERE a.word <> b.word
            UNION SELECT d.word, v.word FROM deleted d JOIN v ON d.key = v.word
            UNION SELECT v.word, d.word FROM deleted d JOIN v ON d.key = v.word
        ), ordered AS (
            SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS place
            FROM near JOIN v ON near.other = v.word
        ), formed AS (
            SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
            FROM v LEFT JOIN ordered o ON o.word = v.word AND o.place = 1
        ), ways AS (
            SELECT word, word AS root FROM formed
            UNION ALL SELECT ways.word, f.form FROM ways JOIN formed f ON f.word = ways.root WHERE f.form IS NOT NULL
        ), ends AS (SELECT ways.word, root FROM ways JOIN formed f ON f.word = ways.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
    """,
}
