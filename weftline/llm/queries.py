"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, html_main, langid, lattice_lm, lexical, ngram_join, pii, quality, quality_model, spm, substring, warc, whitening
from weftline.llm.shared import crc32_of, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as compressed archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, failure bits and verdict under policy v1."""
    base = F.lit(quality.POLICIES["base"].mask)
    return quality.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id",
        *quality.MEASURES[:5],
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"),
        quality.passes("v1").alias("kept"),
        "n_lines",
        "n_upper",
        "fail_bits",
    )


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g,
             unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_upper > 30 * word_chars THEN 32 ELSE 0 END
             + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 63) = 0 AS kept, n_lines, n_upper, fail_bits FROM b
"""



def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's marginal log probability, learned from the documents whose crc32 mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return lattice_lm.scored(docs, F.pmod(crc32_of("doc_id"), F.lit(7)) == 2, keep=["doc_id"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents whose crc32 mod 3 is not 1."""
    docs, fold = table(spark, sf_dir, "documents"), F.pmod(crc32_of("doc_id"), F.lit(3)) == 1
    learned = langid.learn(docs.where(~fold))
    held = F.coalesce(fold, F.lit(False)).alias("held_out")
    return langid.predict(docs, learned, keep=[F.col("doc_id"), held])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links at a Jaccard similarity of 0.8 over five-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data."""
    found = pii.personal(table(spark, sf_dir, "documents"), carry=["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id",
        *[n(kind) for kind in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "other")).alias("spans"),
        F.size("other").cast("long").alias("n_other"),
    )


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_main.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its passages of 20 words or more that also start earlier."""
    return substring.without_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g
      FROM w WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT i + d) AS gone FROM later, (SELECT unnest(range(20)) AS d) GROUP BY doc_id),
k AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM k
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text."""
    return spm.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], checked=True).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "intact")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's 50 best documents."""
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


_TERMS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT doc_id, term, tf, 50 + ((50 * n * nd) // nt) AS m FROM p, s),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN f ON q.term = f.term JOIN m ON q.term = m.term GROUP BY 1, 2),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance of good quality, learned from the labels of documents whose crc32 mod 3 is not 1."""
    held = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(3)) == 1, F.lit(False)).alias("held_out")
    measured = quality_model.statistics(table(spark, sf_dir, "documents"), keep=["doc_id", held])
    learned = quality_model.fit(measured.where(~F.col("row.held_out")), table(spark, sf_dir, "labels"))
    return quality_model.scored(measured, learned)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's first eight whitened components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "embedding", keep=["vec_id"])


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_personal_data": op7_personal_data,
    "op8_html_main": op8_html_main,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_ranked_search": op11_ranked_search,
    "op12_quality_trees": op12_quality_trees,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op2_warc": OP2_SQL, "op3_quality_rules": OP3_SQL, "op9_substring_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL}
