"""The corpus operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (
    decontaminate,
    divergence,
    exact_dedup,
    fim,
    langid,
    line_dedup,
    minhash,
    packing,
    pii,
    quality,
    token_counts,
    toxicity,
    wavelet,
)
from graphloom.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
KEY = "surrogates-1"  # of the registered query; a real run brings a secret one

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op1(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedupe(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(table(spark, sf_dir, "documents"), KEY)


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.op7(table(spark, sf_dir, "documents"), tokenizer())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rearranged for filling in, and restored; see ``fim.transform``."""
    return fim.op11(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document; see ``token_counts.count_tokens``."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language are apart; see ``divergence.audit``."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality": op2_quality,
        "op3_decontaminate": op3_decontaminate,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_packing": op5_packing,
        "op6_pii": op6_pii,
        "op7_wavelet": op7_wavelet,
        "op8_toxicity": op8_toxicity,
        "op9_langid": op9_langid,
        "op10_minhash": op10_minhash,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_counts": op12_token_counts,
        "op13_source_divergence": op13_source_divergence,
    }


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _gram(tokens: str, at: str, size: str) -> str:
    return f"array_to_string({tokens}[{at}:{at} + {size} - 1], ' ')"


_OP3 = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
    b2 AS (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
    b3 AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM b2),
    win AS (SELECT DISTINCT item_id, k, {_gram("w", "p", "k")} AS g FROM b3),
    ks AS (SELECT DISTINCT k FROM win),
    d2 AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
    g AS (SELECT doc_id, p, k, {_gram("w", "p", "k")} AS g FROM d2),
    hit AS (SELECT doc_id, p, k, item_id FROM g JOIN win USING (k, g)),
    places AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS at FROM hit),
    n AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

_OP4 = r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
               FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM t"""

_OP10 = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                                '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM p),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g)
          WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, 8 * {{0}} + {k + 1}, 1)) - 1) * {16 ** (7 - k)}" for k in range(8))
_OP11 = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', doc_id)) AS h,
                      regexp_extract_all(coalesce(text, ''),
                          '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
    c AS (SELECT *, len(u) + 1 AS m, {_HEX.format(0)} AS h1, {_HEX.format(1)} AS h2,
                 {_HEX.format(2)} AS h3, {_HEX.format(3)} AS h4 FROM d),
    f AS (SELECT *, least(h1 % m, h2 % m) AS a, greatest(h1 % m, h2 % m) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                           OR h3 % 100 >= 50 THEN 'plain'
                      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
    s AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS mid,
                 array_to_string(u[b + 1:], '') AS s FROM f)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', mid)
                            ELSE concat('<S>', s, '<P>', p, '<M>', mid) END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM s"""

_OP13 = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
               FROM documents),
    o AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 3),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
    p AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c,
               1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
               FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
               LEFT JOIN n USING (lang, source)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q
          FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) JOIN v USING (lang)),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM t WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": _OP3,
        "op4_exact_dedup": _OP4,
        "op10_minhash": _OP10,
        "op11_fill_in_middle": _OP11,
        "op13_source_divergence": _OP13,
    }
