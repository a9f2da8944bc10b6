"""The queries on training data by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm import byte_bpe, conversations, exact_dedup, hard_negatives, imatch, language_id, licenses, mixing, ngram_join, packing, token_counts, token_files, toxicity
from ridelens.llm.shared import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(make: Callable[[SparkSession, str], DataFrame]):
    @wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return make(spark, sf_dir)

    QUERIES[make.__name__] = run
    return run


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


@query
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op11_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
),
s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.q, v.q)::BIGINT AS score
    FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id != v.vec_id
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece's checksum is taken of its ids where they are read."""
    return packing.packed(table(spark, sf_dir, "documents"), ids_crc32=F.crc32("ids"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(table(spark, sf_dir, "conversations"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files under stand-in paths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", licenses.standin_path().alias("path"), "text")
    return licenses.licences(docs, keep=("doc_id",))


def _licence_sql() -> str:
    """The same in SQL; weights are made from the templates' terms there too."""
    terms = ", ".join(
        f"({i}, '{name}', '{term}')" for i, (name, text) in enumerate(licenses.TEMPLATES) for term in licenses.template_terms(text)
    )
    n = len(licenses.TEMPLATES)
    return f"""
WITH words(template, licence, term) AS (VALUES {terms}),
tf AS (SELECT template, licence, term, count(*) AS n FROM words GROUP BY ALL),
idf AS (SELECT term, ln({1 + n}.0 / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT template, licence, term, n * idf AS w FROM tf JOIN idf USING (term)),
weights AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM raw),
files AS (
    SELECT CASE WHEN doc_id % 20 != 0 THEN concat_ws('/', source, lang, 'd' || doc_id % 7)
                WHEN doc_id // 20 % 3 = 0 THEN source
                WHEN doc_id // 20 % 3 = 1 THEN concat_ws('/', source, lang)
                ELSE concat_ws('/', source, lang, 'd' || doc_id % 7) END AS dir,
           CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name,
           doc_id, text
    FROM documents
),
lines AS (SELECT dir || '/' || name AS path, unnest(string_split(text, chr(10))) AS line FROM files),
sentences AS (
    SELECT path, unnest(string_split_regex(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n')) AS sentence FROM lines
),
numbered AS (SELECT path, row_number() OVER () AS k, lower(sentence) AS sentence FROM sentences WHERE lower(sentence) SIMILAR TO '.*[a-z0-9].*'),
terms AS (
    SELECT path, k, term, count(*) AS n
    FROM (SELECT path, k, unnest(string_split_regex(sentence, '[^a-z0-9]+')) AS term FROM numbered) WHERE term != '' GROUP BY ALL
),
weighed AS (SELECT path, k, t.term, n * coalesce(idf, ln({1 + n}.0) + 1) AS w FROM terms t LEFT JOIN idf USING (term)),
norms AS (SELECT path, k, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
scored AS (
    SELECT path, licence, round(sum(w * weight) / any_value(norm), 6) AS score
    FROM weighed JOIN weights USING (term) JOIN norms USING (path, k) GROUP BY path, k, template, licence
),
own AS (
    SELECT path, licence, score FROM scored WHERE score >= {licenses.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1
),
given AS (
    SELECT dir AS above, licence AS given FROM own JOIN files ON path = dir || '/' || name
    WHERE name LIKE 'LICENSE.%'
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1
),
nearest AS (
    SELECT dir, given, above AS licence_dir
    FROM (SELECT DISTINCT dir FROM files) JOIN given ON dir = above OR starts_with(dir, above || '/')
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1
)
SELECT doc_id, dir || '/' || name AS path,
       coalesce(licence, given) AS licence,
       score,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN licence IS NULL THEN licence_dir END AS licence_dir
FROM files LEFT JOIN own ON path = dir || '/' || name LEFT JOIN nearest USING (dir)
"""


ORACLES["op5_licenses"] = _licence_sql()
