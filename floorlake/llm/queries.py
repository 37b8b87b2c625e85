"""Registered queries of the training-data operators, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .archive import archived_pages
from .bpe import round_trip_digests
from .codes import vector_codes
from .divergence import source_divergence
from .forest import vector_components
from .grades import quality_grades
from .jaccard import jaccard_components
from .licenses import TEMPLATES, license_scans
from .outliers import quality_rules
from .packing import pack_documents
from .suffixes import contamination_report
from .tokenfile import token_file_documents
from .toxicity import toxicity_scores

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words of the shingle and rule contracts, and the shingle sets of documents, in DuckDB.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        QUERIES[name] = build
        if oracle:
            ORACLE_SQL[name] = oracle
        return build

    return register


_NORMAL = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
_LICENSES = f"""
WITH t(license_id, text) AS (VALUES {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in TEMPLATES.items())}),
lined AS (SELECT doc_id, string_split({_NORMAL.format("text")}, chr(10)) AS lines FROM documents),
units AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS unit FROM lined
          UNION ALL SELECT doc_id, 0, array_to_string(lines, ' ') FROM lined WHERE len(lines) > 1),
uw AS (SELECT doc_id, line, list_filter(string_split(unit, ' '), lambda x: x <> '') AS w FROM units),
tw AS (SELECT license_id, list_filter(string_split({_NORMAL.format("text")}, ' '), lambda x: x <> '') AS w FROM t),
ub AS (SELECT doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM uw),
tb AS (SELECT license_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS p FROM tw),
m AS (SELECT doc_id, line, license_id, len(list_intersect(b, p)) AS overlap, 2 * len(list_intersect(b, p)) / (len(b) + len(p)) AS dice
      FROM ub JOIN tb ON 6 * len(b) >= 4 * len(p) AND 4 * len(b) <= 6 * len(p))
SELECT doc_id, line::INT AS line, license_id, overlap::INT AS overlap, dice FROM m WHERE dice >= 0.8 - 1e-12
"""


@_query("op1_license_scans", _LICENSES)
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans(table(spark, sf_dir, "documents"))


@_query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN sets USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM reach JOIN sizes ON doc_id = a GROUP BY ALL
"""


@_query("op4_ngram_jaccard", _JACCARD)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
d AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY digest)
SELECT page_id, strlen(html) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN d ON p.digest = d.digest AND strlen(html) >= 100
"""


@_query("op5_web_archives", _ARCHIVES)
def op5_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).drop("url")


@_query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@_query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@_query("op10_embedding_near_dedup")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op8_quality_grades")
def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_NEAREST = """a{k} AS (SELECT vec_id, part, x, min(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e)::BIGINT AS best
       FROM p JOIN c{k} USING (part) GROUP BY ALL),
"""
_MOVED = """m{k} AS (SELECT part, e, list(floor(total / n)::BIGINT ORDER BY i) AS z
       FROM (SELECT part, best % 64 AS e, i, sum(x[i]) AS total, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
c{j} AS (SELECT part, e, coalesce(z, y) AS y FROM c{k} LEFT JOIN m{k} USING (part, e)),
"""
_CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[len(v) // 16 * part + 1 : len(v) // 16 * (part + 1)] AS x FROM k, range(16) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS y FROM p QUALIFY e < 64),
{_NEAREST.format(k=0)}{_MOVED.format(k=0, j=1)}{_NEAREST.format(k=1)}{_MOVED.format(k=1, j=2)}{_NEAREST.format(k=2)}
books AS (SELECT sha256(string_agg(y[i]::VARCHAR, ',' ORDER BY part, e, i)) AS digest FROM c2, LATERAL (SELECT unnest(range(1, len(y) + 1)) AS i)),
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN k USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM labelled, books
"""


@_query("op11_vector_codes", _CODES)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_FOLDED)
_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
spots AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM windows), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
met AS (SELECT doc_id, i, k, item_id FROM spots JOIN windows USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS h FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query("op12_benchmark_decontamination", _CONTAMINATION)
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000 * (coalesce(n, 0) + 1) // (total + v))::BIGINT AS p, (1 + 1000000000 * (lang_n + 1) // (lang_total + v))::BIGINT AS q
           FROM totals JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN summed s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM above QUALIFY rank <= 200
"""


@_query("op13_source_divergence", _DIVERGENCE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
