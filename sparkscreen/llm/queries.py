"""The catalogue of this subpackage: one thin query an operator, and SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is the top directory, two levels follow from the
    id, and a document that begins with a licensing line is its directory's LICENSE."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    name = F.when(first.rlike("(?i)licen[sc]e|rights reserved"), F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 40).cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    found = license_scan(files_of(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "licence", "basis", F.round("own_score", 6).alias("own_score"), "from_directory")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import stored_digests

    found = stored_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_crf as crf

    docs = table(spark, sf_dir, "documents")
    field = crf.fit(docs, table(spark, sf_dir, "labels"), use=~crf.held_out(0, 5))
    scores = crf.score_documents(docs, field)
    return scores.select("doc_id", crf.held_out(0, 5).alias("held_out"), "score", (F.col("score") >= crf.LIMIT).cast("int").alias("predicted"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score_documents
    from .quality_crf import held_out

    return score_documents(table(spark, sf_dir, "documents"), held_out(2, 7))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT r, item_id, i, grams.n FROM grams JOIN win USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y USING (g)
          JOIN sizes nx ON nx.doc_id = x.doc_id JOIN sizes ny ON ny.doc_id = y.doc_id
          WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op1_sql() -> str:
    from .license_scan import LIKE, TEMPLATES, template_terms

    counted = template_terms(TEMPLATES)
    rows = ", ".join(f"({i}, '{name}', '{t}', {c})" for i, (name, counts) in enumerate(counted) for t, c in counts.items())
    terms = "list_filter(string_split_regex(" + _LOWER.format("{}") + ", '[^a-z0-9]+'), lambda w: w <> '')"
    return rf"""
WITH tpl(place, name, term, c) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || CAST(floor(doc_id / 1000) AS BIGINT) || '/' || CAST(floor(doc_id / 40) AS BIGINT) AS dir,
      regexp_matches(string_split(coalesce(text, ''), chr(10))[1], '(?i)licen[sc]e|rights reserved') AS is_file FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT r, unnest(list_distinct({terms.format("text")})) AS term FROM d) WHERE term IN (SELECT term FROM tpl) GROUP BY term),
nn AS (SELECT count(*) AS n FROM d),
idf AS (SELECT DISTINCT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM tpl LEFT JOIN df USING (term), nn),
norm AS (SELECT place, name, sqrt(sum(c * idf * c * idf)) AS norm FROM tpl JOIN idf USING (term) GROUP BY place, name),
units AS (SELECT r, row_number() OVER () AS u, terms FROM (
    SELECT r, {terms.format("line")} AS terms FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    UNION ALL SELECT r, {terms.format("text")} FROM d WHERE is_file)),
tf AS (SELECT r, u, term, count(*) AS tf FROM (SELECT r, u, unnest(terms) AS term FROM units) GROUP BY r, u, term),
sq AS (SELECT u, sqrt(sum(tf * coalesce(idf, ln(1 + n) + 1) * tf * coalesce(idf, ln(1 + n) + 1))) AS len FROM tf LEFT JOIN idf USING (term), nn GROUP BY u),
dots AS (SELECT r, u, place, sum(tf * idf * c * idf) AS dot FROM tf JOIN tpl USING (term) JOIN idf USING (term) GROUP BY r, u, place),
cos AS (SELECT r, place, round(dot / (len * norm), 9) AS score FROM dots JOIN sq USING (u) JOIN norm USING (place)),
best AS (SELECT r, place, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, place) AS k FROM cos) WHERE k = 1 AND score >= {LIKE}),
found AS (SELECT d.r, doc_id, dir, is_file, best.place, best.score FROM d LEFT JOIN best USING (r)),
declared AS (SELECT dir AS from_directory, place AS dplace FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, place) AS k FROM found WHERE is_file AND place IS NOT NULL) WHERE k = 1),
up AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS from_directory FROM (SELECT DISTINCT dir, unnest([1, 2, 3]) AS k FROM d)),
inh AS (SELECT dir, from_directory, dplace FROM (SELECT up.*, dplace, row_number() OVER (PARTITION BY dir ORDER BY k DESC) AS o FROM up JOIN declared USING (from_directory)) WHERE o = 1)
SELECT doc_id, (SELECT name FROM norm WHERE norm.place = coalesce(found.place, dplace)) AS licence,
       CASE WHEN found.place IS NOT NULL THEN 'own' WHEN dplace IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       round(score, 6) AS own_score, CASE WHEN found.place IS NULL THEN from_directory END AS from_directory
FROM found LEFT JOIN inh USING (dir)
"""


def queries() -> dict[str, Query]:
    own = [op1_license_scan, op2_decontaminate, op3_token_store, op4_ngram_join, op5_token_counts, op6_top_k, op7_secret_scan, op8_quality_crf, op9_bpe_automaton, op10_gru_lm]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op2_decontaminate": OP2_SQL, "op4_ngram_join": OP4_SQL, "op6_top_k": OP6_SQL}
