"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairframe.llm import pitman_yor
from pairframe.llm.bpe import coded_documents
from pairframe.llm.clusters import clustered_vectors
from pairframe.llm.common import table
from pairframe.llm.decontaminate import leaking_documents
from pairframe.llm.imatch import fingerprinted_documents
from pairframe.llm.licenses import licensed_documents
from pairframe.llm.lines import line_counts
from pairframe.llm.minhash import duplicate_documents
from pairframe.llm.quality import scored_documents
from pairframe.llm.search import ranked_documents
from pairframe.llm.sharding import sharded_documents
from pairframe.llm.suffixes import repeated_bytes
from pairframe.llm.tokenfiles import filed_documents

QUERIES = {}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = "[x FOR x IN string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+') IF x <> '']"
_SHINGLES = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]"

#: All links by their full sets, then everything reachable over them.
NEAR_DUPLICATES_SQL = (
    f"WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents), "
    f"s AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM t WHERE len(w) > 0), "
    "n AS (SELECT doc_id, count(s) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id), "
    "p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), "
    "l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)), "
    "e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), "
    "r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x) "
    "SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n"
)

#: Every window that holds a shingle of the item, by its exact bag.
LEAKS_SQL = (
    f"WITH d AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents), "
    f"i AS (SELECT item_id, {_WORDS.format('lower(text)')} AS w FROM benchmark), "
    f"ds AS (SELECT doc_id, len(w) - 4 AS size, unnest({_SHINGLES}) AS s, unnest(range(0, greatest(len(w) - 4, 1))) AS place FROM d WHERE len(w) >= 5), "
    f"b AS (SELECT item_id, len(w) - 4 AS m, unnest({_SHINGLES}) AS s FROM i WHERE len(w) >= 5), "
    "bs AS (SELECT item_id, m, s, count(*) AS k FROM b GROUP BY ALL), "
    "h AS (SELECT doc_id, item_id, m, least(m, size) AS width, size, s, k, place FROM ds JOIN bs USING (s)), "
    "w AS (SELECT doc_id, item_id, m, width, size, s, k, unnest(range(greatest(place - width + 1, 0), least(place, size - width) + 1)) AS start FROM h), "
    "c AS (SELECT doc_id, item_id, m, width, start, s, least(count(*), k) AS shared FROM w GROUP BY doc_id, item_id, m, width, start, s, k), "
    "j AS (SELECT doc_id, item_id, start, sum(shared) / (m + width - sum(shared)) AS similarity FROM c GROUP BY doc_id, item_id, m, width, start) "
    "SELECT doc_id, item_id, CAST(start AS BIGINT) AS first_word, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.75 "
    "QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"
)

#: Every pair of lines that shares a shingle, by their full sets.
LINES_SQL = (
    "WITH d AS (SELECT doc_id, string_split(replace(replace(lower(text), chr(9), ' '), chr(13), ' '), chr(10)) AS l FROM documents), "
    "u AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no FROM d), "
    "t AS (SELECT doc_id, line_no, [x FOR x IN string_split(line, ' ') IF x <> ''] AS w FROM u), "
    f"s AS (SELECT DISTINCT doc_id, line_no, unnest({_SHINGLES}) AS s FROM t WHERE len(w) > 0), "
    "n AS (SELECT doc_id, line_no, count(*) AS n FROM s GROUP BY ALL), "
    "p AS (SELECT a.doc_id AS d1, a.line_no AS l1, b.doc_id AS d2, b.line_no AS l2, count(*) AS c FROM s a JOIN s b "
    "ON a.s = b.s AND (a.doc_id, a.line_no) > (b.doc_id, b.line_no) GROUP BY ALL), "
    "g AS (SELECT DISTINCT d1, l1 FROM p JOIN n x ON d1 = x.doc_id AND l1 = x.line_no JOIN n y ON d2 = y.doc_id AND l2 = y.line_no "
    "WHERE c >= 0.75 * (x.n + y.n - c)), "
    "r AS (SELECT d1, count(*) AS k, string_agg(CAST(l1 AS VARCHAR), ',' ORDER BY l1) AS removed FROM g GROUP BY d1) "
    "SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(k, 0) AS n_removed, coalesce(removed, '') AS removed_lines "
    "FROM d LEFT JOIN r ON doc_id = d1"
)

_TERMS = "regexp_extract_all(translate(text, '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(_UPPER, _UPPER.lower())

#: Every document against every item, by their terms.
SEARCH_SQL = (
    f"WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), "
    "n AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0), "
    "c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n), "
    f"i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) "
    "WHERE term IN (SELECT term FROM i) GROUP BY ALL), "
    "w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w "
    "FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c), "
    "s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) "
    "AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id) "
    "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score "
    "FROM s WHERE score > 0 QUALIFY rank <= 50"
)


def _clusters_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Each round as two tables: the assignment, then the centroids it makes."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v "
        f"FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF isfinite(x)]) = {dim})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM "
        f"(SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, c, "
            f"CAST(list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {dim + 1})]) AS BIGINT) AS d FROM v, c{r}) "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"
        )
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list(s ORDER BY i) AS c "
                "FROM (SELECT k, i, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS s FROM (SELECT k, i, sum(x) AS s, count(*) AS n "
                f"FROM (SELECT k, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY k, i)) GROUP BY k) m USING (k))"
            )
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST({last}.k AS INT) AS cluster, d AS distance, "
        f"CAST(sum(d) OVER (PARTITION BY {last}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON {last}.k = c{rounds}.k"
    )


CLUSTERS_SQL = _clusters_sql()

SQL = {
    "op3_minhash_hamming": NEAR_DUPLICATES_SQL,
    "op8_simhash_decontamination": LEAKS_SQL,
    "op10_line_similarity": LINES_SQL,
    "op11_range_maximum_search": SEARCH_SQL,
    "op12_geometric_drift": CLUSTERS_SQL,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(table(spark, sf_dir, "documents"))


@query
def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed_documents(table(spark, sf_dir, "documents"))


@query
def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_documents(table(spark, sf_dir, "documents"))


@query
def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op6_imatch_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted_documents(table(spark, sf_dir, "documents"))


@query
def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored_documents(table(spark, sf_dir, "documents"))


@query
def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_documents(table(spark, sf_dir, "documents"))


@query
def op10_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = line_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("removed_lines", F.array_join(F.transform("removed_lines", lambda i: i.cast("string")), ","))


@query
def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_geometric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_vectors(table(spark, sf_dir, "embeddings"))


@query
def op13_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filed_documents(table(spark, sf_dir, "documents"))
