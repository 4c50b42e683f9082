"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
under the shared folder and read again as the `docs` of the next one. All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairframe.llm.bpe import encode_decode
from pairframe.llm.common import Workspace, packed, table, unpacked
from pairframe.llm.decontaminate import decontaminate
from pairframe.llm.lines import dedup_lines
from pairframe.llm.minhash import keep_one
from pairframe.llm.quality import score, train, vectors

#: Documents below this score are rejected. Lower than the threshold of the scoring query:
#: a filter should not lose clean documents, and poor ones score near zero.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant, fitted on the labelled ones, does not reject.

    Null and empty texts are scored as texts without words; rows that repeat are judged alike;
    columns may have any names. With no labels of both kinds every score is the same prior.
    """
    work = Workspace(spark, "quality-stage")
    model = train(work.save(vectors(docs.select("doc_id", "text")), "vectors"), table(spark, sf_dir, "labels"))
    work.keep_only()
    scored = score(docs.select(packed(docs), "text"), model, out="quality")
    return unpacked(scored.filter(F.col("quality") >= LEAST_QUALITY), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line already said; n_chars follows the text.

    Null, empty and blank texts stay. A document all of whose words went with its lines goes.
    Rows that repeat both doc_id and text stay alike. Columns may have any names.
    """
    result = dedup_lines(docs)
    return result.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else result


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Null, empty and wordless texts stay; rows that repeat both doc_id and text become one.
    Columns may have any names.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null, empty and wordless texts stay; rows that repeat go or stay together. Columns may have
    any names.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids, and whether they decode to the text.

    Null and empty texts have no ids; every row is coded where it lies.
    """
    coded = encode_decode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    intact = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", intact.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Fitting, signatures and token ids are not SQL; the run is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what a stage returned goes when the next one is written."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.keep_only(docs)
    return docs
