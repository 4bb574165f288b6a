"""The corpus pipeline: stages that each apply one operator of tidemill.llm to what their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.langid import UNKNOWN, fit, identify
from tidemill.llm.mixing import mix
from tidemill.llm.near_dedup import near_duplicates
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.store import cut
from tidemill.llm.tokens import token_files_of

#: Least share of a document's letters in languages that are known.
MIN_SHARE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones too, or whose letters are to less than MIN_SHARE of
    known languages, be it of several, go."""
    found = identify(docs, fit(docs), spans=False, keep_row=True, explained=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("explained") >= MIN_SHARE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. Rows that repeat a doc_id are one
    document; rows without one are linked with nothing and stay."""
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return known.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_row=True)
    return found.filter("n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares by source, language and topic."""
    return mix(docs, keep_row=True).filter("kept").select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files_of(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: No SQL for learned models and Huffman files; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
