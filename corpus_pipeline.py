"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; `run` writes it as Parquet below `spark.checkpoint.dir` and reads it
again as the next stage's documents. All stages but the last keep the columns of their documents.

1. Language ID: learned from the documents' own language labels; a document without a text, without a letter, or whose language is
   less likely than all others together is rejected.
2. N-gram Jaccard join: of every group of near copies the document with the smallest id stays.
3. Benchmark decontamination: documents of which a twentieth of the words or more stand in benchmark windows are dropped.
4. Mixing: every source reaches its target of words; a document may go, stay or stand twice. Rows come out shard by shard.
5. Token files: the mix is encoded into wavelet-matrix files; the result has one row per document of the mix, read from the files.

ORACLE_SQL is None: stages 1, 2 and 5 cannot be stated in SQL; tests hold `run` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontaminate, jaccard, language, mixing, wavelet
from seriesloom.llm.buffers import quoted
from seriesloom.llm.workspace import work_folder, written

LEAST_LIKELY = 0.5
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [quoted(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagged = docs.select(*_columns(docs), F.struct(*_columns(docs)).alias("__row"))
    out = language.predict(tagged, language.train(docs), keep=["__row"])
    return out.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LIKELY)).select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagged = docs.select(F.col("text"), F.struct(*_columns(docs)).alias("__row"))
    found = decontaminate.judged(decontaminate.scan(tagged, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__row"]))
    return found.where(~F.col("contaminated")).select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.dealt(mixing.mix(docs), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_token_files(docs, f"{work_folder(spark)}/tokens"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate_documents),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage{k + 1}")
    return docs
