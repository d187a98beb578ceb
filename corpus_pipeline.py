"""From raw documents to packed training sequences: language, toxicity, near copies, mixing, packing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.staging import staged
from tracelake.llm import jaccard, language, mixing, packing, toxicity
from tracelake.llm.queries import language_model, table, tokenizer_file, toxicity_model


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it is learned from the documents that are not held out."""
    return docs.where(language.language(language_model(docs), F.col("text"))["accepted"])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the model's threshold."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(model, F.col("text")) < model.threshold)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 80 percent of their five-word shingles connect."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: stretches of documents, each as often as the mix takes it."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1,024: the pieces of the mixed documents with their places."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Trained models, a pseudorandom mix and a tokenizer have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
