"""The operators with their production parameters over whole tables: one query for each."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (
    ann,
    audit,
    html,
    infill,
    jaccard,
    language,
    licenses,
    lines,
    mixing,
    packing,
    quality,
    sharding,
    toxicity,
)
from tracelake.llm.samples import remainder

# Fixed value: words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: str = "text") -> Column:
    """Number of words; null for a null text."""
    return F.regexp_count(F.col(text), F.lit(WORD))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary of the installed public tokenizers; executors find it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and the likelihood ratio of every document; documents labelled as good are the trusted text."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit_ratio_model_by_ids(documents, table(spark, folder, "labels").where("quality = 1"))
    assessed = documents.select("doc_id", quality.assess(model, F.col("text")).alias("found"))
    found = F.col("found")
    failed, stays = quality.base_failed(found).alias("base_failed"), quality.kept(model, found).alias("kept")
    return assessed.select("doc_id", *(found[x].alias(x) for x in quality.MEASURES), failed, stays, found["ratio"].alias("ratio"))


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.extract_main_text(table(spark, folder, "pages"), html.train())


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return ann.nearest(table(spark, folder, "embeddings"))


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Documents connected by 85 percent of their four-word shingles."""
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """The licence that every document states."""
    documents = table(spark, folder, "documents")
    model = licenses.fit_license_model(documents)
    scanned = documents.select("doc_id", licenses.scan_paragraphs(model, F.col("text")).alias("found"))
    return scanned.select("doc_id", *licenses.summary(scanned))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources weighing 3, 1, 2, repeating, in blocks of 64 words over 16 shards."""
    mixed = mixing.mix_sources(table(spark, folder, "documents"), word_count())
    columns = ["doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"), "source"]
    return mixing.taken(mixed).select(*columns)


def op9_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token ids in sequences of 1,024."""
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_file())


def language_model(documents: DataFrame) -> language.LanguageModel:
    """Learned from the documents that are not held out."""
    return language.fit_language_model(documents.where(remainder(F.col("doc_id"), 4) != 2))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    documents = table(spark, folder, "documents")
    found = language.language(language_model(documents), F.col("text"))
    held_out = remainder(F.col("doc_id"), 4) == 2
    rows = documents.select("doc_id", held_out.alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.accepted")


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labels of documents that are not held out."""
    return toxicity.fit_toxicity_model(labels.where(remainder(F.col("doc_id"), 3) != 1), documents)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document, learned from two thirds of the labels."""
    documents = table(spark, folder, "documents")
    model = toxicity_model(documents, table(spark, folder, "labels"))
    held_out = remainder(F.col("doc_id"), 3) == 1
    scored = documents.select(
        "doc_id", held_out.alias("held_out"), toxicity.toxicity(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def op8_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards by document key."""
    placed = sharding.shard_rows(table(spark, folder, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all their orders, for each source."""
    masks = audit.document_masks(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return audit.filter_interactions(masks, "part", "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of 40 characters or more that five documents share."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents in order for infilling, and what is got back from them."""
    made = infill.infill(table(spark, folder, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("text"), F.col("form"))
    digests = [F.sha2("text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_main_text": op2_main_text,
    "op3_nearest": op3_nearest,
    "op4_jaccard": op4_jaccard,
    "op5_licenses": op5_licenses,
    "op6_mix_sources": op6_mix_sources,
    "op7_language": op7_language,
    "op8_jump_shards": op8_jump_shards,
    "op9_pack_documents": op9_pack_documents,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_infill": op13_infill,
}
