"""One query per operator over its whole table, and the pipeline.

The queries derive the columns that were agreed for them from the operators' own results.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import oracle
from spanloom.llm.bpe import decode_documents, encode_documents
from spanloom.llm.conversations import damaged, repair_audits
from spanloom.llm.fingerprints import fingerprint_documents
from spanloom.llm.language_id import predict_language, train_language_id
from spanloom.llm.line_quality import score_line_quality, train_line_quality
from spanloom.llm.mixing import mix_sources
from spanloom.llm.overlap_join import overlap_join
from spanloom.llm.packing import pack_documents
from spanloom.llm.phrases import mine_phrases
from spanloom.llm.quality_rules import language_references, quality_rules, vocabulary
from spanloom.llm.sharding import shard_by_bytes
from spanloom.llm.stage import fold_of
from spanloom.llm.toxicity import score_toxicity, train_toxicity
from spanloom.llm.url_templates import judge_urls

QUALITY_LIMITS = {
    "min_words": 50,
    "max_repeat_percent": 50,
    "max_class_distance": 0.2,
    "max_word_distance": 0.33,
    "class_guard": 300,
    "word_guard": 150,
}
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file, installed on every machine."""

    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(folds: int, fold: int):
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(fold_of("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs, labels)
    return score_toxicity(docs.select("doc_id", held_out(4, 2), "text"), model, threshold=0.3)


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = train_language_id(docs.where(fold_of("doc_id", 3) != 1).select("text", "lang"))
    return predict_language(docs.select("doc_id", held_out(3, 1), "text"), model)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents")).drop("text", "lang", "n_chars")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    judged = quality_rules(docs.select("doc_id", "text"), language_references(docs), **QUALITY_LIMITS)
    return judged.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


def op5_url_templates(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"), URL_RULES)


def op6_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_join(table(spark, sf, "documents"), k=4, percent=85, links=True)


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf, "documents"), shards=40)


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


def op9_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where(fold_of("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    model = train_line_quality(docs, labels)
    return score_line_quality(docs.select("doc_id", held_out(4, 2), "text"), model, threshold=0.7)


def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf, "documents"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return repair_audits(damaged(rows, F.crc32(name) % 20), gone="gone")


def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return mine_phrases(table(spark, sf, "documents"), least=10, longest=3, best=2000, contained_percent=50)


def op13_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    encoded = encode_documents(table(spark, sf, "documents"), path)
    rows = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode_documents(rows, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_templates": op5_url_templates,
    "op6_overlap_join": op6_overlap_join,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_line_quality": op9_line_quality,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrases": op12_phrases,
    "op13_bpe": op13_bpe,
}
SQL: dict[str, str] = {
    "op4_quality_rules": oracle.quality_rules_sql(vocabulary()[1], QUALITY_LIMITS),
    "op6_overlap_join": oracle.OVERLAP_JOIN,
    "op7_sharding": oracle.SHARDING,
    "op12_phrases": oracle.PHRASES,
}
