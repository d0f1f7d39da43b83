"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_template import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.bpe import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import window_hits

    found = window_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secrets import scan, spans_text

    found = scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.hmm import score

    return score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality_mil import fit, score, training_labels

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(_table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_rules import judge

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.click_dedup import copies, cut, deduplicate
    from quire.llm.common import scratch_path

    return deduplicate(*cut(spark, copies(_table(spark, sf_dir, "clicks")), scratch_path(spark, "click-batches")))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.token_align import align

    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.vector_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html, op2_bpe, op3_decontaminate, op4_warc, op5_secrets, op6_hmm, op7_simhash, op8_suffix, op9_quality, op10_lines, op11_clicks, op12_align, op13_vectors)}
