"""The numbered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WORD, spread, written
from . import chat, decontaminate, divergence, langid, licenses, lm, mixing, neardup, packed, quality, secrets, spelling, urls


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "random")).cast("long").alias("n_random"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "start", "n")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra))
    back = chats.withColumn("turns", chat.read_back(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"])), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    at = F.col("places.at")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("places.label"))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality.measured(_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), keep=["doc_id", "lang", "source"])
    return quality.judge(written(counts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, contents = neardup.classes(_table(spark, sf_dir, "documents", "doc_id", "text"))
    empty = _table(spark, sf_dir, "documents", "doc_id", "text").filter(~F.coalesce("text", F.lit("")).rlike(WORD)).select("doc_id", F.col("doc_id").alias("class_id"))
    marked = rows.join(contents, "key").select(F.col("id").alias("doc_id"), "class_id")
    return marked.unionByName(empty)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return scored.select(F.col("id").alias("doc_id"), "n_words", "log_score", "mean_log_score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_table(spark, sf_dir, "pages", "page_id", "url"), urls.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: File of the tokenizer of op11, and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = packed.write(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), end_id=END_ID)
    return packed.read(spark, done.folder).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents", "text", "lang", "source"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_mix_to_weights": op7_mix_to_weights,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_url_filter": op10_url_filter,
    "op11_token_ids": op11_token_ids,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op12_spelling_variants": spelling.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
    "op9_lm_score": lm.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_mix_to_weights": mixing.ORACLE,
    "op10_url_filter": urls.ORACLE,
}
