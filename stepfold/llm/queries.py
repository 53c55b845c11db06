"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from stepfold.llm import align as A
from stepfold.llm import base
from stepfold.llm import bpe as B
from stepfold.llm import chat as C
from stepfold.llm import decontaminate as D
from stepfold.llm import html as H
from stepfold.llm import langid as L
from stepfold.llm import lm as N
from stepfold.llm import mixing as M
from stepfold.llm import oracles as O
from stepfold.llm import quality as Q
from stepfold.llm import simhash as S
from stepfold.llm import substrings as U
from stepfold.llm import toxicity as X
from stepfold.llm import trie as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files lie; every worker has them at the same place."""
    from public_tokenizers import path

    return str(path(name))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op8_quality_rules", O.QUALITY)
def op8(spark, sf):
    d = Q.quality(base.table(spark, sf, "documents"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_share", "punctuation_lines", "navigation_lines", "boilerplate_lines",
    )


@query("op4_benchmark_decontamination", O.DECONTAMINATION)
def op4(spark, sf):
    return D.contamination(base.table(spark, sf, "documents"), base.table(spark, sf, "benchmark")).drop("text_hash")


@query("op3_source_mixing")
def op3(spark, sf):
    return M.mix_plan(base.table(spark, sf, "documents"))


@query("op9_toxicity")
def op9(spark, sf):
    docs, labels = base.table(spark, sf, "documents"), base.table(spark, sf, "labels")
    model = X.fit(docs.where(base.fold(F.col("doc_id"), 5) != 0), labels)
    scored = X.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (base.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


@query("op10_language_id")
def op10(spark, sf):
    docs = base.table(spark, sf, "documents")
    model = L.fit(docs.where(base.fold(F.col("doc_id"), 4) != 2))
    scored = L.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (base.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_lm_scoring")
def op2(spark, sf):
    docs = base.table(spark, sf, "documents").select("doc_id", "text")
    scored = N.fit_and_score(docs, docs.where(base.fold(F.col("doc_id"), 5) != 1))
    return scored.withColumn("held_out", base.fold(F.col("doc_id"), 5) == 1)


@query("op5_simhash_near_dedup")
def op5(spark, sf):
    found = S.near_duplicates(base.table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_suffix_array_dedup", O.SUBSTRINGS)
def op7(spark, sf):
    found = U.deduplicate(base.table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_html_extraction")
def op6(spark, sf):
    pages = base.table(spark, sf, "pages")
    return H.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op1_chat_formatting", O.CHAT)
def op1(spark, sf):
    turns = C.canonical_turns(base.table(spark, sf, "conversations"))
    both = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(both).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    return C.conversation_digests(C.format_turns(turns.unionByName(probe)))


@query("op11_prefix_trie", O.PREFIX_TRIE)
def op11(spark, sf):
    return T.prefix_trie(T.rebuild(T.encode(base.table(spark, sf, "conversations"))))


@query("op12_bpe_codec")
def op12(spark, sf):
    return B.digests(base.table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op13_tokenizer_alignment")
def op13(spark, sf):
    return A.align(base.table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
