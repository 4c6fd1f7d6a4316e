"""The corpus pipeline: quality, near duplicates, repeated passages, source mix, SentencePiece ids.

Each stage takes all rows of the one before, and all but the last return the columns of documents. run() writes
each stage's rows into the shared folder and reads them again, so a lost executor never recomputes a stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import mixing, ngram_join, pieces, quality, suffix_dedup
from lodestone.llm.common import stash, table, tokenizer_path
from lodestone.llm.queries import MIX_WEIGHTS, mix_levels

#: The mix aims at four fifths of all tokens and takes a document twice at most.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (4, 5), 2, 29


def good_documents(spark, docs, sf_dir):
    """Documents whose quality score reaches 0.7; the trees learn from labelled rows that are not held out."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark, docs, sf_dir):
    """The row with the smallest doc_id of each group of near copies, and all that are alone; of rows with one doc_id
    those with the smallest text hash come first, null doc_ids come last. Rows equal in doc_id and text are one."""
    keyed = suffix_dedup._keyed(docs.select("doc_id", "text", F.struct("*").alias("_row")))
    first = ngram_join.components(keyed.select(F.col("doc").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("doc")).distinct()
    kept = keyed.join(first, "doc", "left_semi")
    if keyed.groupBy("doc").count().where("count > 1").head(1):
        kept = kept.dropDuplicates(["doc"])
    return kept.select("_row.*")


def without_repeats(spark, docs, sf_dir):
    """Texts without the passages that stand in an earlier document; documents of which nothing is left go."""
    return suffix_dedup.rewrite(docs)


def mixed(spark, docs, sf_dir):
    """The rows that the target weights take, twice where a source is short of its share."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED).select(*(F.col(f"`{c}`") for c in docs.columns))


def piece_ids(spark, docs, sf_dir):
    """doc_id, n_pieces, ids (unsigned 32-bit, little endian) and their crc32."""
    got = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "ids")


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each_group), ("repeats", without_repeats), ("mix", mixed), ("pieces", piece_ids)]
#: Trees, unions of sets and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{name}")
    return docs
