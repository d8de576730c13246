"""From raw documents to packed sequences: each stage takes what its predecessor kept.

toxicity      documents scored 0.5 or more go
line_dedup    lines that three documents share stay in the largest id alone; n_chars follows the text
near_dedup    of documents linked at 0.8 of their 5-word shingles the smallest id of each group stays
mixing        sources are drawn to target weights, 90 % of all tokens in one pass at most
packing       sequences of 2048 tokens; one row for each piece

All stages but the last return the columns of their input. Nulls, repeated rows, empty tables and extra columns: as each
operator's module says; of rows that share a doc_id, near_dedup keeps the one with the smallest text, and rows without a
doc_id pass it. ORACLE_SQL is None: models, tokenizers and shingle links aren't SQL; the tests hold each stage against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import line_dedup, mixing, near_dedup, packing, shared, toxicity
from rasterloom.llm.shared import table

ORACLE_SQL: str | None = None


def _masked(docs: DataFrame) -> DataFrame:
    """docs with its columns under names that no operator uses, so that extra columns can't clash."""
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])


def _unmasked(df: DataFrame, docs: DataFrame, **changed: F.Column) -> DataFrame:
    return df.select(*[changed.get(c, F.col(f"`in_{c}`")).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = _masked(docs)
    scored = toxicity.score(own, model, "in_text", tuple(own.columns))
    return _unmasked(scored.where(F.col("score") < 0.5), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _masked(docs)
    carry = tuple(c for c in own.columns if c not in ("in_doc_id", "in_text"))
    kept = line_dedup.line_dedup(own, "in_doc_id", "in_text", carry, kept_col="kept")
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return _unmasked(kept, docs, **changed)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _masked(docs)
    gone = near_dedup.near_dedup(own, "in_doc_id", "in_text").where(~F.col("kept")).select(F.col("doc_id").alias("in_doc_id")).distinct()
    return _unmasked(one_row_an_id(own.join(gone, "in_doc_id", "left_anti"), own), docs)


def one_row_an_id(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Of rows, which are some of before, that share an in_doc_id the one with the smallest text, then the smallest hash of all columns; all without an id.

    Ids of one row, nearly all, pass by without being sorted or shuffled with their texts; others are aggregated before they are
    shuffled, so it doesn't matter how many rows an id has.
    """
    again = shared.write(before.where("in_doc_id is not null").groupBy("in_doc_id").agg(F.count("*").alias("n")).where("n > 1").select("in_doc_id"), "ids-of-rows")
    if again.isEmpty():
        return rows
    hashed = rows.withColumn("row_hash", F.xxhash64(*[F.to_json(F.struct(c)) if _nested(rows, c) else F.col(c) for c in rows.columns]))
    several = hashed.join(again, "in_doc_id", "left_semi")
    first = several.groupBy("in_doc_id").agg(F.min(F.struct(F.coalesce("in_text", F.lit("")).alias("t"), "row_hash")).alias("first"))
    first = first.select(F.col("in_doc_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))
    kept = several.join(first, (F.col("in_doc_id") == F.col("first_id")) & (F.col("row_hash") == F.col("first_hash")), "left_semi").dropDuplicates(["in_doc_id"])
    return rows.join(again, "in_doc_id", "left_anti").unionByName(kept.select(*rows.columns))


def _nested(rows: DataFrame, name: str) -> bool:
    return rows.schema[name].dataType.typeName() in ("map", "variant")


def draw_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _masked(docs)
    names = own.withColumns({"lang": F.col("in_lang"), "source": F.col("in_source")})
    drawn = mixing.selected(names, mixing.PRODUCTION, mixing.by_number(F.col("source")), share=0.9, max_epochs=1, id_col="in_doc_id", text_col="in_text")
    return _unmasked(drawn, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.place(shared.write(pieces, "pieces"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", draw_mix), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
