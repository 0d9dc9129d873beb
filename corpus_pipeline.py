"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. The first four return the
columns of documents, extra ones too, whatever their names; the last returns the pieces of packed sequences.

In all stages a row stands for itself: null ids, and ids that several texts share, are told apart by id and text
together. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import decontam, neardup, packing, quality, secrets
from scoreline.llm.common import limit_batches, table
from scoreline.sources.scratch import written

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column with all others, their names replaced by places, so that they can neither clash nor be taken for paths."""
    names = docs.columns
    places = docs.toDF(*[f"c{k}" for k in range(len(names))])
    others = [f"c{k}" for k, c in enumerate(names) if c not in ("doc_id", "text")]
    return places.select(*[F.col(f"c{names.index(c)}").alias(c) for c in ("doc_id", "text")], F.struct(*others or [F.lit(0).alias("none")]).alias("others"))


def _unpacked(packed: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The given columns again, some of them changed."""
    own = {c: F.col(c) for c in ("doc_id", "text")} | changed
    return packed.select(*[(own[c] if c in own else F.col("others")[f"c{k}"]).alias(f"c{k}") for k, c in enumerate(columns)]).toDF(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts have the score of a text without words; repeated rows are judged each. Without labels of both
    kinds the classifier can tell nothing, and all documents stay.
    """
    limit_batches(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    if not model[1].informed:
        return docs
    return _unpacked(quality.score_quality(_packed(docs), model).filter(F.col("score") >= LEAST_QUALITY), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the one with the smallest id, nulls last.

    Of rows with this id and text the one whose columns have the smallest hash stays. Texts without a word are near
    nothing: a row of them goes only if another has the same id and text.
    """
    limit_batches(spark)
    packed = _packed(docs)
    first, second = neardup.row_ids()
    same = (F.col("id1") == F.col("kept1")) & (F.col("id2") == F.col("kept2"))
    kept = neardup.row_classes(packed).filter(same).select("id1", "id2").distinct()
    rows = packed.withColumns({"id1": first, "id2": second}).join(kept, ["id1", "id2"], "left_semi")
    once = rows.groupBy("id1", "id2").agg(F.min_by(F.struct("doc_id", "text", "others"), F.xxhash64(F.to_json("others"))).alias("row"))
    return _unpacked(once.select("row.*"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, repeated rows of them too. Null and empty texts hold none.

    Other texts with the same id stay. Without a benchmark all documents stay.
    """
    limit_batches(spark)
    packed = _packed(docs)
    row = neardup.row_ids()[0]
    found = decontam.contaminated(packed.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id")).distinct()
    return _unpacked(packed.withColumn("row", row).join(found, F.col("row") == F.col("found_id"), "left_anti"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; all rows stay, null and empty texts as they are. n_chars follows the text."""
    limit_batches(spark)
    found = secrets.find_secrets(_packed(docs))
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        old = F.col("others")[f"c{docs.columns.index('n_chars')}"]
        changed["n_chars"] = F.when(F.size("secrets") > 0, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return _unpacked(found, docs.columns, **changed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of up to 4096 tokens. Null and empty texts are an end token; repeated rows are packed each."""
    limit_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, signatures and token ids aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
