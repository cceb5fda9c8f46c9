"""Corpus pipeline: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.llm import byte_bpe, line_dedup, mixing, ngram_join, toxicity
from farelens.llm.common import BATCH_BYTES, as_documents, discard, discard_since, frozen, id_or_last, whole_text, written

#: Rows of a table of keys, about forty bytes each, up to which it is sent to the texts; beyond, the texts are shuffled to it.
MAX_KEYS = 500_000


def _to_texts(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be joined to texts."""
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else keys


def _packed(docs: DataFrame) -> DataFrame:
    """Rows as one column, so that no column of theirs can clash; beside it doc_id (null last) and hash of the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), id_or_last(F.col("doc_id")).alias("b"), F.xxhash64(whole_text()).alias("sig"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    A null text is scored as an empty one. Rows that agree in doc_id (null included) and text share the decision. Other columns pass as they are.
    An empty table stays empty.
    """
    before = written()
    scores = toxicity.ToxicityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)
    toxic = frozen(scores.filter(F.col("score") >= toxicity.THRESHOLD).select("b", "sig").distinct(), "toxic", batch=BATCH_BYTES)
    discard_since(before, toxic)
    return as_documents(_packed(docs).join(_to_texts(toxic), ["b", "sig"], "left_anti").select("_row.*"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; a null text stays null. n_chars follows the text."""
    rows = line_dedup.drop_repeated_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("_lines.kept"))
    changed = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("_lines.n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return as_documents(changed, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts (five words, 0.8): the smallest doc_id, null last, then the smallest hash.

    Every row is a document of its own: of rows that agree in doc_id and text one stays. Texts without words all stay.
    """
    before = written()
    found = ngram_join.ngram_rows(docs, width=5, threshold=80).filter("n_shingles > 0")
    keys = found.groupBy("b", "sig").agg(F.count("*").alias("rows"), F.min("least").alias("least"))
    first = F.col("least") == F.struct("b", "sig")
    keys = frozen(keys.filter(~first | (F.col("rows") > 1)).select("b", "sig", first.alias("first")), "near")
    rows = _packed(docs)
    alone = rows.join(_to_texts(keys.select("b", "sig")), ["b", "sig"], "left_anti").select("_row")
    # Which of the equal rows stays follows from their other columns, not from their order.
    one = F.min_by("_row", F.xxhash64(F.to_json("_row")))
    again = frozen(keys.filter("first").drop("first"), "again")
    discard_since(before, keys, again)
    repeated = rows.join(_to_texts(again), ["b", "sig"]).groupBy("b", "sig").agg(one.alias("_row"))
    return as_documents(alone.unionByName(repeated.select("_row")).select("_row.*"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their first words; documents without words stay once.

    A null text has no words; a null source is a source of its own, the last one. Rows that agree in doc_id, text and source share their
    copies evenly, some one more than others. Copies repeat all columns. An empty table stays empty.
    """
    before = written()
    copies = mixing.Mixture(docs).copies().withColumnsRenamed({"b": "_b", "sig": "_sig", "source": "_source"})
    # Rows that agree in doc_id, text and source share their copies: as many for each, and one more for the first ones.
    copies = copies.withColumn("share", F.floor(F.col("copies") / F.col("rows"))).withColumn("spare", F.pmod("copies", "rows"))
    copies = frozen(copies.drop("copies", "rows"), "copies")
    even, uneven = (frozen(copies.filter(f), "copies") for f in ("spare = 0 and share > 0", "spare > 0"))
    discard_since(before, even, uneven)
    times = F.array_repeat("_row", F.col("share").cast("int"))
    found = _packed(docs).join(_to_texts(even), _same_document()).select(F.explode(times).alias("_row"))
    if not uneven.isEmpty():
        # Only repeated rows are numbered.
        rows = _packed(docs).join(_to_texts(uneven), _same_document()).drop("_b", "_sig", "_source")
        rows = mixing.numbered(rows, ["source_no", "b", "sig"], "k")
        share = (F.col("share") + (F.col("k") < F.col("spare")).cast("long")).alias("share")
        found = found.unionByName(rows.select("_row", share).select(F.explode(times).alias("_row")))
    return as_documents(found.select("_row.*"), docs)


def _same_document() -> Column:
    return (F.col("b") == F.col("_b")) & (F.col("sig") == F.col("_sig")) & F.col("_row.source").eqNullSafe(F.col("_source"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, token ids (little-endian, 32 bits each), and the SHA-256 of the ids and of the bytes they decode to.

    Null and empty texts have no tokens, and the hashes are those of no bytes. Repeated rows are encoded each; a null doc_id stays null. Only
    doc_id and text are read. An empty table gives an empty result.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = byte_bpe.round_trip(docs, path, pattern)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: Trained scores and pseudorandom draws are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, last = written(), docs
        docs = frozen(stage(spark, docs, sf_dir), name)
        # The stage's own tables and the documents before it have been read for the last time.
        discard_since(before, docs)
        if name != STAGES[0][0]:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
