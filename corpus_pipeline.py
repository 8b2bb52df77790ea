"""A training-data pipeline over `documents`, a stage for each step.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents (the last: the packed sequences).  ``run``
writes each stage's result as Parquet in the shared folder and rereads it.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns:
each stage follows its operator's module; rows with a null text reach every
stage as empty texts, and no stage fails on them. Extra columns, whatever their names,
stay with their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm import jaccard, mixing, packing, quality, secrets
from tabloom.llm.common import save, table

#: Rows of three numbers that are broadcast at most; beyond that texts are shuffled to them.
PLANNED = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express a learnt classifier or a tokenizer; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


#: Rows in a batch between the JVM and Python; the default of 10,000 texts holds tens of MB on either side.
BATCH = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """For the stage's frame, which is run after the stage has returned: only who runs the stage can set it back."""
    spark.conf.set(_BATCHES, str(BATCH))


def _like(docs: DataFrame, text) -> DataFrame:
    """docs with a new text, and n_chars to match."""
    return docs.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from the labelled documents among these."""
    _small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=docs.columns, name="__quality")
    return scored.filter(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (of several rows with that id, one).

    Rows without an id are documents of their own, and stand after all ids.
    Documents without words link with nothing; each is a group of its own."""
    _small_batches(spark)
    columns, key = docs.columns, "doc_id"
    if docs.filter("doc_id IS NULL").limit(1).count():
        top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        none = save(docs.filter("doc_id IS NULL").withColumn("__id", F.monotonically_increasing_id() + (top + 1)), "without_id")
        docs, key = docs.filter("doc_id IS NOT NULL").withColumn("__id", F.col("doc_id")).unionByName(none), "__id"
    found = jaccard.near_duplicates(docs, id_col=key)
    heads = found.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(heads, key, "left_semi")
    one = Window.partitionBy(key).orderBy(F.xxhash64("text"), "text", "lang", "source")
    if docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        kept = kept.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")
    return kept.select(*columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; no document goes."""
    found = secrets.find_secrets(docs, keep=docs.columns)
    spans = F.transform(secrets.span_list(secrets.KINDS), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    clean = found.withColumn("__spans", spans)
    text = F.when(F.size("__spans") > 0, secrets.redact(F.col("kept.text"), F.col("__spans"))).otherwise(F.col("kept.text"))
    clean = clean.select("kept.*", text.alias("__text"), (F.size("__spans") > 0).alias("__new"))
    n = F.when(F.col("__new"), F.length("__text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumns({"text": F.col("__text"), "n_chars": n}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the mix: a document's text stands as often as its words are taken.

    A document that is not in the mix goes.  One that is taken twice holds its
    text twice; where a source's share ends within a document, the words up to
    there are kept.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count():
        found = mixing.mix_sources(docs, keep=docs.columns).filter("taken > 0").select("kept.*", F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    else:  # ids tell documents apart, so texts need not go through the mix
        plan = save(mixing.mix_sources(docs).filter("taken > 0").select("doc_id", F.col("size").alias("__size"), F.col("taken").alias("__taken")), "mix")
        found = docs.join(F.broadcast(plan) if plan.count() <= PLANNED else plan, "doc_id")
    rest = F.pmod("__taken", "__size").cast("int")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    part = F.array_join(F.slice(words, 1, rest), " ")
    whole = F.array_repeat(F.col("text"), F.floor(F.col("__taken") / F.col("__size")).cast("int"))
    texts = F.when(rest > 0, F.concat(whole, F.array(part))).otherwise(whole)
    return _like(found, F.concat_ws("\n", texts)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_one_of_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and reread. The session's settings are as before then."""
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCHES)
    try:
        for name, stage in STAGES[:-1]:
            docs = save(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(_BATCHES, before)
