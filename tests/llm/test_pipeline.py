"""The pipeline against plain versions of its stages, and on tables without rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabloom.llm import quality, secrets
from tabloom.llm.common import save
from tabloom.storage import trim

from .test_operators import plain_components, valid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and each stage's result over its predecessor's."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        out.append(save(stage(spark, out[-1], SF), name))
    return out


def test_columns_stay(stages):
    assert all(s.columns == pipeline.COLUMNS for s in stages[:-1])


def test_quality_keeps_clean_documents(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(stages[0], quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert kept == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"] or "") for r in stages[1].collect()]
    want = {i for i, (_, component) in plain_components(before).items() if i == component}
    assert Counter(r["doc_id"] for r in stages[2].collect()) == Counter(want)


def test_documents_without_id_stay_unless_copies(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    texts = [(1, text("a")), (None, text("a") + " tail"), (None, text("b")), (None, text("b") + " tail"), (None, text("c")), (None, None), (None, None), (2, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] and r["text"][0]) for r in kept.collect())
    assert got == {(1, "a"): 1, (2, "d"): 1, (None, "b"): 1, (None, "c"): 1, (None, None): 2}


def test_secrets_go_and_the_rest_stays(stages):
    spans = {r["doc_id"]: r["s"] for r in secrets.find_secrets(stages[2]).select("doc_id", secrets.span_list(secrets.KINDS).alias("s")).collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert any(spans.values())
    for r in stages[2].collect():
        text, at, out = r["text"] or "", 0, ""
        for s in sorted((x["s"], x["e"]) for x in spans[r["doc_id"]]):
            if s[1] > at:
                out += (text[at : s[0]] + "[SECRET]") if s[0] >= at else ""
                at = s[1]
        assert (after[r["doc_id"]]["text"] or "") == out + text[at:]
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"] or "")


def test_the_mix_holds_the_words_taken(stages):
    from tabloom.llm import mixing

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(stages[3]).collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert set(after) == {i for i, n in taken.items() if n}
    assert {i: len(re.findall("[^\x20\x09-\x0d]+", t)) for i, t in after.items()} == {i: n for i, n in taken.items() if n}


def test_the_mix_is_packed(stages, spark):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[4].collect()}
    assert valid(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert Counter(map(str, pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(map(str, stages[5].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_extra_columns_and_repeated_ids_go_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.limit(20).withColumn("text", F.concat("text", F.lit(" another text of one id")))
    docs = docs.unionByName(more).unionByName(docs.limit(5))
    extra = ["score", "size", "taken", "component_id", "kept", "id", "n", "print", "spans", "labels"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in extra})
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        assert docs.filter(" OR ".join(f"{c} <> concat('{c}', doc_id)" for c in extra)).count() == 0
    rows = pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert valid(rows, 2048) > 0 and {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_saving_gives_back_what_the_driver_has_freed(spark):
    sf = "/root/testdata/sf0.001"
    save(pipeline.keep_one_of_near_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "one")
    said = trim(spark)
    if not said:
        pytest.skip("this JVM can't")
    found = re.search(r"\(-(\d+)([BKMG])\)", said)
    assert not found or int(found[1]) * {"B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}[found[2]] < 16 << 20, said


def test_empty_and_odd_tables(spark):
    from .test_operators import DOCS, odd_rows

    for rows in ([], odd_rows()):
        docs = spark.createDataFrame(rows, DOCS).select(*pipeline.COLUMNS)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.filter(F.col("length") < 1).count() == 0
