"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

A text is cut into words (runs of ASCII letters and digits or of other
characters from U+0080) and signs (runs of other visible ASCII characters, kept
with any white space between them out).  N-grams of one to three words and signs, in
small letters, are hashed into 2 ** 20 weights.  Beside them, so that quality is seen
in words that training never met, stand n-grams of one to three items in which each
word is replaced by its shape (capitals, capitalised, small, digits, mixed; how long;
whether the word before is the same).  A feature's value is log(1 + count); the
vector is not scaled by the text's length.

Weights are learnt by follow-the-regularised-leader updates over a sample of at
most ``sample`` labelled texts of at most ``longest`` characters, which together have
at most ``volume``, taken in the order of a hash of their id; of several texts of an
id the shortest is taken.  A score is the logistic function of a sparse dot product,
worked out in parallel over whole texts of any length.

Null and empty texts have no features and score by the bias.  Null labels are
left out, repeated labels of an id count once (the largest).  Without labels all
score 0.5.  Repeated rows stay repeated; an empty table gives an empty result; extra
columns are ignored, or carried where ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MIX, U, chunks, runs, span_hash, splitmix

BITS = 20
#: Labelled texts that training reads at most, their characters each and together, and passes over them.
SAMPLE, LONGEST, VOLUME, EPOCHS = 8000, 100_000, 1 << 25, 4
ALPHA, BETA, L1, L2 = 0.08, 1.0, 0.02, 1.0
THRESHOLD = 0.3

_KIND = np.full(256, 4, np.uint8)  # 0 white space and controls, 1 small, 2 capital, 3 digit, 4 other letter, 5 sign
_KIND[:33] = 0
_KIND[127] = 0
_KIND[33:127] = 5
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 3, 2, 1


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts, sorted by text and feature."""
    kind = _KIND[data]
    word = (kind >= 1) & (kind <= 4)
    ws, we = runs(word, off)
    ss, se = runs(kind == 5, off)
    starts, ends = np.concatenate((ws, ss)), np.concatenate((we, se))
    is_word = np.concatenate((np.ones(len(ws), bool), np.zeros(len(ss), bool)))
    order = np.argsort(starts, kind="stable")
    starts, ends, is_word = starts[order], ends[order], is_word[order]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    own = span_hash(LOWER[data], starts, ends)
    count = [np.concatenate((np.zeros(1, np.int32), np.cumsum(kind == k, dtype=np.int32))) for k in (1, 2, 3)]
    small, capital, digit = (c[ends] - c[starts] for c in count)
    length = ends - starts
    first_capital = kind[starts] == 2
    shape = np.select([digit > 0, (capital > 0) & (small == 0) & (length > 1), (capital > 1), first_capital], [5, 1, 2, 3], 4)
    shape = shape * 4 + np.minimum(np.log2(length).astype(np.int64), 3)
    doc = np.searchsorted(off, starts, "right") - 1
    # a word that repeats the word before it, with nothing but signs between
    wi = np.flatnonzero(is_word)
    same = np.zeros(len(starts), bool)
    same[wi[1:]] = (own[wi[1:]] == own[wi[:-1]]) & (doc[wi[1:]] == doc[wi[:-1]])
    item = np.where(is_word, splitmix((shape * 2 + same).astype(np.uint64) + U(11)), own)
    grams = [splitmix(own ^ MIX[4]), item]
    docs = [doc, doc]
    for salt, items in ((0, item), (8, own)):
        for n in (2, 3):
            if len(items) >= n:
                g = sum(items[i : len(items) - n + 1 + i] * MIX[i] for i in range(n))
                inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
                grams.append(splitmix(g + U(n + salt))[inside])
                docs.append(doc[: len(doc) - n + 1][inside])
    gram = np.concatenate(grams) >> U(64 - BITS)
    key = (np.concatenate(docs).astype(np.uint64) << U(BITS)) | gram
    key, n = np.unique(key, return_counts=True)
    return (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64), np.log1p(n)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over (features, values, label)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, size), np.append(value.astype(np.float64), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], float(w[-1])


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, longest: int, volume: int) -> DataFrame:
    """id, text and label of the texts that training reads."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    # at most `sample` ids and labels, whatever the size of the tables
    own = F.broadcast(own.orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("n", F.length("text")).filter(F.col("n") <= longest)
    texts = texts.join(own, "id").groupBy("id", "label").agg(F.min(F.struct("n", "text")).alias("x"))
    upto = F.sum("x.n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return texts.withColumn("upto", upto).filter(F.col("upto") <= volume).select("id", "x.text", "label")


def _train(batches) -> Iterator:
    """(id, text, label) of the whole sample to the weights and the bias, as bytes."""
    import pyarrow as pa

    rows = []
    for batch in batches:
        label = batch.column(2).to_pylist()
        for part in chunks(batch.column(1)):
            doc, index, value = features(part.data, part.off)
            at = np.searchsorted(doc, np.arange(len(part) + 1)).tolist()
            rows += [(index[a:b].astype(np.int32), value[a:b].astype(np.float32), label[part.first + i]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    with np.errstate(over="ignore"):
        weights, bias = train_ftrl(rows)
    yield pa.RecordBatch.from_arrays([pa.array([np.append(weights, bias).astype("<f8").tobytes()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST, volume: int = VOLUME) -> tuple[np.ndarray, float]:
    """(weights, bias) learnt from at most `sample` labelled texts, in one task; the driver gets the weights alone."""
    rows = _sampled(docs, labels, id_col, text_col, label_col, sample, longest, volume)
    order = F.crc32(F.col("id").cast("string").cast("binary"))
    found = rows.repartition(1).sortWithinPartitions(order, "id").mapInArrow(_train, "model binary").first()
    model = np.frombuffer(bytes(found[0]), "<f8") if found is not None else np.zeros((1 << BITS) + 1)
    return model[:-1], float(model[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), name: str = "score") -> DataFrame:
    """id, the columns in keep, and the score (under name) of every text."""
    weights, bias = model[0].astype(np.float64), model[1]
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers
    names = list(dict.fromkeys([id_col, text_col, *keep]))
    out = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out) + ", `__score` double"

    def apply(batches) -> Iterator:
        import pyarrow as pa

        w = held.value
        for batch in batches:
            for part in chunks(batch.column(1)):
                doc, index, value = features(part.data, part.off)
                total = np.bincount(doc, w[index] * value, minlength=len(part)) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                cols = [batch.column(names.index(c)).slice(part.first, len(part)) for c in out]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p)], names=[*out, "__score"])

    return docs.select(*names).mapInArrow(apply, schema).withColumnRenamed("__score", name)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def op4_quality_classifier(spark, sf_dir):
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels.filter(fold() != 0)))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
