"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's logit is a bias plus weights of its words and word beginnings, hashed into buckets; the document's
score is the noisy-or of its sentences' probabilities.  Weights are trained from document labels alone, by gradient
descent on the likelihood of the noisy-or, and then point out the offending sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import kernel as K
from weft.llm.work import Work, binary_column, map_arrow, session_of, sum_counts

#: Most labelled documents of either class that the model is fitted on; which ones is decided by a hash of the id.
MAX_TOXIC, MAX_CLEAN = 10_000, 20_000
#: Hash buckets, beginnings of words in bytes, and buckets that get a weight (those that tell the classes apart most).
BUCKETS, PREFIXES, FEATURES = 1 << 20, (4, 5, 6), 4000
#: Least ratio of a bucket's log-odds to their standard error: words that a few documents happen to hold are left out.
CLEAR = 2.0
EPOCHS, RATE, DECAY = 300, 0.1, 1e-6
_END = np.zeros(256, bool)
_END[[33, 46, 63, 10]] = True  # ! . ? and line feed


@dataclass
class Model:
    weights: np.ndarray  # by bucket; bucket 0 stands for no feature
    bias: float


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket matrix of all words, sentence number of each word, first word of each document and the end).

    Sentence numbers grow by one or more from one sentence to the next, and never span documents.
    """
    starts, _, h, first = K.words(data, off, K.LETTERS, prefixes=PREFIXES)
    bucket = (h & K.U(BUCKETS - 1)).astype(np.int64)
    bucket[h == 0] = 0
    ends = np.cumsum(_END[data])
    number = ends[starts] + np.searchsorted(off, starts, "right") if len(starts) else starts
    return bucket, number, first


def logits(bucket: np.ndarray, number: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(first word, logit) of each sentence."""
    begin = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else np.zeros(0, np.int64)
    z = np.add.reduceat(model.weights[bucket].sum(axis=1), begin) if len(begin) else np.zeros(0)
    return begin, z + model.bias


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many clean and toxic documents have each bucket, in pieces."""
    counts = np.zeros((2, BUCKETS), np.uint32)
    for batch in batches:
        data, off = K.bytes_of(binary_column(batch.column("text")))
        bucket, _, first = sentences(data, off)
        for y, a, b in zip(batch.column("label").to_pylist(), first[:-1], first[1:], strict=True):
            counts[y][np.unique(bucket[a:b])] += 1
    if counts.any():
        pieces = np.split(counts, 16, axis=1)
        yield pa.record_batch({"slice": pa.array(range(16), pa.int32()), "counts": pa.array([p.tobytes() for p in pieces], pa.binary())})


def _selected(chosen) -> Callable:
    """(label, sentences, at, bucket): the chosen buckets of each document with the sentence that they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(BUCKETS, bool)
        keep[chosen.value] = True
        for batch in batches:
            data, off = K.bytes_of(binary_column(batch.column("text")))
            bucket, number, first = sentences(data, off)
            n, ats, buckets = [], [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                _, at = np.unique(number[a:b], return_inverse=True)
                n.append(int(at.max()) + 1 if b > a else 0)
                word, col = np.nonzero(keep[bucket[a:b]])
                ats.append(at[word].tolist())
                buckets.append(bucket[a:b][word, col].tolist())
            yield pa.record_batch({"label": batch.column("label"), "sentences": pa.array(n, pa.int32()), "at": pa.array(ats, pa.list_(pa.int32())), "bucket": pa.array(buckets, pa.list_(pa.int32()))})

    return run


def fit(label: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the noisy-or from (document, sentence, feature) triples; n counts sentences of documents.

    With p = 1 - exp(-sum of softplus(z) over sentences), sentences without features share z = bias.
    """
    order = np.lexsort((sentence, doc))
    doc, sentence, feature = doc[order], sentence[order], feature[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(doc))))
    owner = doc[new]
    plain = n - np.bincount(owner, minlength=len(n))  # sentences without features
    w, b = np.zeros(features), -6.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, EPOCHS + 1):
        z = np.bincount(of, w[feature], len(new)) + b
        s = np.bincount(owner, np.logaddexp(0, z), len(n)) + plain * np.logaddexp(0, b)
        # d loss / d s of loss = -y log(1 - exp(-s)) + (1 - y) s
        g = np.where(label == 1, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-6), 1.0) / len(n)
        gz = g[owner] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(feature, gz[of], features) + DECAY * w, (g * plain).sum() / (1 + np.exp(-b)) + gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fits on at most ``max_toxic`` and ``max_clean`` labelled documents, chosen by a hash of their id.

    Rows with a null id or label are left out; of several labels of an id the highest counts.  Without both classes
    the model's scores are all next to 0 or 1.
    """
    spark = session_of(docs)
    work = Work(spark, "toxicity")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((0, max_clean), (1, max_toxic))]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = work.keep(texts.join(F.broadcast(picked[0].union(picked[1])), "id").select("text", "label"))
    df = np.zeros((16, 2, BUCKETS // 16))
    for k, c in sum_counts(map_arrow(sample, _frequencies, "slice int, counts binary"), 16).items():
        df[k] = c.reshape(2, -1)
    df = df.transpose(1, 0, 2).reshape(2, BUCKETS)
    total = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = max(total.get(1, 0), 1), max(total.get(0, 0), 1)
    p, q = (df[1] + 0.5) / (pos + 1), (df[0] + 0.5) / (neg + 1)
    z = np.abs(np.log(p / q)) / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
    z[0] = 0
    chosen = np.sort(np.argpartition(-z, FEATURES)[:FEATURES])
    chosen = chosen[z[chosen] >= CLEAR]
    rows = map_arrow(sample, _selected(spark.sparkContext.broadcast(chosen)), "label int, sentences int, at array<int>, bucket array<int>").toArrow()
    weights, bias = np.zeros(BUCKETS, np.float32), -20.0
    if len(rows):
        label, n = rows.column("label").to_numpy(), rows.column("sentences").to_numpy()
        at, bucket = rows.column("at").combine_chunks(), rows.column("bucket").combine_chunks()
        doc = np.repeat(np.arange(len(n)), np.diff(at.offsets.to_numpy()))
        w, bias = fit(label, n, doc, at.flatten().to_numpy(), np.searchsorted(chosen, bucket.flatten().to_numpy()), len(chosen))
        weights[chosen] = w
    return Model(weights, bias)


SPAN = "array<struct<start:int,end:int,score:double>>"


def _score(model) -> Callable:
    span = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "score": pa.float64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.bytes_of(binary_column(batch.column("text")))
            bucket, number, first = sentences(data, off)
            begin, z = logits(bucket, number, model.value)
            of = np.searchsorted(first, begin, "right") - 1
            s = np.bincount(of, np.logaddexp(0, z), len(off) - 1)
            found: list[list[dict]] = [[] for _ in range(len(off) - 1)]
            for k in np.flatnonzero(z >= 0):
                found[of[k]].append(k)
            starts = K.words(data, off, K.LETTERS, hashes=False)[0] if any(found) else None
            for d, ks in enumerate(found):
                if ks:
                    text = data[off[d] : off[d + 1]]
                    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    stops = np.append(np.flatnonzero(_END[text]) + 1, len(text))
                    found[d] = [{"start": int(chars[a]), "end": int(chars[stops[np.searchsorted(stops, a, "right")]]), "score": float(1 / (1 + np.exp(-z[k])))} for k in ks for a in [starts[begin[k]] - off[d]]]
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(-np.expm1(-s)), "offending": pa.array(found, span)})

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending) for every row of ``docs``: the noisy-or, and the sentences that are more likely toxic than not.

    Sentences end at . ! ? or a line feed; offending ones have their characters [start, end) and probability.  Null texts and
    texts without words score 0.  Nothing but the text enters a score; repeated rows get equal scores.
    """
    spark = session_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, _score(spark.sparkContext.broadcast(model)), f"id {rows.schema['id'].dataType.simpleString()}, score double, offending {SPAN}")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
