"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

A document's set holds the distinct hashes of its word shingles.  Shingles are ordered rare first;
two sets with Jaccard similarity >= t share one of their n - ceil(t n) + 1 rarest elements, so only these
are joined, with length and positional filters on the posting and a suffix filter before the exact check.

The order is by a count sketch of *all* shingles of all documents (a fixed number of counters), ties by
hash.  Any total order gives the same links; the sketch makes passages that many documents share come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import kernel as K
from weft.llm.linkage import link_components, shared_postings
from weft.llm.work import BROADCAST_ROWS, Work, binary_column, map_arrow, session_of, sum_counts

#: Counters of the sketch; each task sends this many 32-bit numbers in SLICES pieces.
SKETCH, SLICES = 1 << 20, 8
#: Posting lists are split in blocks of about so many documents.
LIST = 20_000


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    data, off = K.bytes_of(binary_column(batch.column("text")))
    _, _, h, first = K.words(data, off)
    return K.shingles(h, first, k)


def _scan(k: int):
    """Rows (id, n, sid, more) of documents, two hashes of their sets, then the counters of the task's shingles in pieces (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            sets = _sets(batch, k)
            if sets:
                counts += np.bincount((np.concatenate(sets) & K.U(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            rows = len(sets)
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "th": batch.column("th"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sid": pa.array([K.set_hash(s) for s in sets], pa.int64()),
                    "more": pa.array([K.set_hash(s, 0x5A5A5A5A5A) for s in sets], pa.int64()),
                    "slice": pa.nulls(rows, pa.int32()),
                    "counts": pa.nulls(rows, pa.binary()),
                }
            )
        if counts.any():
            null = pa.nulls(SLICES, pa.int64())
            yield pa.record_batch({"id": null, "th": null, "n": null, "sid": null, "more": null, "slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([c.tobytes() for c in np.split(counts, SLICES)], pa.binary())})

    return run


def _sketch(parts: DataFrame) -> np.ndarray:
    out = np.zeros((SLICES, SKETCH // SLICES), np.uint64)
    for k, c in sum_counts(parts, SLICES).items():
        out[k] = c
    return np.minimum(out.reshape(-1), 0xFFFFFFFF).astype(np.uint32)


def place_of(freq: int, h: int) -> int:
    """A place in the order of elements in 19 bits, as it travels with every posting; near ones may have the same, which the filters allow for."""
    return int(np.float32(freq << 31 | h >> 33).view(np.int32)) >> 12


def _prefixes(k: int, t: int, sketch) -> Callable:
    """Postings of the rarest elements of each distinct set; a set is sent once by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sent = sketch.value, set()
        for batch in batches:
            keys, sids, ns, lasts, poss = [], [], [], [], []
            for s in _sets(batch, k):
                if not len(s) or (sid := K.set_hash(s)) in sent:
                    continue
                sent.add(sid)
                n = len(s)
                p = n - -(-t * n // 100) + 1
                freq = counts[(s & K.U(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((s, freq))
                keys.append(s[order[:p]])
                sids.append(np.full(p, sid))
                ns.append(np.full(p, n))
                end = order[p - 1]
                lasts.append(np.full(p, place_of(int(freq[end]), int(s[end]))))
                poss.append(np.arange(p))
            if not keys:
                continue
            key, sid = np.concatenate(keys), np.concatenate(sids)
            blocks = counts[(key & K.U(SKETCH - 1)).astype(np.int64)].astype(np.int64) // LIST
            salt = np.where(blocks > 0, (sid.view(np.uint64) >> K.U(7)).astype(np.int64) % (blocks + 1), -1)
            yield pa.record_batch({"key": key.view(np.int64), "salt": salt, "id": sid, "n": np.concatenate(ns), "last": np.concatenate(lasts), "pos": np.concatenate(poss)})

    return run


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """|a & b| of sorted distinct arrays; may stop below ``need`` once the suffix filter shows it is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) > 64:  # suffix filter: split both at the middle element, bound the two sides
        m = len(b) // 2
        i = int(np.searchsorted(a, b[m]))
        if min(i, m) + min(len(a) - i, len(b) - m) < need:
            return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def prefix_length(t: int) -> Column:
    return F.expr(f"n - (n * {t} + 99) div 100 + 1")


def _family(k: int, t: int):
    """All pairs: whether they are linked, a's size, what a shares with b, and a's other elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_sets(batch.select([c]).rename_columns(["text"]), k) for c in ("text_a", "text_b"))
            extras = [np.setdiff1d(x, y, assume_unique=True) for x, y in zip(a, b, strict=True)]
            n = np.array([len(x) for x in a], np.int64)
            both = n - np.array([len(e) for e in extras], np.int64)
            good = (both > 0) & (100 * both >= t * (n + np.array([len(y) for y in b], np.int64) - both))
            extras = pa.array([e.view(np.int64) for e in extras], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good), pa.array(n), pa.array(both), extras], ["a", "b", "linked", "n", "c", "extras"])

    return run


def _verify(k: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_sets(batch.select([c]).rename_columns(["text"]), k) for c in ("text_a", "text_b"))
            good = [100 * (c := overlap(x, y, -(-t * (len(x) + len(y)) // (100 + t)))) >= t * (len(x) + len(y) - c) and c > 0 for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def sizes_match(t: int) -> Column:
    """Length filter for Jaccard >= t/100, also with cap for n on the side whose prefix ends first in the order.

    An element of that prefix that is in no other prefix can't be anywhere in the other set.
    """
    return F.expr(f"least(n1, n2) * 100 >= greatest(n1, n2) * {t} and case when last1 < last2 then cap1 when last1 > last2 then cap2 else greatest(cap1, cap2) end * {100 + t} >= (n1 + n2) * {t}")


def places_match(t: int) -> Column:
    """Positional filter: elements up to a shared one that are in any other prefix, and those after it.

    Elements of either prefix up to a shared one would be in the other prefix if they were in the other set.
    """
    return F.expr(f"(least(rank1, rank2) + 1 + least(n1 - pos1 - 1, n2 - pos2 - 1)) * {100 + t} >= (n1 + n2) * {t}")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z taken as a-z.  Two documents are linked when
    100 * |intersection| >= threshold * |union| of their distinct k-word shingles (whole sequence if shorter).
    component_id is the smallest id reachable by links, the row's own id if there are none.  Null or wordless
    texts have an empty set and no links.  Sets are told apart by 128 bits and linked by 64; different ones that agree in these
    64 bits link nothing.  A row with null id has a null component and links nothing.  Rows that repeat
    an id are each returned and link as that id.  Other columns are ignored, whatever their names.
    """
    spark = session_of(docs)
    work = Work(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    scan = work.keep(map_arrow(docs, _scan(k), "id long, th long, n long, sid long, more long, slice int, counts binary"))
    rows = scan.where("slice is null").select("id", "th", "n", "more", F.expr("if(n > 0, sid, null)").alias("sid"))
    sketch = spark.sparkContext.broadcast(_sketch(scan.where("slice is not null")))
    classes = work.keep(rows.where("n > 0 and id is not null").groupBy("sid").agg(F.min(F.struct("id", "th")).alias("rep"), F.min("more").alias("low"), F.max("more").alias("top")).where("low = top").drop("low", "top"))
    postings = map_arrow(docs.where("id is not null"), _prefixes(k, threshold, sketch), "key long, salt long, id long, n long, last long, pos long")

    def texts(ids: DataFrame, n: int) -> DataFrame:
        reps = classes.join(ids, F.col("sid") == F.col("id"), "left_semi").select("sid", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
        found = docs.join(F.broadcast(reps) if n <= BROADCAST_ROWS else reps, ["id", "th"])
        return found.select(F.col("sid").alias("id"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        return map_arrow(pairs, _verify(k, threshold), "a long, b long")

    def family(pairs: DataFrame) -> DataFrame:
        return map_arrow(pairs, _family(k, threshold), "a long, b long, linked boolean, n long, c long, extras array<long>")

    comps = link_components(work, shared_postings(postings, threshold), texts, verify, prefix_length(threshold), sizes_match(threshold), places_match(threshold), family, threshold, by_size=False)
    comps = work.keep(comps.join(classes, comps["id"] == classes["sid"]).select("sid", "component", F.col("rep.id").alias("rep")))
    least = comps.groupBy("component").agg(F.min("rep").alias("least"))
    linked = comps.join(least, "component").select("sid", "least")
    of_class = classes.join(linked, "sid", "left").select("sid", F.coalesce("least", "rep.id").alias("component_id"))
    out = rows.join(of_class, "sid", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
