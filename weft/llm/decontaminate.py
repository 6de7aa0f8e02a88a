"""Benchmark decontamination with one Aho-Corasick automaton over word windows of the test items.

Texts are normalised byte by byte (A-Z to a-z, bytes that aren't part of a word to a space), so every word of the
normalised text stands where it stood; hits map back to characters of the original.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.work import binary_column, map_arrow, session_of

#: Words of test items in one automaton; a larger benchmark is scanned for in several passes.
WORDS_AT_ONCE = 2_000_000

#: Bytes of words: digits, letters and everything beyond ASCII.  Others become spaces.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: A name and a broadcast list of (item id, text).
Block = tuple[str, Broadcast]
_built: dict[tuple, ahocorasick.Automaton] = {}

SCHEMA = "uid long, doc_id {0}, n_words long, hits array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(words: list[bytes], size: int) -> list[str]:
    """The windows of an item, each with a space before, between and after its words."""
    if not words:
        return []
    n = min(size, len(words))
    return [f" {b' '.join(words[i : i + n]).decode('latin-1')} " for i in range(len(words) - n + 1)]


def automaton(items: list[tuple[str | None, bytes]], size: int) -> ahocorasick.Automaton | None:
    """All windows of (item id, text); a window's value is its word count and the ids of the items that have it."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(normal_words(text), size):
            found.setdefault(w, set()).update([] if item is None else [item])
    if not found:
        return None
    out = ahocorasick.Automaton()
    for w, ids in found.items():
        out.add_word(w, (w.count(" ") - 1, tuple(ids)))
    out.make_automaton()
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def scan(text: bytes, auto: ahocorasick.Automaton | None) -> tuple[int, list[dict], list[str]]:
    """Number of words, the runs of hit words (word numbers, and characters of the original), sorted item ids."""
    flat = text.translate(_NORMAL)
    words = flat.split()
    if auto is None or not words:
        return len(words), [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    ends = list(auto.iter(line))
    if not ends:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    change, items = np.zeros(len(words) + 1, np.int64), set()
    last = np.searchsorted(spaces, [e for e, _ in ends]) - 1
    for at, (_, (n, ids)) in zip(last.tolist(), ends, strict=True):
        change[at - n + 1] += 1
        change[at + 1] -= 1
        items.update(ids)
    first, final = _runs(np.cumsum(change[:-1]) > 0)
    spans = [m.span() for m in _WORD.finditer(flat)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    hits = [{"first": a, "last": b, "start": int(chars[spans[a][0]]), "end": int(chars[spans[b][1]])} for a, b in zip(first.tolist(), final.tolist(), strict=True)]
    return len(words), hits, sorted(items)


def ready(items: Block, size: int) -> ahocorasick.Automaton | None:
    """The automaton of a broadcast block, built once in a worker process."""
    key = (items[0], size)
    if key not in _built:
        _built.clear()
        _built[key] = automaton(items[1].value, size)
    return _built[key]


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """Broadcasts of (item id, text), each of about WORDS_AT_ONCE words at most."""
    spark = items.sparkSession
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    blocks = max(1, -(-total // WORDS_AT_ONCE))
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in part.collect()])


def _pass(items: Block, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ready(items, size)
        for batch in batches:
            got = [scan(t.as_py(), auto) for t in binary_column(batch.column("text"))]
            columns = [batch.column("uid"), batch.column("doc_id"), *(pa.array([g[i] for g in got], _TYPES.field(n).type) for i, n in enumerate(("n_words", "hits", "items")))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_words", "hits", "items"])

    return run


_TYPES = pa.schema({"n_words": pa.int64(), "hits": pa.list_(pa.struct({"first": pa.int64(), "last": pa.int64(), "start": pa.int64(), "end": pa.int64()})), "items": pa.list_(pa.string())})


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, hits, items.

    An item's windows are its runs of ``size`` words, or all its words if it has fewer; a word of a document is hit if it
    is part of any occurrence of a window.  ``hits`` are the maximal runs of hit words with their characters
    [start, end) in the original; ``items`` the sorted ids of items with an occurring window.  Null and wordless texts have
    no words and no hits; null or wordless items no windows; an item with null id marks words but isn't listed.
    Repeated rows are scanned each.  Other columns are ignored, whatever their names.
    """
    spark = session_of(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    blocks = list(item_blocks(items, item_col, item_text_col))
    for block in blocks:
        one = map_arrow(rows, _pass(block, size), SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))
        found = one if found is None else found.union(one)
    if len(blocks) > 1:
        merged = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = merged.withColumn("hits", merge_runs("hits"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    out = found.select("uid", F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "hits", "items")
    return out.drop("uid")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any window of ``items``, all columns as they are; null texts stay."""
    session_of(docs)

    def filtered(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = ready(block, size)
            for batch in batches:
                clean = [not scan(t.as_py(), auto)[1] for t in binary_column(batch.column(text_col))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in item_blocks(items, item_col, item_text_col):
        docs = docs.mapInArrow(filtered(block), docs.schema)
    return docs


def merge_runs(col: str):
    """Union of runs of words that several passes found in one document."""
    return F.expr(
        f"""aggregate(array_sort({col}), cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>), (done, h) ->
        if(size(done) > 0 and element_at(done, -1).last >= h.first,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).first as first, greatest(element_at(done, -1).last, h.last) as last,
             element_at(done, -1).start as start, greatest(element_at(done, -1).end, h.end) as end))),
           concat(done, array(h))))"""
    )


DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), o AS (
  SELECT uid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))
), h AS (
  SELECT o.uid, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.win = p.win
), c AS (
  SELECT uid, count(DISTINCT pos) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY uid
), t AS (
  SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY uid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (uid) LEFT JOIN t USING (uid)
"""
