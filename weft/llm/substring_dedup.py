"""Substring deduplication by hashing whole sentences, lines or paragraphs.

Units are normalised, their digests grouped over all documents, and the earliest ranked occurrence is kept.  Neighbouring
units that aren't the earliest form runs; runs with enough words are returned (or cut out) with their places in the
original text.  Passages are often set into other lines, so lines are cut further at the ends of sentences by default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernel as K
from weft.llm.work import Work, binary_column, free_name, map_arrow, numbered, session_of, steady

_LOWER = bytes(K.LOWER.tolist())
#: A unit with what separates it from the next one; matches follow each other without gaps.
_UNIT = {
    "sentence": re.compile(rb"[^.!?\n]*(?:[.!?][^.!? \t\n\r\f\v][^.!?\n]*)*(?:[.!?]+[ \t\n\r\f\v]*|\n|$)"),
    "line": re.compile(rb"[^\n]*(?:\n|$)"),
    "paragraph": re.compile(rb"(?:[^\n]+(?:\n(?![ \t\r]*\n)|$)?)+(?:\n[ \t\r\n]*)?|\n[ \t\r\n]*"),
}
#: Runs of fewer words are left alone: short sentences recur by chance.
MIN_WORDS = 25
#: A unit that makes up one in so many is frequent.
OFTEN = 100_000
_BLANK = b" \t\n\r\f\v"


def units(text: bytes, unit: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, normalised text) of the units with words, in bytes, without white space around them."""
    low = text.translate(_LOWER)
    for m in _UNIT[unit].finditer(low):
        words = m.group().split()
        if words:
            part = m.group()
            yield m.start() + len(part) - len(part.lstrip(_BLANK)), m.start() + len(part.rstrip(_BLANK)), len(words), b" ".join(words)


def _digests(unit: str) -> Callable:
    names = ["uid", "id", "unit", "start", "end", "n_words", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, got = [], []
            for i, value in enumerate(binary_column(batch.column("text"))):
                text = value.as_py()
                chars = None if text.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                for k, (start, end, n, norm) in enumerate(units(text, unit)):
                    if chars is not None:
                        start, end = int(chars[start]), int(chars[end])
                    digest = xxhash.xxh3_128_intdigest(norm)
                    rows.append(i)
                    got.append((k, start, end, n, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
            if got:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("uid").take(at), batch.column("id").take(at), *(pa.array(c, pa.int64()) for c in zip(*got, strict=True))], names)

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, id, start, end, n_units, n_words, kept_id, kept_start): runs of units that are repeated from elsewhere.

    A unit is a sentence (up to . ! ? and white space, or a line's end), a line, or a paragraph between blank lines; two are
    equal if their words are, A-Z taken as a-z.  Occurrences are ranked by id (null last), then place, then ``uid``, the row's
    number in the input, which tells rows that repeat an id apart.  A run is of neighbouring units none of which is the
    earliest of its kind, with at least ``min_words`` words together; kept_id and kept_start are of the earliest
    occurrence of its first unit.  [start, end) are characters of the original.  Null and empty texts have no units; repeats
    within one document count.  Other columns are ignored, whatever their names.
    """
    work = Work(session_of(docs), "units")
    rows = steady(work, docs).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = work.keep(map_arrow(rows, _digests(unit), "uid long, id long, unit long, start long, end long, n_words long, h1 long, h2 long"))
    rank = F.struct(F.col("id").isNull().alias("null"), "id", "start", "uid")
    firsts = work.keep(found.groupBy("h1", "h2").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    # Units that make up one in OFTEN of all or more, so at most OFTEN, are broadcast: none of them is gathered in one task.
    often = F.col("n") >= max(1000, found.count() // OFTEN)
    heavy = F.broadcast(firsts.where(often).drop("n"))
    again = found.join(heavy, ["h1", "h2"]).union(found.join(heavy, ["h1", "h2"], "left_anti").join(firsts.where(~often).drop("n"), ["h1", "h2"]))
    again = work.keep(again.where((F.col("start") != F.col("kept.start")) | (F.col("uid") != F.col("kept.uid"))).drop("h1", "h2"))
    runs = again.withColumn("run", F.expr("unit - row_number() over (partition by uid order by unit)"))
    out = runs.groupBy("uid", "run").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("n_words").alias("n_words"), F.min_by("kept", "unit").alias("kept"))
    out = out.where(F.col("n_words") >= min_words)
    return out.select("uid", "id", "start", "end", "n_units", "n_words", F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start"))


def _cut(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
        while at < len(text) and text[at] in " \t\r\n":  # what separated it from the next unit
            at += 1
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated run cut out of its text; ``__removed`` lists their original places.

    Rows, their order aside, and all other columns stay, but for one that is called ``__removed`` already, which is
    replaced; ``__removed`` is empty where nothing was cut.
    """
    docs = steady(Work(session_of(docs), "rows"), docs.drop("__removed"))
    uid = free_name(docs, "__uid")
    spans = repeated_units(docs, id_col, text_col, unit, min_words).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__removed"))
    both = numbered(docs, uid).join(spans.withColumnRenamed("uid", uid), uid, "left").drop(uid)
    both = both.withColumn(text_col, F.col(text_col).cast("string")).withColumn("__removed", F.coalesce("__removed", F.array().cast("array<struct<start:bigint,end:bigint>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [_cut(t, s) if t and s else t for t, s in zip(batch.column(at).to_pylist(), batch.column("__removed").to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_arrow(both, run, both.schema)


REPEATS_SQL = r"""
WITH p AS (
  SELECT doc_id, uid, unnest(parts) AS part, unnest(range(len(parts))) AS k
  FROM (SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(text, '[^.!?\n]*(?:[.!?][^.!? \t\n\r\f\v][^.!?\n]*)*(?:[.!?]+[ \t\n\r\f\v]*|\n|$)') AS parts FROM documents)
), u AS (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY uid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs,
    regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM p
), n AS (
  SELECT doc_id, uid, row_number() OVER (PARTITION BY uid ORDER BY k) AS unit, ofs + length(regexp_extract(part, '^[ \t\n\r\f\v]*')) AS start, ofs + length(regexp_replace(part, '[ \t\n\r\f\v]*$', '')) AS "end",
    len(w) AS words, array_to_string(w, ' ') AS norm
  FROM u WHERE len(w) > 0
), r AS (
  SELECT *, row_number() OVER same AS nth, first_value(doc_id) OVER same AS kept_doc_id, first_value(start) OVER same AS kept_start
  FROM n WINDOW same AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, start, uid)
), g AS (
  SELECT *, unit - row_number() OVER (PARTITION BY uid ORDER BY unit) AS run FROM r WHERE nth > 1
)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words,
  arg_min(kept_doc_id, unit) AS kept_doc_id, CAST(arg_min(kept_start, unit) AS BIGINT) AS kept_start
FROM g GROUP BY doc_id, uid, run HAVING sum(words) >= 25
"""
