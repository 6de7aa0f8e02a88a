"""Language identification by Bayesian fusion of evidence.

The likelihood of a text under each language comes from byte trigrams, counted over all labelled texts.  It is
combined with what the page declares (the markup's lang attribute), its address (top-level domain, first part of the path)
and a prior of its host.  Host priors are shares of languages, by text alone, among the host's other pages, smoothed
towards those of its domain, which are smoothed towards all pages; they come from grouped aggregation.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernel as K
from weft.llm.work import Work, binary_column, map_arrow, session_of, spread_join, steady, sum_counts

#: Most languages that are told apart (texts of all further ones train one language, OTHER), and hash buckets of trigrams.
MAX_LANGUAGES, BUCKETS, OTHER = 200, 1 << 16, "other"
#: Neighbouring trigrams aren't independent: their log-likelihoods count a tenth each.
TEMPER = 0.1
#: Probability that a declared language, or an address, says another language than the page's.
WRONG_DECLARED, WRONG_ADDRESS = 0.1, 0.2
#: Pages that a domain's prior, and that of all pages, count for.
STRENGTH = 5.0
#: Least posterior probability of the language.
LEAST = 0.6
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of trigrams that hold a letter, and where each text's begin (and the end).  Non-letters count as one space each."""
    c = _CLASS[data].astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    good = (c[1:-1] != 32) & ((c[:-2] != 32) | (c[2:] != 32))
    for j in (1, 2):
        at = off[1:-1] - j
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    return bucket[at], np.searchsorted(at, off)


def _counts(languages: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        total = np.zeros((len(languages), BUCKETS), np.uint32)
        for batch in batches:
            data, off = K.bytes_of(binary_column(batch.column("text")))
            bucket, begin = trigrams(data, off)
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for k in np.unique(own):
                mine = np.repeat(own == k, np.diff(begin))
                total[k] += np.bincount(bucket[mine], minlength=BUCKETS).astype(np.uint32)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch({"slice": pa.array(some, pa.int32()), "counts": pa.array([total[k].tobytes() for k in some], pa.binary())})

    return run


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (by number of texts, at most MAX_LANGUAGES, then OTHER) and their log-probabilities of trigrams, from all labelled texts."""
    session_of(texts)
    rows = texts.select(F.col(text_col).cast("string").alias("text"), F.lower(F.trim(F.col(lang_col).cast("string"))).alias("lang")).where("text is not null and lang != ''")
    languages = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        languages = [x for x in languages[:MAX_LANGUAGES] if x != OTHER] + [OTHER]
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(languages), F.col("lang")).otherwise(OTHER))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        for k, c in sum_counts(map_arrow(rows, _counts(languages), "slice int, counts binary"), len(languages)).items():
            counts[k] = c
    return languages, np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)


_TAG = re.compile(rb"<([a-z][a-z0-9]*)")
_DROPPED = {b"script", b"style", b"nav", b"header", b"footer", b"aside", b"noscript"}
_ASIDE = re.compile(rb"class=[\"']?(?:ad|ads|menu|banner)\b")
_LANG = re.compile(rb"\blang\s*=\s*[\"']?\s*([a-z]+)")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(?:/([^/?#]*))?")
#: Top-level domains that say a language (fixed values); others say nothing.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}


def visible(page: bytes) -> tuple[bytes, str | None]:
    """(text without markup and without parts that aren't the main text, declared language), in one pass from left to right."""
    low = page.translate(bytes(K.LOWER.tolist()))
    out, at, never, said = [], 0, set(), None

    def after(mark: bytes, start: int) -> int:
        """Where the next ``mark`` ends, or -1; what isn't found once isn't looked for again."""
        found = -1 if mark in never else low.find(mark, start)
        if found < 0:
            never.add(mark)
            return -1
        return found + len(mark)

    while (i := low.find(b"<", at)) >= 0:
        out += [page[at:i], b" "]
        tag, end = _TAG.match(low, i), -1
        name = tag.group(1) if tag else b""
        if low.startswith(b"<!--", i):
            end = after(b"-->", i + 4)
        close = after(b">", i)
        if name in (b"html", b"div") and close >= 0:
            if name == b"html" and said is None and (found := _LANG.search(low, i, close)):
                said = found.group(1).decode()
            name = b"div" if name == b"div" and _ASIDE.search(low, i, close) else b""
        elif name not in _DROPPED:
            name = b""
        if name and (end := after(b"</" + name, i)) >= 0:
            end = after(b">", end)
        end = end if end >= 0 else close
        if end < 0:  # a tag that never ends is text
            return b"".join([*out, page[i:]]), said
        at = end
    return b"".join([*out, page[at:]]), said


def parse_page(url: str | None, page: str | None) -> tuple[str, str | None, str | None, str | None]:
    """(visible main text, declared language, host, language that the address says)."""
    text, declared = visible((page or "").encode("utf-8", "replace"))
    address = _HOST.match(url or "")
    host = address.group(1).lower() if address else None
    part = (address.group(2) or "").lower() if address else ""
    says = part if part in SUFFIXES.values() else SUFFIXES.get(host.rsplit(".", 1)[-1]) if host else None
    return html.unescape(text.decode("utf-8", "replace")), declared, host, says


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; zeros for null."""
    out, there = np.zeros((len(col), width)), np.asarray(col.is_valid())
    out[there] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    """Probabilities from logs, by row."""
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _evidence(languages: list[str], model, pages: bool) -> Callable:
    """(uid, id, host, domain, n, by_text, rest, p): log-likelihoods by text and by the other evidence, and probabilities by text, for each language."""

    def logs(said: list[str | None], wrong: float) -> np.ndarray:
        number = {x: i for i, x in enumerate(languages)}
        out = np.zeros((len(said), len(languages)))
        for i, x in enumerate(said):
            if x in number and len(languages) > 1:
                out[i] = np.log(wrong / (len(languages) - 1))
                out[i, number[x]] = np.log(1 - wrong)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            if pages:
                found = [parse_page(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("text").to_pylist(), strict=True)]
                text = pa.array([f[0].encode("utf-8", "replace") for f in found], pa.large_binary())
                declared, host, says = ([f[k] for f in found] for k in (1, 2, 3))
            else:
                text, declared, host, says = binary_column(batch.column("text")), [None] * batch.num_rows, batch.column("url").to_pylist(), [None] * batch.num_rows
            data, off = K.bytes_of(text)
            bucket, begin = trigrams(data, off)
            by_text = np.zeros((len(off) - 1, len(languages)))
            of = np.repeat(np.arange(len(off) - 1), np.diff(begin))
            for k in range(len(languages)):
                by_text[:, k] = TEMPER * np.bincount(of, table[k][bucket], len(off) - 1)
            rest = logs(declared, WRONG_DECLARED) + logs(says, WRONG_ADDRESS)
            domain = [None if h is None else ".".join(h.split(".")[-2:]) for h in host]
            columns = {"host": pa.array(host, pa.string()), "domain": pa.array(domain, pa.string()), "n": pa.array(np.diff(begin), pa.int64()), "by_text": _list(by_text), "rest": _list(rest), "p": _list(_normal(by_text))}
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), *columns.values()], ["uid", "id", *columns])

    return run


def _fuse(languages: list[str], prior: np.ndarray) -> Callable:
    """(uid, id, host, lang, confidence, n): what the others of its host and domain say is the prior; a row's own part is taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            own = np.where(n[:, None] > 0, _matrix(batch.column("p"), len(languages)), 0)
            by = np.broadcast_to(prior, own.shape)
            for level in ("domain_sums", "host_sums"):
                there = np.asarray(batch.column(level).is_valid())[:, None]
                others = np.maximum(_matrix(batch.column(level), len(languages)) - own, 0)
                by = np.where(there, (others + STRENGTH * by) / (others.sum(axis=1, keepdims=True) + STRENGTH), by)
            post = _normal(np.log(by) + _matrix(batch.column("by_text"), len(languages)) + _matrix(batch.column("rest"), len(languages)))
            best = post.argmax(axis=1)
            lang = pa.array([languages[k] if m > 0 else None for k, m in zip(best, n, strict=True)], pa.string())
            sure = pa.array(np.where(n > 0, post[np.arange(len(n)), best], 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), batch.column("host"), lang, sure], ["uid", "id", "host", "lang", "confidence"])

    return run


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text_col: str, place_col: str | None, pages: bool = False, least: float = LEAST) -> DataFrame:
    """(uid, id, host, lang, confidence, rejected) for every row; ``uid`` is the row's number in the input.

    With ``pages`` the text is markup and ``place_col`` an address, which give the text, the declared language, the host and
    its domain; else the text is plain and ``place_col`` (if any) names its source, which stands for the host.  A row is rejected
    if its text has no letters (null and empty texts) or no language reaches ``least``; lang is then null, or the best
    guess.  A null place has the prior of all rows.  Without languages every row is rejected.  Extra columns are ignored.
    """
    languages, table = model
    spark = session_of(rows)
    work = Work(spark, "langid")
    rows = steady(work, rows)
    place = F.col(place_col).cast("string") if place_col else F.lit(None).cast("string")
    plain = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), place.alias("url"))
    if not languages:
        return plain.select("uid", "id", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"uid long, id {kind}, host string, domain string, n long, by_text array<double>, rest array<double>, p array<double>"
    seen = work.keep(map_arrow(plain, _evidence(languages, spark.sparkContext.broadcast(table), pages), schema))
    some = seen.where("n > 0")
    sums = F.array(*[F.sum(F.element_at("p", k + 1)) for k in range(len(languages))])
    total = np.array([x or 0.0 for x in some.agg(sums).first()[0]])
    prior = (total + 1.0) / (total.sum() + len(languages))
    joined = seen
    for c in ("host", "domain"):
        joined = spread_join(joined, work.keep(some.where(F.col(c).isNotNull()).groupBy(c).agg(sums.alias(f"{c}_sums"))), c)
    found = map_arrow(joined, _fuse(languages, prior), f"uid long, id {kind}, host string, lang string, confidence double")
    return found.withColumn("rejected", F.col("lang").isNull() | (F.col("confidence") < least))
