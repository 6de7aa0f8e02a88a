"""Fuzzy line deduplication: MinHash bands, exact Jaccard check, components, one line kept per component.

Lines are normalised and equal ones collapsed by hash.  A line's set holds its character shingles.  Lines with many
shingles get a one-permutation MinHash (every shingle falls in one of the bins), those with few a MinHash
with a permutation for each place, as their bins would be empty; in between both, so that lines of 0.8 times
the size still meet.  Bands of the signature are the postings; linkage compares candidates exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernel as K
from weft.llm.linkage import LONGS, link_components
from weft.llm.work import BROADCAST_ROWS, Work, binary_column, free_name, map_arrow, numbered, session_of, steady

#: Characters in a shingle.
SHINGLE = 8
#: Bands and their rows: lines of Jaccard 0.8 meet with probability 0.998, of 0.85 with 0.9998.
BANDS, ROWS = 12, 4
PLACES = BANDS * ROWS
#: Lines with up to FEW shingles have a permutation for each place; from MANY = 0.8 * 0.8 * FEW on one for all.
FEW, MANY = 160, 102
#: One line in so many tells which bands are frequent; it decides how postings are dealt, not what is found.
ONE_IN = 64
#: Posting lists are split in blocks of about so many lines.
LIST = 20_000
#: Distinct lines whose bands travel together, and lines to a range of bands.
SENT, BUCKET = 40_000, 100_000
_LOWER = bytes(K.LOWER.tolist())
_MULTIPLIERS = K.mix(np.arange(1, PLACES + 1, dtype=np.uint64) * K.U(0xC2B2AE3D27D4EB4F)) | K.U(1)
with np.errstate(over="ignore"):
    _P2 = K._P * K._P
    _P4 = _P2 * _P2


def normal(line: str) -> str:
    return " ".join(line.split())


#: White space other than a line feed or a space, which :func:`normal` would change: bytes of ASCII, and characters beyond it.
_ODD = bytes(c for c in range(128) if chr(c).isspace() and chr(c) not in " \n")
_WIDE = [chr(c) for c in range(128, 1 << 16) if chr(c).isspace()]


def lines_of(text: bytes) -> list[str]:
    """Lines, A-Z as a-z, white space collapsed; blank ones are empty."""
    low = text.translate(_LOWER, _ODD)
    uneven = len(low) < len(text) or b"  " in low
    low = (text.translate(_LOWER) if uneven else low).decode("utf-8", "replace")
    if uneven or (not low.isascii() and any(c in low for c in _WIDE)):
        return [normal(x) for x in low.split("\n")]
    return [x.strip(" ") for x in low.split("\n")]


def digests(lines: list[str]) -> np.ndarray:
    """128-bit digests of lines as two longs each; the first is the line's id."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in lines]), np.int64).reshape(-1, 2)


#: Characters whose signatures are taken at once.
CHUNK = 1 << 17
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_CODES = K.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * K._P)


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """K.mix in place; ``more`` is overwritten."""
    for shift, factor in ((30, K.U(0xBF58476D1CE4E5B9)), (27, K.U(0x94D049BB133111EB)), (31, None)):
        h ^= np.right_shift(h, K.U(shift), out=more)
        if factor is not None:
            h *= factor
    return h


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of the lines, padded and joined; where each line's shingles begin, and how many there are."""
    size = np.array([len(x) for x in lines], np.int64)
    pad = "\0" * SHINGLE
    code = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    if code.max() <= 0xFFFF:
        h = _CODES.take(code)
    else:
        h = _CODES.take(code & 0xFFFF)
        h += (code >> 16).astype(np.uint64) * _P2
    more = np.empty_like(h)
    for step, power in ((1, K._P), (2, _P2), (4, _P4)):
        h[:-step] += np.multiply(h[step:], power, out=more[step:])
    return _mixed(h, more), np.concatenate([[0], np.cumsum(size + SHINGLE)])[:-1], np.maximum(size - SHINGLE + 1, 1)


def char_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines that aren't empty, one after the other, and where each line's begin (and the end)."""
    h, first, count = _hashes(lines)
    begin = np.concatenate([[0], np.cumsum(count)])
    return h[np.repeat(first - begin[:-1], count) + np.arange(begin[-1])], begin


def _few(lines: list[str]) -> np.ndarray:
    """Signatures with a permutation for each place."""
    h, first, count = _hashes(lines)
    ends = np.minimum(first + count, len(h) - 1)
    at = np.stack([first, ends], axis=1).reshape(-1)
    sig = np.empty((len(lines), PLACES), np.uint64)
    for j in range(PLACES):
        sig[:, j] = np.minimum.reduceat(h * _MULTIPLIERS[j], at)[::2]
    return sig


def _many(lines: list[str]) -> np.ndarray:
    """Signatures with one permutation, whose values fall in as many bins as there are places."""
    h, first, count = _hashes(lines)
    width = np.diff(np.append(first, len(h)))
    bin_ = (((h >> K.U(32)) * K.U(PLACES)) >> K.U(32)).astype(np.int64)
    h *= _MULTIPLIERS[0]
    h[(first + count)[:, None] + np.arange(2 * SHINGLE - 1)] = _NONE  # windows that reach over a line's end, into the next one too
    sig = np.full(len(lines) * PLACES, _NONE)
    np.minimum.at(sig, np.repeat(np.arange(len(lines)) * PLACES, width) + bin_, h)
    sig = sig.reshape(-1, PLACES)
    empty = sig == _NONE
    for step in range(1, PLACES):  # an empty bin borrows from the next one that isn't
        if not empty.any():
            break
        shifted, was = np.roll(sig, -1, axis=1), np.roll(empty, -1, axis=1)
        take = empty & ~was
        sig = np.where(take, shifted + K.U(step), sig)
        empty &= ~take
    return ~sig  # another family


def _chunks(lines: list[str], which: np.ndarray) -> Iterator[np.ndarray]:
    size = np.cumsum([len(lines[i]) for i in which])
    yield from np.split(which, np.flatnonzero(np.diff(size // CHUNK)) + 1) if len(which) else ()


def bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line numbers, band keys) of lines that aren't empty."""
    count = np.array([max(len(x) - SHINGLE + 1, 1) for x in lines], np.int64)
    owner, keys, w = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], K._weights(ROWS)
    for signature, which in ((_few, count <= FEW), (_many, count >= MANY)):
        for part in _chunks(lines, np.flatnonzero(which)):
            sig = signature([lines[i] for i in part])
            band = np.arange(BANDS, dtype=np.uint64)
            keys.append((K.mix((K.mix(sig.reshape(-1, BANDS, ROWS)) * w).sum(axis=2) + band) & ~K.U(15) | band).reshape(-1))  # the band is in the last four bits
            owner.append(np.repeat(part, BANDS))
    return np.concatenate(owner), np.concatenate(keys).view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[list[str]]:
    for t in binary_column(batch.column("text")):
        yield lines_of(t.as_py())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, id, line, lid, more) of all lines that aren't blank, ``more`` being the digest's rest; for one id in ONE_IN, (lid, key) of its bands."""
    for batch in batches:
        rows, lines, texts = [], [], []
        for i, doc in enumerate(_texts(batch)):
            own = [k for k, x in enumerate(doc) if x]
            rows.append(np.full(len(own), i))
            lines += own
            texts += [x for x in doc if x]
        if not texts:
            continue
        lid, more = digests(texts).T
        at = pa.array(np.concatenate(rows), pa.int64())
        yield pa.record_batch({"uid": batch.column("uid").take(at), "id": batch.column("id").take(at), "line": pa.array(lines, pa.int64()), "lid": pa.array(lid), "more": pa.array(more), "key": pa.nulls(len(at), pa.int64())})
        some, first = np.unique(lid[lid % ONE_IN == 0], return_index=True)
        owner, key = bands([texts[i] for i in np.flatnonzero(lid % ONE_IN == 0)[first]])
        null = pa.nulls(len(key), pa.int64())
        yield pa.record_batch({"uid": null, "id": null, "line": null, "lid": pa.array(some[owner] if len(key) else [], pa.int64()), "more": null, "key": pa.array(key)})


def _postings(hot, ranges: int) -> Callable:
    """Rows (range, keys, salts, ids) of the bands of about SENT lines, each line once, dealt by ranges of hashes of key and salt."""

    def rows(lines: dict[int, str]) -> pa.RecordBatch:
        keys, blocks = hot.value
        owner, key = bands(list(lines.values()))
        lid = np.array(list(lines), np.int64)[owner]
        salt = np.full(len(key), -1, np.int32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            is_hot = keys[at] == key
            salt[is_hot] = (lid[is_hot] >> 7) % blocks[at[is_hot]]
        own = (((K.mix(key.view(np.uint64) + salt.astype(np.uint64)) >> K.U(32)) * K.U(ranges)) >> K.U(32)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order], prepend=-1, append=ranges))
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = {c: pa.array([x[p].tobytes() for p in parts], pa.binary()) for c, x in (("keys", key), ("salts", salt), ("ids", lid))}
        return pa.record_batch({"range": pa.array([own[p[0]] for p in parts], pa.int64()), **columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, str] = {}
        for batch in batches:
            texts = [x for doc in _texts(batch) for x in doc if x]
            if texts:
                lines.update(zip(digests(texts)[:, 0].tolist(), texts, strict=True))
            if len(lines) >= SENT:
                yield rows(lines)
                lines.clear()
        if lines:
            yield rows(lines)

    return run


def _lists(asked: pa.Table) -> pa.Table:
    """The postings (key, salt, id, pos, size) of one range whose list holds another line, or is a block of a frequent key's; ``size`` is the list's."""
    key, salt, lid = (np.frombuffer(b"".join(asked.column(c).to_pylist()), t) for c, t in (("keys", np.int64), ("salts", np.int32), ("ids", np.int64)))

    def runs(*columns: np.ndarray) -> np.ndarray:
        """Number of the run of equal rows for each row."""
        return np.cumsum(np.concatenate([[False], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.zeros(0, np.int64)

    order = np.argsort(key)
    of = runs(key[order])
    some = order[(np.bincount(of)[of] > 1) | (salt[order] >= 0)]  # most keys are one line's own
    some = some[np.lexsort((lid[some], salt[some], key[some]))]
    each = runs(key[some], salt[some], lid[some])
    some = some[np.flatnonzero(np.diff(each, prepend=-1))]  # tasks may have sent copies
    of = runs(key[some], salt[some])
    size = np.bincount(of)[of] if len(of) else of
    kept = (size > 1) | (salt[some] >= 0)
    some, size = some[kept], size[kept]
    return pa.table({"key": key[some], "salt": salt[some], "id": lid[some], "pos": (key[some] & 15).astype(np.int8), "size": size.astype(np.int32)})


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) of the lines of each text that ``at`` names as (line, id)."""
    for batch in batches:
        ids, texts = [], []
        for t, at in zip(binary_column(batch.column("text")), batch.column("at").to_pylist(), strict=True):
            parts = t.as_py().split(b"\n")
            for x in at:
                ids.append(x["lid"])
                texts.append(lines_of(parts[x["line"]])[0])
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})


def _sets(batch: pa.RecordBatch, column: str, ids: str) -> list[np.ndarray]:
    """Sets of shingles; texts that stand in several rows are taken once."""
    number = batch.column(ids).to_numpy()
    _, first, at = np.unique(number, return_index=True, return_inverse=True)
    texts = batch.column(column).take(pa.array(first)).to_pylist()
    if not texts:
        return []
    h, begin = char_shingles(texts)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.concatenate([[True], h[1:] != h[:-1]])
    new[begin[:-1]] = True
    h, begin = h[new], np.concatenate([[0], np.cumsum(new)])[begin].tolist()
    return [h[begin[k] : begin[k + 1]] for k in at.tolist()]


def _lacking(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The elements of p that q lacks; both are sorted, distinct and not empty."""
    return p[q[np.minimum(np.searchsorted(q, p), len(q) - 1)] != p]


def _bitmap(p: np.ndarray) -> np.ndarray:
    """LONGS longs with the bits of the elements."""
    bits = np.zeros(64 * LONGS, bool)
    bits[(p & K.U(64 * LONGS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _verify(t: int, family: bool) -> Callable:
    """The pairs that are linked; with ``family`` all pairs, with whether they are, what a and b share and don't, and a's bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sets(batch, "text_a", "a"), _sets(batch, "text_b", "b")
            extras = [_lacking(p, q) for p, q in zip(x, y, strict=True)]
            n, both = [len(p) for p in x], [len(p) - len(e) for p, e in zip(x, extras, strict=True)]
            good = pa.array([100 * c >= t * (k + len(q) - c) for c, k, q in zip(both, n, y, strict=True)], pa.bool_())
            pairs = batch.select(["a", "b"])
            if not family:
                yield pairs.filter(good)
                continue
            extras = pa.array([e.view(np.int64) for e in extras], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*pairs.columns, good, pa.array(n, pa.int64()), pa.array(both, pa.int64()), extras, pa.array([_bitmap(p) for p in x], pa.list_(pa.int64()))], ["a", "b", "linked", "n", "c", "extras", "bits"])

    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """(uid, line) of every line to remove: all but the earliest of each component of similar lines.

    Lines are parts between line feeds, compared without regard to A-Z or a-z and runs of white space; blank lines are never
    removed.  Two lines are linked when 100 * |intersection| >= threshold * |union| of their sets of 8-character
    shingles (the whole line if shorter).  Lines are told apart by 128 bits and linked by 64 of them; different lines that agree in these
    64 bits are left alone.  Earliest is by id (null last), then ``uid``, the row's number in the
    input, then line number (from 0).  Null and empty texts have no lines.
    """
    spark = session_of(docs)
    work = Work(spark, "lines")
    docs = steady(work, docs)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = work.keep(map_arrow(rows, _scan, "uid long, id long, line long, lid long, more long, key long"))
    lines = scan.where("key is null").drop("key")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "uid", "line"))
    classes = work.keep(lines.groupBy("lid").agg(first.alias("first"), F.count("*").alias("n"), F.min("more").alias("low"), F.max("more").alias("top")).where("low = top").drop("low", "top"))
    hot = scan.where("key is not null").groupBy("key").agg((F.countDistinct("lid") * ONE_IN).alias("n")).where(F.col("n") > LIST).orderBy("key").collect()
    hot = spark.sparkContext.broadcast((np.array([r.key for r in hot], np.int64), np.array([r.n // LIST + 1 for r in hot], np.int64)))
    postings = map_arrow(rows.select("text"), _postings(hot, max(16, classes.count() // BUCKET)), "range long, keys binary, salts binary, ids binary")
    shared = postings.groupBy("range").applyInArrow(_lists, "key long, salt int, id long, pos tinyint, size int").withColumns({"n": F.lit(1).cast("long"), "last": F.lit(0).cast("long")})

    def texts(ids: DataFrame, n: int) -> DataFrame:
        at = classes.join(ids, F.col("lid") == F.col("id"), "left_semi")
        at = at.groupBy(F.col("first.uid").alias("uid")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "lid")).alias("at"))
        return map_arrow(rows.select("uid", "text").join(F.broadcast(at) if n <= BROADCAST_ROWS else at, "uid").select("text", "at"), _pick, "id long, text string")

    def verify(pairs: DataFrame) -> DataFrame:
        return map_arrow(pairs, _verify(threshold, False), "a long, b long")

    def family(pairs: DataFrame) -> DataFrame:
        return map_arrow(pairs, _verify(threshold, True), "a long, b long, linked boolean, n long, c long, extras array<long>, bits array<long>")

    every = F.lit(True)
    comps = link_components(work, shared, texts, verify, F.lit(BANDS), every, every, family, threshold)
    several = classes.join(comps, F.col("lid") == F.col("id"), "left").where("n > 1 or component is not null")
    grouped = work.keep(several.select("lid", "first", "n", F.coalesce("component", "lid").alias("group")))
    heads = grouped.groupBy("group").agg(F.min("first").alias("head"), F.sum("n").alias("all")).where("all > 1")
    heads = grouped.join(heads, "group").select("lid", F.col("head.uid").alias("head_uid"), F.col("head.line").alias("head_line"))
    return lines.join(heads, "lid").where("uid != head_uid or line != head_line").select("uid", "line")


def _without(batches: Iterator[pa.RecordBatch], text_col: str, cut_col: str, added: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Cuts the lines; adds how many there were, blank ones aside, and how many were cut."""
    for batch in batches:
        texts, all_, gone = [], [], []
        for text, cut in zip(binary_column(batch.column(text_col)), batch.column(cut_col).to_pylist(), strict=True):
            text, cut = text.as_py(), set(cut or ())
            texts.append(b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in cut) if cut else text)
            all_.append(sum(1 for x in text.decode("utf-8", "replace").split("\n") if x and not x.isspace()))
            gone.append(len(cut))
        out = {n: batch.column(n) for n in batch.schema.names if n != cut_col}
        out[text_col] = pa.array(texts, pa.binary(), mask=np.asarray(batch.column(text_col).is_null())).view(pa.string())
        yield pa.record_batch({**out, added[0]: pa.array(all_, pa.int64()), added[1]: pa.array(gone, pa.int64())})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, added: tuple[str, str] = ("__lines", "__gone")) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_lines`, and two columns ``added``: how many a text had and lost.

    All rows and columns stay, but for columns with the names of those added, which are replaced; a text that lost every
    line is empty, one that lost none is as it was.
    """
    docs = steady(Work(session_of(docs), "rows"), docs.drop(*added))
    uid, place = free_name(docs, "__uid"), free_name(docs, "__cut")
    cut = repeated_lines(docs, id_col, text_col, threshold).groupBy("uid").agg(F.collect_list("line").alias(place))
    both = numbered(docs, uid).join(cut.withColumnRenamed("uid", uid), uid, "left").drop(uid).withColumn(text_col, F.col(text_col).cast("string"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name != place] + [f"`{c}` long" for c in added])
    return map_arrow(both, lambda batches: _without(batches, text_col, place, added), schema)
