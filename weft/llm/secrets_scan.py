"""Secret scanning: candidates by form, false positives removed by a random forest.

Features are the candidate's length, its character transitions under a bigram model of the corpus, classes of
characters, how much of it frequent words of the corpus cover, the path, and the words next to it.  Bigrams and words
are counted over all texts, words in a sketch of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import forest
from weft.llm import kernel as K
from weft.llm.work import binary_column, map_arrow, session_of, sum_counts

#: Characters in a candidate at least.
LENGTH = 16
#: Counters of the word sketch and its pieces; a word is in the dictionary if it makes up one in FREQUENT of all words.
SKETCH, SLICES, FREQUENT = 1 << 20, 16, 100_000
#: Lengths in bytes of words that cover parts of candidates.
COVER = range(3, 13)
#: Least probability of a finding that is kept.
LEAST = 0.5
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"_+/-."]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EDGE = b"+/-._"
#: Values set after a key word; of VALUE characters or more, with or without digits, up to a blank or quote.
VALUE = 8
_VALUE = re.compile(rb"(?:token|secret|key|passw(?:or)?d|passwd|pwd|auth|credentials?|bearer)[\"']?[ \t]*[=:][ \t]*(?:\"([^\"\r\n]{%d,200})\"|'([^'\r\n]{%d,200})'|([^\s\"',;]{%d,200}))" % (VALUE, VALUE, VALUE), re.I)
#: Words that speak for and against a secret nearby, and parts of paths of tests and documentation.
_FOR = re.compile(r"token|secret|key|passw|pwd|auth|credential|bearer")
_AGAINST = re.compile(r"commit|sha|md5|checksum|uuid|\bid\b|digest|hash|example|version|build|page|image|url")
_TESTS = re.compile(r"test|example|sample|fixture|doc|readme|lock")
NAMES = ("length", "transitions", "classes", "entropy", "digits", "upper", "symbols", "hex", "covered", "distinct", "test_path", "path_depth", "for", "against", "for_after", "against_after", "assigned", "quoted")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte pairs (slice -1) and of word hashes (slices 0 to SLICES - 1)."""
    pairs, words = np.zeros(1 << 16, np.uint32), np.zeros(SKETCH, np.uint32)
    for batch in batches:
        data, off = K.bytes_of(binary_column(batch.column("text")))
        if len(data):
            low = K.LOWER[data].astype(np.int64)
            pairs += np.bincount((low[:-1] << 8) | low[1:], minlength=1 << 16).astype(np.uint32)
        h = K.words(data, off, K.LETTERS)[2]
        words += np.bincount((h & K.U(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
    yield pa.record_batch({"slice": pa.array(range(-1, SLICES), pa.int32()), "counts": pa.array([pairs.tobytes(), *(p.tobytes() for p in np.split(words, SLICES))], pa.binary())})


class Corpus:
    """What the features need of the corpus: log-probabilities of byte transitions and the sketch of words."""

    def __init__(self, counts: dict[int, np.ndarray]):
        pairs = counts.get(-1, np.zeros(1 << 16)).reshape(256, 256) + 0.5
        self.transitions = np.log2(pairs / pairs.sum(axis=1, keepdims=True))
        self.words = np.concatenate([counts.get(s, np.zeros(SKETCH // SLICES)) for s in range(SLICES)])
        self.least = max(self.words.sum() / FREQUENT, 2)

    def covered(self, token: bytes) -> float:
        """Largest part of the token that words of the dictionary cover without overlap, longest first from the left."""
        at, done, spans = 0, 0, []
        for n in COVER:
            spans += [token[i : i + n] for i in range(len(token) - n + 1)]
        if not spans:
            return 0.0
        off = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
        data = np.frombuffer(b"".join(spans), np.uint8)
        starts, ends, h, _ = K.words(data, off, K.LETTERS)
        whole = np.isin(starts, off) & np.isin(ends, off)  # a part with other characters in it is no word
        often = whole & (self.words[(h & K.U(SKETCH - 1)).astype(np.int64)] >= self.least)
        known = {bytes(data[a:b]) for a, b in zip(starts[often], ends[often], strict=True)}
        while at < len(token):
            n = next((n for n in reversed(COVER) if token[at : at + n] in known and at + n <= len(token)), 0)
            done += n
            at += n or 1
        return done / len(token)

    def features(self, token: bytes, before: str, after: str, path: str | None) -> list[float]:
        low = K.LOWER[np.frombuffer(token, np.uint8)].astype(np.int64)
        kind = [0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in token]
        n, count = len(token), Counter(token)
        path, near, next_ = (path or "").lower(), " ".join(before.lower().split()[-3:]), " ".join(after.lower().split()[:3])
        return [
            n,
            float(self.transitions[low[:-1], low[1:]].mean()),
            sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
            -sum(c / n * np.log2(c / n) for c in count.values()),
            kind.count(2) / n,
            kind.count(1) / n,
            kind.count(3) / n,
            float(all(c in b"0123456789abcdefABCDEF" for c in token)),
            self.covered(token),
            len(count) / n,
            float(bool(_TESTS.search(path))),
            path.count("/"),
            float(bool(_FOR.search(near))),
            float(bool(_AGAINST.search(near))),
            float(bool(_FOR.search(next_))),
            float(bool(_AGAINST.search(next_))),
            float(bool(re.search(r"[=:]\s*[\"']?$", before))),
            float(bool(re.search(r"[\"']$", before)) and after[:1] in ("'", '"')),
        ]


def candidates(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, end), in bytes of ``data``: runs of key characters of enough length with a digit, and values set after key words.

    A value that holds a run and other marks is the candidate in its place.
    """
    values = []
    for d in range(len(off) - 1):
        for m in _VALUE.finditer(bytes(data[off[d] : off[d + 1]])):
            a, b = m.span(m.lastindex)
            values.append((d, int(off[d]) + a, int(off[d]) + b))
    at = 0
    for run in _runs(data, off):
        while at < len(values) and values[at][1] < run[1] and values[at][2] <= run[1]:
            yield values[at]
            at += 1
        if at < len(values) and values[at][1] <= run[1] and run[2] <= values[at][2]:  # within a value
            if not bytes(data[values[at][1] : run[1]]).strip(_EDGE) and not bytes(data[run[2] : values[at][2]]).strip(_EDGE):
                values[at] = run  # but for marks at its ends
            continue
        while at < len(values) and values[at][1] < run[2]:  # a run is whole
            at += 1
        yield run
    yield from values[at:]


def _runs(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts, ends, _, first = K.words(data, off, _RUN, hashes=False)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    for k in np.flatnonzero((ends - starts >= LENGTH) & (digits[ends] > digits[starts])):
        a, b = int(starts[k]), int(ends[k])
        run = bytes(data[a:b])
        a, b = a + len(run) - len(run.lstrip(_EDGE)), b - len(run) + len(run.rstrip(_EDGE))
        if b - a >= LENGTH:
            yield int(np.searchsorted(first, k, "right") - 1), a, b


def _find(model) -> Callable:
    kinds = {"start": pa.int64(), "end": pa.int64(), "sha256": pa.string(), "probability": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, trees = model.value
        for batch in batches:
            data, off = K.bytes_of(binary_column(batch.column("text")))
            paths = batch.column("path").to_pylist()
            rows, spans, feats, hashes, chars, last = [], [], [], [], None, -1
            for d, a, b in candidates(data, off):
                lo, hi = int(off[d]), int(off[d + 1])
                if d != last:
                    chars, last = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)]), d
                before, after = bytes(data[max(lo, a - 60) : a]).decode("utf-8", "ignore"), bytes(data[b : min(hi, b + 20)]).decode("utf-8", "ignore")
                token = bytes(data[a:b])
                rows.append(d)
                spans.append((int(chars[a - lo]), int(chars[b - lo])))
                feats.append(corpus.features(token, before, after, paths[d]))
                hashes.append(hashlib.sha256(token).hexdigest())
            if rows:
                p = forest.predict(trees, np.array(feats))
                columns = [pa.array(c, t) for c, t in zip(([s[0] for s in spans], [s[1] for s in spans], hashes, p), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *columns], ["id", *kinds])

    return run


def find_secrets(docs: DataFrame, findings: list[tuple[str, str, str, str, int]], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: float = LEAST) -> DataFrame:
    """(id, start, end, sha256, probability, kept): one row for each candidate in ``docs``.

    Candidates are runs of 16 or more letters, digits and _ + / - . with a digit, without such marks at their ends, and values of
    8 or more characters that are set (= or :) after a key word, whatever their characters.
    ``findings`` are labelled rows (token, before, after, path, 1 for a secret) that the forest is fitted on.  [start, end) are
    characters of the text; the secret itself is given as a digest only.  ``kept`` are findings with a probability of at
    least ``least``; the others are false positives.  Null and empty texts have no candidates, a null path speaks for
    nothing, repeated rows are scanned each.  Other columns are ignored, whatever their names.
    """
    spark = session_of(docs)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    corpus = Corpus(sum_counts(map_arrow(rows.select("text"), _scan, "slice int, counts binary"), SLICES))
    x = np.array([corpus.features(t.encode(), before, after, p) for t, before, after, p, _ in findings])
    trees = forest.fit(x, np.array([f[-1] for f in findings], float))
    found = map_arrow(rows, _find(spark.sparkContext.broadcast((corpus, trees))), f"id {rows.schema['id'].dataType.simpleString()}, start long, end long, sha256 string, probability double")
    return found.withColumn("kept", F.col("probability") >= least)
