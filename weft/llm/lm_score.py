"""Language-model scoring with a weighted backoff automaton of word pairs and triples.

The states are the contexts, that is the root, the words and the word pairs of the training texts, all of them, however rare.
With c the counts, the arc for word w from state h weighs log10 of P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), where h' is h
without its first word; the failure arc from h to h' weighs log10(m / (c(h) + m)), which is what the arc's formula gives for
c(hw) = 0.  At the root P(w) = (c(w) + 1) / (N + V + 1), with one class for all unknown words.  Every state's probabilities
sum to one.  m (one number for words, one for pairs) is such that the failure arcs are as likely as they should be: with
each token of a context that occurs again left out in turn, as many are expected to be new to their context as are so.
:func:`build` and :func:`traverse` state this for an automaton that fits in one place.

The automaton of a large corpus does not, so each chunk of texts gets the part of it that its texts walk through.  A
chunk holds about CHUNK tokens.  It sends its distinct n-grams with their counts in training texts, dealt by ranges of
hashes; a range adds up what all chunks sent and answers each with the sums; with them the chunk walks its texts once from
left to right.  Nothing is broadcast or collected but how many n-grams have how many digits.  An n-gram that is everywhere is one number
from each chunk, so no range is hot.  N-grams are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import kernel as K
from weft.llm.work import Work, binary_column, map_arrow, session_of

#: Tokens in a chunk, and tokens for a range of hashes.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: Passes over the chunks, each with a part of the ranges; the disk for questions shrinks with them.
PASSES = 3
#: Words in an n-gram.
SIZES = (1, 2, 3)
#: The end of a text.
END = 0x454E44
_A, _B, _C, _D = (K.U(x) for x in K._weights(4))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by END, and where each text's tokens begin (and the end)."""
    data, off = K.bytes_of(binary_column(col))
    _, _, h, first = K.words(data, off)
    return np.insert(h, first[1:], K.U(END)), first + np.arange(len(first))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its number, tokens, texts' ids, flags and lengths, distinct words and the words' numbers in order."""

    from pyspark import TaskContext

    number, hs, sizes, flags, ids = TaskContext.get().partitionId() << 33, [], [], [], []

    def chunk() -> pa.RecordBatch:
        words, codes = np.unique(np.concatenate(hs), return_inverse=True)
        of = pa.concat_arrays(ids)
        row = {
            "chunk": pa.array([number], pa.int64()),
            "n": pa.array([len(codes)], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of),
            "training": pa.array([np.concatenate(flags).astype(np.uint8).tobytes()], pa.binary()),
            "sizes": pa.array([np.concatenate(sizes).astype(np.uint32).tobytes()], pa.binary()),
            "words": pa.array([words.tobytes()], pa.binary()),
            "codes": pa.array([_packed(codes)], pa.binary()),
        }
        for x in (hs, sizes, flags, ids):
            x.clear()
        return pa.record_batch(row)

    for batch in batches:
        if not batch.num_rows:
            continue
        h, begin = tokens(batch.column("text"))
        hs.append(h)
        sizes.append(np.diff(begin))
        flags.append(batch.column("training").to_numpy(zero_copy_only=False))
        ids.append(batch.column("id"))
        if sum(map(len, hs)) >= CHUNK:
            yield chunk()
            number += 1
    if hs:
        yield chunk()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)).tobytes()


def _unpacked(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(b) // n] if n else np.uint8)


@dataclass
class Chunk:
    """The n-grams of a chunk: ``keys[k]`` are the sorted distinct hashes of size k; token i ends the one numbered ``at[k][i]``, if ``there[k][i]``."""

    sizes: np.ndarray
    training: np.ndarray
    keys: dict[int, np.ndarray]
    at: dict[int, np.ndarray]
    there: dict[int, np.ndarray]

    @classmethod
    def of(cls, row: dict, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Chunk:
        """All n-grams, or the words and those pairs and triples whose hashes are ``wanted``."""
        sizes, words = np.frombuffer(row["sizes"], np.uint32).astype(np.int64), np.frombuffer(row["words"], np.uint64)
        codes = _unpacked(row["codes"], row["n"]).astype(np.int64)
        h, place = words[codes], np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pair, triple, last = np.zeros_like(h), np.zeros_like(h), (h == K.U(END)).astype(np.uint64)  # the last bit: ends in END
        pair[1:] = K.mix(h[:-1] * _A + h[1:] * _B + K.U(2)) & ~K.U(1) | last[1:]
        triple[2:] = K.mix(pair[1:-1] * _C + pair[2:] * _D + K.U(3)) & ~K.U(1) | last[2:]
        out = cls(sizes, np.frombuffer(row["training"], np.uint8) > 0, {1: words}, {1: codes}, {1: np.ones(len(h), bool)})
        for k, x in ((2, pair), (3, triple)):
            out.there[k], out.at[k] = (place >= k - 1) & (wanted(x) if wanted else True), np.zeros(len(h), np.int64)
            out.keys[k], out.at[k][out.there[k]] = np.unique(x[out.there[k]], return_inverse=True)
        return out

    def counts(self, k: int) -> np.ndarray:
        """How often each n-gram of size k is in the chunk's training texts."""
        own = self.there[k] & np.repeat(self.training, self.sizes)
        return np.bincount(self.at[k][own], minlength=len(self.keys[k]))


def _range(key: np.ndarray, ranges: int) -> np.ndarray:
    return (((key >> K.U(32)) * K.U(ranges)) >> K.U(32)).astype(np.int64)


def _pieces(key: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, place) of the ranges of sorted hashes."""
    own = _range(key, ranges)
    cuts = np.flatnonzero(np.diff(own, prepend=-1, append=ranges))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(own[a]), slice(a, b)


def _ask(ranges: int, part: int) -> Callable:
    """Rows (range, size, chunk, keys, ns) of each chunk's distinct n-grams in the ranges of one pass."""
    kinds = {"range": pa.int64(), "size": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "ns": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk.of(row, lambda key: _range(key, ranges) % PASSES == part)
                for k in SIZES:
                    keys, n = chunk.keys[k], chunk.counts(k)
                    got = [(r, k, row["chunk"], keys[at].tobytes(), _packed(n[at])) for r, at in _pieces(keys, ranges) if r % PASSES == part]
                    if got:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds.values(), strict=True)], list(kinds))

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """For the questions of one range, rows (chunk, range, size, counts) in the order of their keys; (size, digits, distinct, total) of the range,
    with chunk -1 for n-grams that end in END, which are no contexts, and -2 for the others."""
    out = []
    for k in SIZES:
        rows = asked.filter(pc.equal(asked.column("size"), k)).to_pylist()
        if not rows:
            continue
        n = [len(r["keys"]) // 8 for r in rows]
        key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        own = np.concatenate([_unpacked(r["ns"], m).astype(np.int64) for r, m in zip(rows, n, strict=True)])
        order = np.argsort(key, kind="stable")  # the pieces are sorted
        first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0)
        total = np.add.reduceat(own[order], first)
        answer = np.empty(len(key), np.int64)
        answer[order] = np.repeat(total, np.diff(first, append=len(key)))
        for r, part in zip(rows, np.split(answer, np.cumsum(n)[:-1]), strict=True):
            out.append((r["chunk"], r["range"], k, _packed(part), None, None, None))
        last = key[order[first]] == K.U(END) if k == 1 else key[order[first]] & K.U(1) > 0
        out += [(c, None, k, None, *d) for c, own in ((-1, total[last]), (-2, total[~last])) for d in digits(own)]
    kinds = {"chunk": pa.int64(), "range": pa.int64(), "size": pa.int32(), "counts": pa.binary(), "digits": pa.int32(), "distinct": pa.int64(), "total": pa.int64()}
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))


def digits(counts: np.ndarray) -> list[tuple[int, int, int]]:
    """For each number of binary digits, how many counts (other than 0) have so many, and their sum."""
    size = np.frexp(counts[counts > 0].astype(np.float64))[1]
    n, c = np.bincount(size), np.bincount(size, counts[counts > 0])
    return [(d, int(n[d]), int(c[d])) for d in np.flatnonzero(n).tolist()]


def spread(contexts: list[tuple[int, int, int]], once: int) -> float:
    """m, from the :func:`digits` of contexts and the n-grams that occur once.

    The sum of c(h) m / (c(h) - 1 + m) over contexts that occur again is the number of n-grams that occur once in them.
    """
    new = 1 + once - sum(n for d, n, _ in contexts if d == 1)
    number, total = np.array([[n, c] for d, n, c in contexts if d > 1] or [[1, 2]], float).T
    low, high = 1e-2, 1e9
    for _ in range(100):
        m = (low * high) ** 0.5
        low, high = (m, high) if (total * m / (total / number - 1 + m)).sum() < new else (low, m)
    return low


def _walk(total: int, distinct: int, m: dict[int, float], ranges: int) -> Callable:
    """Walks the texts of a chunk through its part of the automaton: (id, training, n_tokens, n_known, base_score, score)."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.drop_columns(["ids"]).to_pylist()[0]
        own, seen = Chunk.of(row), {}
        for k in SIZES:
            rows = answers.filter(pc.equal(answers.column("size"), k)).sort_by("range").to_pylist()
            pieces = dict(_pieces(own.keys[k], ranges))
            parts = [_unpacked(r["counts"], pieces[r["range"]].stop - pieces[r["range"]].start).astype(np.int64) for r in rows]
            count = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            seen[k] = np.where(own.there[k], count[own.at[k]], 0) if len(count) else np.zeros(row["n"], np.int64)
        arc = (seen[1] + 1.0) / (total + distinct + 1.0)  # the root's arc to each token
        base = np.log10(arc)
        for k in (2, 3):  # the state is the word before, then the pair before; where it lacks the arc, this is its failure arc's way
            state = np.concatenate([[0], seen[k - 1][:-1]])
            arc = np.where(own.there[k], (seen[k] + m[k] * arc) / (state + m[k]), arc)
        begin = np.cumsum(own.sizes) - own.sizes
        add = lambda x: np.add.reduceat(x, begin)
        columns = [own.training, own.sizes, add((seen[1] > 0).astype(np.int64)), add(base), add(np.log10(arc))]
        return pa.table([chunk.column("ids").combine_chunks().flatten(), *map(pa.array, columns)], ["id", "training", "n_tokens", "n_known", "base_score", "score"])

    return run


@dataclass
class Automaton:
    """State 0 is the root.  ``arcs[s][w]`` and ``root[w]`` are (log10 weight, next state), ``back[s]`` the failure arc's weight and ``fail[s]`` its end."""

    root: dict[str, tuple[float, int]]
    unknown: float
    arcs: list[dict[str, tuple[float, int]]]
    back: list[float]
    fail: list[int]


def build(counts: dict[tuple[str, ...], int], end: str) -> Automaton:
    """The automaton of all n-grams of up to three words with their counts; ``end`` is the last word of all texts."""
    m = {k: spread(digits(np.array([c for g, c in counts.items() if len(g) == k - 1 and g[-1] != end], np.int64)), sum(c == 1 for g, c in counts.items() if len(g) == k)) for k in (2, 3)}
    n = sum(c + 1 for g, c in counts.items() if len(g) == 1) + 1.0
    number = {(): 0} | {g: i + 1 for i, g in enumerate(sorted((g for g in counts if len(g) < 3), key=lambda g: (len(g), g)))}
    p = {g: (c + 1) / n for g, c in counts.items() if len(g) == 1}
    for k in (2, 3):
        p |= {g: (c + m[k] * p[g[1:]]) / (counts[g[:-1]] + m[k]) for g, c in counts.items() if len(g) == k}
    arcs: list[dict[str, tuple[float, int]]] = [{} for _ in number]
    for g, x in p.items():
        arcs[number[g[:-1]]][g[-1]] = float(np.log10(x)), number[g[-2:]]
    back = [0.0] + [float(np.log10(m[len(g) + 1] / (counts[g] + m[len(g) + 1]))) for g in number if g]
    return Automaton(arcs[0], -float(np.log10(n)), arcs, back, [number[g[1:]] for g in number])


def traverse(a: Automaton, words: list[str]) -> float:
    """log10 probability of words, from left to right."""
    total, state = 0.0, 0
    for w in words:
        while w not in a.arcs[state] and state:
            total += a.back[state]
            state = a.fail[state]
        step, state = a.arcs[state].get(w, (a.unknown, 0))
        total += step
    return total


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; scores are log10.

    The model learns from the rows for which ``training`` holds (null: it does).  Tokens are runs of bytes other than ASCII
    white space, A-Z as a-z, then one end; null and empty texts have only the end.  base_score adds
    log10((c + 1) / (N + V + 1)) over tokens, score is the model's.  An empty training set leaves c = N = V = 0 and
    scores of 0.  Repeated rows are scored, and learnt from, each.  Other columns are ignored, whatever their names.
    """
    spark = session_of(docs)
    work = Work(spark, "lm")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # every pass leaves its disk to the next
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = work.keep(map_arrow(rows, _chunks, f"chunk long, n long, ids array<{kind}>, training binary, sizes binary, words binary, codes binary"))
    ranges = max(16, (chunks.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    several = []
    for part in range(PASSES):
        asked = map_arrow(chunks.drop("ids"), _ask(ranges, part), "range long, size int, chunk long, keys binary, ns binary")
        several.append(work.keep(asked.groupBy("range").applyInArrow(_answer, "chunk long, range long, size int, counts binary, digits int, distinct long, total long")))
    answers = reduce(DataFrame.union, several)
    sums = answers.where("chunk < 0").groupBy("size", "chunk", "digits").agg(F.sum("distinct").alias("n"), F.sum("total").alias("c")).orderBy("size", "chunk", "digits").collect()
    total, distinct = (sum(r[x] for r in sums if r["size"] == 1) for x in ("c", "n"))
    m = {k: spread([(r["digits"], r["n"], r["c"]) for r in sums if (r["size"], r["chunk"]) == (k - 1, -2)], sum(r["n"] for r in sums if (r["size"], r["digits"]) == (k, 1))) for k in (2, 3)}
    walked = chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
    out = walked.applyInArrow(_walk(total, distinct, m, ranges), f"id {kind}, training boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "training", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
