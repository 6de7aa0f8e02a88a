"""The kernels of line deduplication against plain versions, and what they and the linkage needn't do."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import line_dedup as L
from weft.llm import linkage
from weft.llm.linkage import link_components, shared_postings
from weft.llm.work import Work


def lines(n, low, high, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij klé\U0001f600"), rng.integers(low, high))) for _ in range(n)]


def test_bands_of_a_line_do_not_depend_on_its_neighbours():
    texts = lines(60, 1, 400)
    owner, key = L.bands(texts)
    for i, x in enumerate(texts):
        assert sorted(key[owner == i].tolist()) == sorted(L.bands([x])[1].tolist())


def test_lines_with_any_white_space():
    odd = [chr(c) for c in range(1 << 16) if chr(c).isspace()]
    for text in ["", " ", "\n", " Ab  c\nD ", "É b\n c ", *(f"X{c}y {c}\n{c}z\n b" for c in odd)]:
        assert L.lines_of(text.encode()) == [L.normal("".join(c.lower() if c.isascii() else c for c in x)) for x in text.split("\n")]
    assert L.lines_of(b"\xff a\t\xc2") == ["� a �"]


def test_reading_lines_costs_little_more_than_splitting():
    texts = [("some words of a line that goes on for a while\n" * 40).encode()] * 300

    def best(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            for t in texts:
                f(t)
            took.append(time.process_time() - began)
        return min(took)

    assert best(L.lines_of) < 4 * best(lambda t: [x.strip(" ") for x in t.translate(L._LOWER).decode().split("\n")])


def test_verified_pairs_as_by_plain_sets():
    a = [x for x in lines(40, 1, 300, 2) for _ in range(2)]
    b = [x if k % 2 else x[: len(x) * 9 // 10] + "#" * (k % 7 + 1) for k, x in enumerate(a)]
    rows = pa.record_batch({"a": pa.array([k // 2 for k in range(80)]), "text_a": a, "b": pa.array(range(100, 180)), "text_b": b})
    sets = [[set(L.char_shingles([x])[0].view(np.int64).tolist()) for x in side] for side in (a, b)]
    (got,) = L._verify(80, True)(iter([rows]))
    for r, p, q in zip(got.to_pylist(), *sets, strict=True):
        assert (r["linked"], r["n"], r["c"]) == (100 * len(p & q) >= 80 * len(p | q), len(p), len(p & q))
        assert sorted(r["extras"]) == sorted(p - q) and len(set(r["extras"])) == len(r["extras"])
    (linked,) = L._verify(80, False)(iter([rows]))
    assert linked.to_pylist() == [{"a": r["a"], "b": r["b"]} for r in got.to_pylist() if r["linked"]]
    assert 0 < linked.num_rows < 80


def test_families_in_one_component_send_no_elements(spark, monkeypatch):
    rows = [(k, -1, x, k) for k in range(4) for x in (1, 10, 11, 12)]  # all linked with their hub
    rows += [(10 + k, -1, x, k) for k in range(4) for x in (2, 20, 21)]  # 21 isn't
    postings = spark.createDataFrame(rows, "key long, salt int, id long, pos int")
    shared = shared_postings(postings).withColumns({"n": F.lit(1).cast("long"), "last": F.lit(0).cast("long")})
    true, seen = F.expr("a != 21 and b != 21"), []

    def texts(ids, n):
        return ids.select("id", F.col("id").cast("string").alias("text"))

    def verify(pairs):
        return pairs.where(true).select("a", "b")

    def family(pairs):
        return pairs.select("a", "b", true.alias("linked"), F.lit(10).cast("long").alias("n"), F.lit(1).cast("long").alias("c"), F.array().cast("array<long>").alias("extras"))

    def within(work, members, t, plain=linkage._within):
        seen.extend(r.id for r in members.collect())
        return plain(work, members, t)

    monkeypatch.setattr(linkage, "_within", within)
    every = F.lit(True)
    got = link_components(Work(spark, "test"), shared, texts, verify, F.lit(4), every, every, family)
    assert {(r.id, r.component) for r in got.collect()} == {(1, 1), (10, 1), (11, 1), (12, 1), (2, 2), (20, 2)}
    assert not {1, 10, 11, 12} & set(seen) and 21 in seen


def test_bitmaps_keep_unlike_lines_of_a_family_apart(spark):
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 1 << 63, 400, dtype=np.uint64), []
    for k in range(40):  # each has most of its elements in the hub, but another part of it; the last two are alike
        sets.append(np.unique(np.concatenate([rng.permutation(base)[:300], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) if k < 39 else sets[-1][8:])
    rows = [(1, k, k, False, len(s), 300, [], L._bitmap(s).tolist()) for k, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "hub long, id long, comp long, linked boolean, n long, c long, extras array<long>, bits array<long>")
    got = {(r.a, r.b) for r in linkage._within(Work(spark, "test"), members, 80).collect()}
    alike = {(i, j) for i in range(40) for j in range(i) for c in [len(np.intersect1d(sets[i], sets[j]))] if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    assert {(j, i) for i, j in alike} <= got and (38, 39) in got
    assert len(got) < 80  # 780 without bitmaps
