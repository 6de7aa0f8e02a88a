"""Each operator against brute force on a fixture of awkward rows, on an empty table, and for equal reruns."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from weft.llm import decontaminate, kernel, langid, lm_score, toxicity
from weft.llm.components import components
from weft.llm.embedding_dedup import near_vectors
from weft.llm.forest import fit, predict
from weft.llm.jaccard_join import jaccard_components
from weft.llm.line_dedup import dedup_lines, lines_of
from weft.llm.mixing import mix, targets
from weft.llm.secret_findings import labelled_findings
from weft.llm.secrets_scan import find_secrets
from weft.llm.substring_dedup import repeated_units, without_repeats
from weft.llm.work import Work


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_words_and_hashes():
    import pyarrow as pa

    r = random.Random(5)
    for block in (16, 64, 1 << 18):
        kernel.BLOCK = block
        kernel._powers.clear()
        for _ in range(60):
            texts = ["".join(r.choice("ab C\n\té") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
            data, off = kernel.bytes_of(pa.array(texts).cast(pa.large_binary()))
            s, e, h, first = kernel.words(data, off)
            got = [[bytes(data[s[i] : e[i]]).decode() for i in range(first[k], first[k + 1])] for k in range(len(texts))]
            assert [[cases.lower(w) for w in t] for t in got] == [cases.spaced(t) for t in texts]
            assert len(set(h.tolist())) == len({cases.lower(w) for t in got for w in t})
    kernel.BLOCK = 1 << 18
    kernel._powers.clear()


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, k) for k in range(201, 240)] + [(7, 7), (None, 3)]
    parent = {x: x for p in links for x in p if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(components(Work(spark, "test"), spark.createDataFrame(links, "a long, b long")), "id", "component"))
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(Work(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard(spark):
    table = [(i, t) for i, t in cases.texts()]
    known = sorted({i: t for i, t in table if i is not None}.items())
    sets = [cases.shingles(t) for _, t in known]
    roots = components_of = dict(zip([i for i, _ in known], cases.components(sets), strict=True))
    want = sorted(((i, len(cases.shingles(t)), None if i is None else known[components_of[i]][0]) for i, t in table), key=repr)
    assert rows(jaccard_components(cases.docs(spark)), "id", "n_shingles", "component_id") == want
    assert len({roots[100 + k] for k in range(12)}) == 1
    assert jaccard_components(cases.empty(spark)).count() == 0


def test_line_dedup(spark):
    table = cases.texts()
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is None, table[k][0] or 0, k))
    where: dict[str, list] = {}
    for place, k in enumerate(order):
        for at, line in enumerate(lines_of((table[k][1] or "").encode())):
            if line:
                where.setdefault(line, []).append((place, at))
    lines = list(where)
    roots = cases.components([{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines])
    groups: dict[int, list] = {}
    for x, root in zip(lines, roots, strict=True):
        groups.setdefault(root, []).extend(where[x])
    gone = {occurrence for g in groups.values() for occurrence in sorted(g)[1:]}
    want = []
    for place, k in enumerate(order):
        parts = (table[k][1] or "").split("\n")
        cut = [x for at, x in enumerate(parts) if (place, at) not in gone]
        want.append((table[k][0], table[k][1] if len(cut) == len(parts) else "\n".join(cut), len(parts) - len(cut)))
    assert rows(dedup_lines(cases.docs(spark)), "doc_id", "text", "__gone") == sorted(want, key=repr)
    assert dedup_lines(cases.empty(spark)).count() == 0


def test_decontamination(spark):
    item = cases.words(4, 55)[3:40]
    items = [(1, " ".join(item)), (2, "ONE, two!"), (2, "one two"), (3, None), (4, ""), (None, "漢字 🙂"), (10, " ".join(cases.words(1, 60)))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.find_contamination(cases.docs(spark), table).collect():
        got.setdefault((r.doc_id, r.n_words), []).append((r.n_hit, list(r["items"]), [(h.start, h.end) for h in r.hits]))

    def norm(t):
        return decontaminate.normal_words((t or "").encode())

    for i, t in cases.texts():
        w, hit, ids = norm(t), set(), set()
        for item_id, text in items:
            v = norm(text)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids |= set() if item_id is None else {str(item_id)}
        found = got[(i, len(w))]
        assert all(f[:2] == (len(hit), sorted(ids)) for f in found), (i, found)
        for start, end in found[0][2]:
            assert set(norm(t[start:end])) <= {w[k] for k in hit}
    clean = decontaminate.drop_contaminated(cases.docs(spark), table)
    assert {r.doc_id for r in clean.collect()}.isdisjoint({100, 50, 400, 6}) and clean.where("doc_id in (1, 2, 300)").count() == 3
    assert clean.columns == cases.docs(spark).columns
    assert decontaminate.find_contamination(cases.empty(spark), table).count() == 0
    assert decontaminate.find_contamination(cases.docs(spark), table.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_several_passes(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(cases.words(1, 60)[k : k + 14])) for k in range(20)], "item_id long, text string")
    once = rows(decontaminate.find_contamination(cases.docs(spark), items), "doc_id", "n_words", "n_hit", "items")
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 100)
    assert rows(decontaminate.find_contamination(cases.docs(spark), items), "doc_id", "n_words", "n_hit", "items") == once


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 8))
    table = [(k, [float(x) for x in v]) for k, v in enumerate([*base, *(base[:10] * 3), *(base[5] + 0.02 * r.normal(size=(30, 8)))])]
    table += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, []), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (None, [1.0] * 8), (506, [1.0] * 8), (506, [1.0] * 8)]
    got = near_vectors(spark.createDataFrame([(*t, "x") for t in table], "vec_id long, embedding array<double>, rep string"), least=0.95)

    def usable(v):
        return v is not None and len(v) and all(map(math.isfinite, v)) and any(v)

    def cos(a, b):
        return np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))

    linked = [[j for j, (k2, w) in enumerate(table) if j != i and k is not None and k2 is not None and usable(v) and usable(w) and len(v) == len(w) and cos(v, w) >= 0.95] for i, (k, v) in enumerate(table)]
    label = [k for k, _ in table]
    for _ in table:
        label = [None if label[i] is None else min([label[i], *(label[j] for j in linked[i])]) for i in range(len(table))]
    assert rows(got, "id", "n_links", "component_id") == sorted(((k, len(linked[i]), label[i]) for i, (k, _) in enumerate(table)), key=repr)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_over_cells(spark, monkeypatch):
    from weft.llm import embedding_dedup

    r = np.random.default_rng(2)
    base = r.normal(size=(300, 16))
    table = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base[:150] + 0.15 * r.normal(size=(150, 16))]))]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    whole = rows(near_vectors(df, least=0.9), "id", "n_links", "component_id")
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert rows(near_vectors(df, least=0.9), "id", "n_links", "component_id") == whole
    assert any(n for _, n, _ in whole)


def test_repeated_lines(spark):
    got = repeated_units(cases.docs(spark), unit="line", min_words=50)
    seen, want = {}, []
    for i, t in sorted(cases.texts(), key=lambda x: (x[0] is None, x[0] or 0)):
        at, run = 0, []
        for part in [*(t or "").split("\n"), None]:
            w = cases.spaced(part)
            if w or part is None:
                if w and " ".join(w) in seen:
                    start = at + len(part) - len(part.lstrip(" \t\r"))
                    run.append((start, at + len(part.rstrip(" \t\r")), len(w), *seen[" ".join(w)]))
                else:
                    if sum(x[2] for x in run) >= 50:
                        want.append((i, run[0][0], run[-1][1], sum(x[2] for x in run), *run[0][3:]))
                    run = []
                    if w:
                        seen[" ".join(w)] = (i, at + len(part) - len(part.lstrip(" \t\r")))
            at += len(part or "") + 1
    assert rows(got, "id", "start", "end", "n_words", "kept_id", "kept_start") == sorted(want, key=repr)
    assert repeated_units(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_repeats_are_cut(spark, unit):
    df = cases.docs(spark)
    texts = dict(cases.texts())
    for r in repeated_units(df, unit=unit).collect():
        first = cases.spaced(texts[r.id][r.start : r.end])[:5]
        assert cases.spaced(texts[r.kept_id][r.kept_start :])[:5] == first
    cut = without_repeats(df, unit=unit)
    assert cut.count() == df.count() and repeated_units(cut, unit=unit).count() == 0 and cut.where("size(__removed) > 0").count() > 0


def test_passages_within_lines(spark):
    passage = ". ".join(" ".join(cases.words(900 + k, 15)).capitalize() for k in range(4)) + "."
    table = [(1, f"Éine first text here. {passage}"), (2, f"Some ñ words before! {passage} And after."), (3, f"no stop before it {passage}\nnext line"), (4, "Clean text. And more of it.")]
    got = repeated_units(spark.createDataFrame(table, "doc_id long, text string"))
    found = {r.id: table[r.id - 1][1][r.start : r.end] for r in got.collect()}
    assert found == {2: passage, 3: passage.split(". ", 1)[1]} and {r.kept_id for r in got.collect()} == {1}


def test_mixing(spark):
    df = cases.docs(spark)
    got = mix(df).collect()
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len(cases.spaced(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= share
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in target.items()}
    taken = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert abs(sum(taken.values()) - sum(sizes.values())) <= max(r.size for r in got)
    assert rows(mix(df), "id", "size", "taken") == rows(mix(df.repartition(3)), "id", "size", "taken")
    assert mix(cases.empty(spark)).count() == 0
    assert targets(Work(spark, "test"), spark.createDataFrame([("a", 0)], "source string, source_size long")).first().target == 0


def test_lm_base_and_sums(spark):
    df = cases.docs(spark)
    got = {}
    for r in lm_score.score_texts(df, toxicity.remainder("doc_id", 7) != 2).collect():
        got.setdefault(r.id, []).append(r)
    count, table = Counter(), cases.texts()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in table}
    for i, t in table:
        if not held[i]:
            count.update([*cases.spaced(t), "\0end"])
    total, distinct = sum(count.values()), len(count)
    for i, t in table:
        w = [*cases.spaced(t), "\0end"]
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        r = next(r for r in got[i] if r.n_tokens == len(w))
        assert (not r.training, r.n_known, r.train_tokens) == (held[i], sum(count[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    assert lm_score.score_texts(cases.empty(spark), toxicity.remainder("doc_id", 7) != 2).count() == 0


def ngram_counts(texts):
    return Counter(tuple(w[i : i + k]) for w in texts for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_automaton_probabilities_sum_to_one():
    r = random.Random(1)
    texts = [[*(r.choice("abcde") for _ in range(r.randint(0, 40))), "\0end"] for _ in range(30)]
    a = lm_score.build(ngram_counts(texts), "\0end")
    for prefix in ([], ["a"], ["b", "a"], ["a", "b"], ["c", "a", "b"], ["?"], ["a", "?"], ["?", "a"]):
        before = lm_score.traverse(a, prefix)
        assert abs(sum(10 ** (lm_score.traverse(a, [*prefix, w]) - before) for w in [*"abcde", "\0end", "?"]) - 1) < 1e-9


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_lm_is_the_automaton_of_all_ngrams(spark, monkeypatch, chunk):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(0, 60))) for _ in range(60)] + ["rare pair here", "A rare pair again", "rare pair", None, ""] + ["ax by cz"] * 30
    monkeypatch.setattr(lm_score, "CHUNK", chunk)  # decides what travels together, not what the model holds
    monkeypatch.setattr(lm_score, "BUCKET", chunk)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.id: x for x in lm_score.score_texts(df, toxicity.remainder("doc_id", 7) != 2).collect()}
    split = [[*cases.spaced(t), "\0end"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = ngram_counts([w for w, h in zip(split, held, strict=True) if not h])
    a = lm_score.build(counts, "\0end")
    for i, w in enumerate(split):
        want = lm_score.traverse(a, w)
        assert abs(got[i].score - want) < 1e-9 * max(1, abs(want)) and (got[i].n_tokens, got[i].training) == (len(w), not held[i])


def test_lm_without_training_rows(spark):
    from pyspark.sql import functions as F

    got = lm_score.score_texts(cases.docs(spark), F.lit(False)).collect()
    assert len(got) == len(cases.texts()) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_toxicity(spark):
    r = random.Random(2)
    table, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        sentences = [" ".join(cases.words(i * 7 + k, 8)) for k in range(4)]
        if toxic:
            sentences[r.randrange(4)] += r.choice([" grimble", " vexor", " snarkling"])
        table.append((i, ". ".join(sentences) + ".", "a"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    table += [(1000, None, "b"), (1001, "", "b"), (1002, "...", "b"), (None, "grimble", "b")]
    df = spark.createDataFrame(table, "doc_id long, text string, label string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, known)
    got = {r.id: r for r in toxicity.score(df, model).collect()}
    assert sum((got[i].score >= 0.7) == (i % 5 == 0) for i in range(400)) >= 396
    assert got[1000].score == got[1001].score == got[1002].score == 0
    for i in range(0, 400, 5):
        spans = [table[i][1][s.start : s.end] for s in got[i].offending]
        assert any(w in s for s in spans for w in ("grimble", "vexor", "snarkling"))
    assert toxicity.score(cases.empty(spark), model).count() == 0
    assert toxicity.score(df, toxicity.train(df, known.limit(0))).where("score > 0.5").count() == 0


def test_language_id(spark):
    made = {"en": ["the", "and", "with", "that"], "de": ["der", "und", "mit", "nicht"], "fr": ["les", "et", "avec", "pas"]}
    r = random.Random(4)
    train = [(" ".join(r.choice(w) for _ in range(60)), x) for x, w in made.items() for _ in range(30)] + [(None, "en"), ("x", None)]
    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    pages = []
    for k in range(90):
        x = list(made)[k % 3]
        said = "en" if k % 10 == 0 else x  # some pages declare the wrong language
        pages.append((k, f"http://h{k % 7}.site.org/{x}/{k}", f'<html lang="{said}"><head><style>der und</style></head><nav>der der</nav><p>{" ".join(r.choice(made[x]) for _ in range(30))}</p></html>'))
    pages += [(100, None, None), (101, "http://a.b/", ""), (102, "nonsense", "<html>123 456</html>"), (103, "http://h1.site.org/de/1", "<p>der</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, prior string")
    got = {r.id: r for r in langid.identify(df, model, "page_id", "html", "url", pages=True).collect()}
    assert all(got[k].lang == list(made)[k % 3] and not got[k].rejected for k in range(90))
    assert all(got[k].rejected and got[k].lang is None for k in (100, 101, 102)) and got[103].lang == "de"
    assert langid.identify(df.limit(0), model, "page_id", "html", "url", pages=True).count() == 0
    nothing = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert langid.identify(df, nothing, "page_id", "html", "url").where("not rejected").count() == 0


def test_secrets(spark):
    findings = labelled_findings()
    assert findings == labelled_findings() and {f[-1] for f in findings} == {0, 1}
    fresh = labelled_findings(600, seed=99)
    table = [(i, f"é {before}{token}{after}", path, "x") for i, (token, before, after, path, _) in enumerate(fresh)]
    table += [(1000, None, None, "x"), (1001, "", "p", "x"), (1002, "z" * 40, "p", "x"), (1002, "1" * 20_000, "p", "x")]
    filler = [(2000 + k, " ".join(cases.words(k, 200)), "s", "x") for k in range(50)]
    df = spark.createDataFrame(table + filler, "doc_id long, text string, source string, probability string")
    got = find_secrets(df, findings).collect()
    right = [r.kept == bool(fresh[r.id][-1]) for r in got if r.id < 1000 and fresh[r.id][0][: r.end - r.start] == table[r.id][1][r.start : r.end][: len(fresh[r.id][0])]]
    assert len(right) > 400 and sum(right) / len(right) > 0.9
    assert not [r for r in got if r.id in (1000, 1001)] and {r.kept for r in got if r.id == 1002} <= {False}
    assert find_secrets(df.limit(0), findings).count() == 0


def test_forest():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    got = predict(fit(x[:300], y[:300]), x[300:])
    assert ((got > 0.5) == y[300:]).mean() > 0.85
    assert (predict(fit(x[:50], y[:50]), x) == predict(fit(x[:50], y[:50]), x)).all()
