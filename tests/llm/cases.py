"""Documents with every awkward case, and brute-force versions of what the operators do."""

from __future__ import annotations

import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, uid int, key string, n double, line string, hub int"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "tion"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empties, long texts, copies, near copies, shared lines and ties."""
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One two"), (None, "one two"), (7, "a" * 5000), (8, "é ß ñ 漢字 🙂 é")]
    base = words(1, 60)
    for k in range(12):  # near copies of one text, each with an edit of its own
        w = list(base)
        w[5 + k * 4] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(50, " ".join(base)), (51, " ".join(base)), (51, " ".join(base))]  # copies, one row twice
    for k in range(6):  # too different from each other, unless through the middle
        w = list(words(2, 40))
        for j in range(k):
            w[j * 6] = f"x{k}y{j}"
        rows.append((200 + k, " ".join(w)))
    rows.append((300, " ".join(words(3, 20_000))))
    line = " ".join(words(4, 55))
    rows += [(400 + k, f"{' '.join(words(50 + k, 12))}.\n{line}\n{' '.join(words(70 + k, 9))}") for k in range(4)]
    rows.append((410, f"{line.upper()}\n\n  {line}  \r\n{line}"))
    return rows


def docs(spark):
    rows = [(i, t, "en" if i is None or i % 3 else None, None if i == 4 else f"s{(i or 0) % 4}", 0, "x", 1, "k", 0.5, "l", 7) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingles(text: str | None, k: int = 5) -> set:
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(sets: list[set], t: int = 80) -> list[int]:
    """For each set the smallest index that links of Jaccard >= t/100 reach."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s:
            where[e].append(i)
    for i, s in enumerate(sets):
        shared: dict[int, int] = defaultdict(int)
        for e in s:
            for j in where[e]:
                if j < i:
                    shared[j] += 1
        for j, c in shared.items():
            if 100 * c >= t * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]
