"""Rows with what a text operator must bear, and plain versions to compare with."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, row int, copies int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    parts = "ba ke li mo nu ra se ti vo du".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows; columns
    whose names operators use themselves."""
    base = [prose(i, 60) + "\n" + prose(i + 100, 30) for i in range(12)]
    copies = [base[0], base[0], base[0].replace("ba", "bo", 1), base[1] + " and"]
    lines = [f"Shared line here\n{prose(200 + i, 8)}\n  SHARED line here\t\n" for i in range(11)]
    odd = ["", " ", "\n", "\n\n\n", "one", "one two three", "\t x \x0b", "é" * 50, prose(300, 4000), "same same " * 40]
    texts = [*base, *copies, *lines, *odd]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "")[i % 4], len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (None, None, "en", "s1", 0), (None, base[2], None, None, None)]
    rows += [rows[3], rows[3], rows[20]]
    return [(*r, "x", "y", 1, 2) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def jaccard_groups(rows, n=5, similarity=0.8):
    """Links and smallest reachable id of each (id, text), by comparing all pairs."""
    sets = []
    for row in rows:
        w = words(row[1])
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    m = len(rows)
    linked = [[] for _ in range(m)]
    for a in range(m):
        for b in range(m):
            if a != b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
                    linked[a].append(b)
    return linked


def reachable(linked):
    root = list(range(len(linked)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, near in enumerate(linked):
        for b in near:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for a in range(len(linked)):
        groups.setdefault(find(a), []).append(a)
    return groups
