import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])

NAMES = [f"w{i}" for i in range(400)]


def words(seed: int, n: int, of=NAMES) -> list[str]:
    x, out = seed * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(of[x // 7 % len(of)])
    return out


def awkward_texts() -> list[str | None]:
    """NULL, empty, blank, tiny, repeated, near-equal, very long and odd texts."""
    base, passage = words(1, 120), words(2, 70)
    edited = list(base)
    edited[60] = "CHANGED"
    return [None, "", " \n\t ", "a", "a b c", "A b C", "a b c d e", " ".join(base), " ".join(base), " ".join(edited),
            "  ".join(w.upper() for w in base), " ".join(words(3, 30) + passage + words(4, 30)),
            " ".join(words(5, 40) + passage + words(6, 10)), "the " * 200, "x y " * 150, " ".join(words(7, 30_000)),
            " ".join(words(7, 30_000)[:29_000]), "é" * 300, "z" * 20_000, " nbsp\u0085  x\x00y 日本語 テキスト 👍🏽",
            " ".join(base + base), "!!! ??? ... ,,,", "1 22 333 4444"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with awkward texts, a NULL id, NULLs in other columns, and one row twice."""
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(awkward_texts())]
    rows += [(None, "no id here at all", None, None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text) if text else []


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def texts_of(frame) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def brute_components(rows: list[tuple], percent: int = 80) -> dict:
    """{doc_id: (set size, component)} by comparing all sets that share a shingle."""
    sets = {}
    for i, t in rows:
        w = split_words(ascii_lower(t)) if t else []
        sets[i] = frozenset(tuple(w[k: k + 5]) for k in range(max(len(w) - 4, min(1, len(w)))))
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def brute_removal(rows: list[tuple], window: int = 50) -> dict:
    """{doc_id: (words, removed, kept text)}."""
    first: dict = {}
    for i, t in rows:
        w = split_words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k: k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in rows:
        w = split_words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k: k + window])] < i:
                gone[k: k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def brute_hits(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """{doc_id: (words, hit words, items)}."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t)) if t else []

    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[k: k + window])].add(str(item))
    sizes, out = {len(k) for k in windows}, {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k: k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(found))
    return out
