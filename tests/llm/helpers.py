from __future__ import annotations

from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, kept string, keep_bitmap string, digest string"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
BASE = " ".join(f"b{i}" for i in range(120))


def near(n: int, changed: int) -> str:
    """BASE with `changed` words replaced, others for each n."""
    words = BASE.split()
    for k in range(changed):
        words[(n * 17 + k * 23) % len(words)] = f"x{n}y{k}"
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """Nulls, empties, a very long text, ties, repeated rows, near copies; extra columns whose names clash with outputs."""
    shared = "This line is long enough to count as one."
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "Hello   World"), (5, "hello world"), (6, "hello world"), (7, LONG), (8, LONG),
        (9, shared + "\nfirst"), (10, "  " + shared.upper() + " \nsecond\n" + shared), (11, shared), (11, shared), (None, shared), (None, "null id " + BASE),
        (12, "one two"), (13, "one two"), (14, "Ｆｕｌｌ ｗｉｄｔｈ é"), (15, "full width é"), (16, "a\nb\n\n"), (17, "漢字 İΣ   x"),
        *((100 + n, near(n, n % 7)) for n in range(60)), *((300 + n, BASE) for n in range(40)),
    ]
    return [(i, t, "en" if i and i % 2 else None, f"src{(i or 0) % 20}" if i != 12 else None, None, "x", "x", "x", "x", "x") for i, t in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(5)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def components(ids: list, linked) -> dict:
    """Smallest reachable id by brute force over all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def by_id(rows, key="doc_id") -> dict:
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
