"""Small fixtures with nulls, empty texts, ties, repeats and clashing columns, and plain versions of the operators."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def texts(n=60, seed=3):
    """Texts of invented words with copies, near copies, shared passages, odd white space, runs and empty ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "über", "the", "The"]
    out = [None, "", " \t\n ", "one", "two words", "a " * 60]
    passage = " ".join(r.choices(vocabulary, k=30))
    while len(out) < n:
        kind = r.random()
        if kind < 0.15 and len(out) > 8:
            out.append(r.choice(out[6:]))
        elif kind < 0.35 and len(out) > 8:
            w = (r.choice(out[6:]) or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind < 0.5:
            out.append(" ".join(r.choices(vocabulary, k=40)) + "\n" + passage + "  " + r.choice(vocabulary))
        else:
            out.append(r.choice([" ", "\n", "  "]).join(r.choices(vocabulary, k=r.randint(1, 200))))
    return out


def documents(spark, values, extra=True):
    rows = [(i, t, f"src{i % 3 if i % 5 else 0}" if i % 7 else None, "x", 1) for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fp string, id int")
    return df if extra else df.select("doc_id", "text", "source")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
