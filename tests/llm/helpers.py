"""Small tables and plain versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size int, word_ int, row_ int, copies int, v string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


def frame(spark, rows):
    """A table of documents with columns whose names clash with those that operators use inside.
    rows: tuples of doc_id, text, lang, source, as many of them as are given."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else None, 1, "x", 2, 3, 4, 5, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(rng):
    """Nulls, empty, wordless and very long texts, repeated rows, null ids."""
    long = prose(rng, 40_000)
    return [
        (1, None, None, None), (2, "", "en", "b"), (3, " \t\n", "en", "a"), (4, "one two", "en", "a"), (5, "one TWO", "fr", None),
        (6, long, "en", "c"), (7, long + " end", "en", "c"), (8, "x" * 300_000, "en", "c"), (9, prose(rng, 80), None, "a"),
        (10, "été naïve 中文 \U0001f642 don't  stop", "fr", "\U0001f642"), (10, "été naïve 中文 \U0001f642 don't  stop", "fr", "\U0001f642"),
        (None, "no id here, but five words", "en", "a"), (None, None, None, None), (11, "1234 5678", None, "b"),
    ]


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(rows, percent):
    """doc_id -> (shingles, component) by comparing all with all; ids are distinct."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(rng, n_families=8, size=12):
    """Documents in families of near copies: hubs whose copies are unlike each other, chains, exact copies."""
    rows, i = [], 100
    for f in range(n_families):
        base = prose(rng, 120).split()
        for k in range(size):
            w = list(base)
            if f % 3 == 0 and k:  # each its own edits: near the base, less near each other
                for _ in range(1 + k % 3):
                    w[rng.randrange(len(w))] = f"edit{rng.random()}"
            elif f % 3 == 1:  # a chain of edits
                base[rng.randrange(len(base))] = f"step{k}"
                w = list(base)
            rows.append((i, " ".join(w).upper() if k % 4 == 0 else " ".join(w), "en", "a"))
            i += 1
    rows += [(i + k, prose(rng, rng.randrange(1, 60)), "en", "b") for k in range(60)]
    rng.shuffle(rows)
    return rows


def rng(seed=0):
    return random.Random(seed)
