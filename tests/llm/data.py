"""Small documents with the awkward cases, and brute-force twins."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


def word(rng):
    return "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents(seed=5):
    """Copies, near copies, chains, shared passages, repeated rows, nulls, empties, one long text."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = list(base)
    texts += rng.choices(base, k=30)  # exact copies
    long_words = sentence(rng, 200).split()
    for k in range(40):  # a chain: each differs from the one before in a place
        long_words[(k * 11) % 200] = word(rng) + "x"
        texts.append(" ".join(long_words))
    passage = sentence(rng, 30)
    texts += [f"{sentence(rng, rng.randint(5, 90))} {passage}\n{sentence(rng, rng.randint(5, 90))}" for _ in range(40)]
    texts += ["", " \t\n", None, "one", "One", "two words", "a a a a a " * 30, sentence(rng, 20000), "Ä b", "ä b",
              "x y z\x1cw"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[3], rows[3], (None, passage), (None, None)]
    return [(k, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None]), len(t) if t else 0, 0.5, True)
            for k, t in rows]


def words(text):
    return (text or "").encode().split()


def substring_kept(rows, n=13):
    """(doc_id, words, removed, kept text) per row; null ids are left alone."""
    first = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            if k is not None:
                key = tuple(w[i:i + n])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if k is not None and first[tuple(w[i:i + n])] < k:
                gone[i:i + n] = [True] * n
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(rows, percent=85):
    """doc_id -> component, by all pairs."""
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: find(k) for k, _ in sets}
