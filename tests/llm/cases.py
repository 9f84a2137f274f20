"""Small tables with awkward rows, and plain versions of the operators."""

import random
import re
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts(seed=1):
    """Texts with near and exact copies, shared passages, short, empty and null ones, wide characters and a very long one."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñ漢") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 160))) for _ in range(25)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = list(base)
    for b in base[:8]:
        for k in (1, 3, 12):
            w = b.split(" ")
            for _ in range(k):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += [base[0], base[0], base[1].replace(" ", "\n\t", 3), base[2].upper()]
    out += [f"{base[i]} {passage} {base[i + 1]}" for i in range(9, 14)]
    out += [None, "", "", " \t\n", "one", "one", "One two three", "one two three four five", "x" * 3000, "漢" * 200, "a " * 400, "\u0000 nul \u0001", " ".join(r.choice(words) for _ in range(30000))]
    return out


def documents(spark, seed=1):
    rows = [(i, t, "en" if i % 2 else None, None, -1, "x", "y", 0, 0.5) for i, t in enumerate(texts(seed))]
    rows += [rows[3], rows[3], (None, "text of no id", *rows[0][2:])]
    # names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string, cls string, n long, score double").repartition(3)


def empty(spark):
    return documents(spark).limit(0)


def shingles(text, k=5):
    w = SPACED.findall(lower(text))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, percent=80):
    """{id: (size, component)} of (id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def hits(text, items, k=10):
    """(words, words hit, items) of a text."""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    w = ALNUM.findall(lower(text))
    hit, names = [False] * len(w), set()
    for n in {len(x) for x in windows}:
        for a in range(len(w) - n + 1):
            found = windows.get(tuple(w[a : a + n]))
            if found:
                names |= found
                hit[a : a + n] = [True] * n
    return len(w), sum(hit), sorted(names)


def repeats(rows, least=50):
    """{id: spans} of words that lie in a passage of `least` words with another occurrence."""
    words = {i: SPACED.findall(lower(t)) for i, t in rows}
    seen = Counter(tuple(w[a : a + least]) for w in words.values() for a in range(len(w) - least + 1))
    out = {}
    for i, w in words.items():
        spans = []
        for a in range(len(w) - least + 1):
            if seen[tuple(w[a : a + least])] > 1:
                if spans and a <= spans[-1][0] + spans[-1][1]:
                    spans[-1][1] = a + least - spans[-1][0]
                else:
                    spans.append([a, least])
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out
