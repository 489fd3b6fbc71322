"""Small corpora and plain reference computations for the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def vocabulary(rnd, n=400):
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def sentence(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def edited(rnd, text, n, words):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(words)
    return " ".join(w)


def near_copies(seed=1, bases=12, copies=14):
    """(doc_id, text): groups of copies of growing distance, exact copies, short, empty and null texts."""
    rnd = random.Random(seed)
    words = vocabulary(rnd)
    texts = []
    for _ in range(bases):
        base = sentence(rnd, words, rnd.randint(20, 160))
        texts.append(base)
        for k in range(copies):
            texts.append(edited(rnd, base if k % 3 else texts[-1], rnd.randint(0, 6), words))
        texts += [base, base.upper() if base.isascii() else base]
    texts += ["one two", "one two", "One  two", "one", "", None, " \n\t ", "x " * 40, "x " * 60]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
