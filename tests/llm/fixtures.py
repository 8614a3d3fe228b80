"""Small tables with every awkward case, and brute-force versions of the operators."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward(seed=3, n=60):
    """Rows of documents: prose, exact and near copies, shared passages, runs, nulls, empties, a long text, repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(n)]
    base = prose(rng, 120)
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    texts += [base] * 5 + [prose(rng, 20) + "\n" + passage + " " + prose(rng, 30) for _ in range(4)]
    texts += ["same " * 100, "a b " * 60, "", "  \n\t ", "one two three", "one two three", "ONE two  three", None, "é ü " * 30, "x" * 5000, prose(rng, 5000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0], None, None, None), (None, None, None, None, None)]


def words(text, fold=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text)


def shingle_set(text):
    w = words(text, True)
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(rows, percent=75):
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        for j, k in Counter(j for g in sets[i] for j in index[g]).items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            index[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows, n=35):
    all_words = [words(t) for _, t, *_ in rows]
    count = Counter(tuple(w[k : k + n]) for w in all_words for k in range(len(w) - n + 1))
    out = []
    for (i, *_), w in zip(rows, all_words, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def leaks(rows, items):
    bags = []
    for item, t in items:
        w = words(t, True)
        if w:
            k = min(5, len(w))
            bags.append((item, k, Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))))
    out = set()
    for i, t, *_ in rows:
        w = words(t, True)
        for item, k, bag in bags:
            m = sum(bag.values())
            s = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            width = min(m, len(s))
            for a in range(len(s) - width + 1 if width else 0):
                both = sum((Counter(s[a : a + width]) & bag).values())
                if 100 * both >= 75 * (m + width - both):
                    out.add((i, item))
                    break
    return out


def base_rules(text):
    w = words(text)
    count = Counter(zip(*[w[k:] for k in range(5)], strict=False))
    cover = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
        seen.add(line)
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover), failed
