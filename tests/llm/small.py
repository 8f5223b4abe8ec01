"""Small document tables with the awkward cases, and plain versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, g int, component string, bucket string"

_A = " ".join(f"alpha{i} beta{i % 7} of the gamma{i % 13}" for i in range(60))
_B = " ".join(f"ere{i} bele{i % 5} un die delta{i % 11}" for i in range(80))
AWKWARD = [
    (1, _A, "en", "s1"), (2, _A, "en", "s1"), (3, _A.replace("alpha7 ", "ALPHA7x "), "en", None), (4, _B, "fr", "s2"),
    (5, None, "en", "s1"), (6, "", None, "s1"), (7, "   \n\t ", "en", "s1"), (8, "two words", "en", "s1"), (9, "two words", "fr", "s2"),
    (10, "a", None, None), (11, "£$%&*** ### |||", "en", "s1"), (12, "line one is here\n" * 30, "en", "s2"), (13, _B + " " + _A, "fr", "s1"),
    (14, "é" * 5000 + " ü " + "x " * 3000, "fr", "s2"), (15, "tail " + _B[100:900] + " head", "fr", "s2"), (16, "-" * 700, None, "s1"),
]


def documents(spark, rows=AWKWARD):
    """The rows with further columns whose names the operators use themselves."""
    full = [(d, t, lang, s, None if t is None else len(t), "x", 1, "y", "z") for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(rows, n=3, percent=85):
    sets, parent, held, links = {d: shingles(t, n) for d, t in rows}, {d: d for d, _ in rows}, defaultdict(list), 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        both = Counter()
        for g in sets[d]:
            both.update(held[g])
            held[g].append(d)
        for e, k in both.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def window_removal(rows, n=35):
    all_words = {d: words(t) for d, t in rows}
    count = Counter(tuple(w[i:i + n]) for w in all_words.values() for i in range(len(w) - n + 1))
    found = {}
    for d, w in all_words.items():
        gone = {j for i in range(len(w) - n + 1) if count[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        found[d] = len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return found


def byte_removal(rows, n=100):
    seen, found = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone, end = bytearray(len(raw)), 0
        for i in range(len(raw) - n + 1):
            if raw[i:i + n] in seen:
                for j in range(max(i, end), i + n):
                    gone[j] = 1
                end = i + n
            seen.add(raw[i:i + n])
        runs = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        found[d] = len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()
    return found
