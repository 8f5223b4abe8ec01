"""BPE round trip, periodic runs and collocations: against the library or brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from small import AWKWARD, documents, words
from twinledger.llm import bpe_codec, periodic_runs, phrases
from twinledger.llm.block_matches import PRIMES, back, transform, zero_mismatches
from twinledger.llm.bpe_words import Bounded, Merges, WordBpe, default_path
from twinledger.llm.quotient_filter import Layout, added_up, built, entries

#: Rows that repeat, one id with two texts, and no id at all.
MORE = [(None, "no id at all", "en", "s"), (None, "no id at all", "en", "s"), (1, "another text", None, "s"), (2, AWKWARD[1][1], "en", "s1")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# BPE

def test_words_encode_as_the_library_does(library):
    codec, rng = WordBpe(default_path(), room=4000), random.Random(1)
    letters = "aabcdeinorstthe  éÉßİΣς́日本\U0001F642\x00\x1c\x85　'1234.,!ǅſK<|endoftext|>\n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>́e", "it's I'LL 'S !'s", "a" * 5000, "ab" * 5000, "힣가", "á ́"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want, text
        raw, ends = codec.decode(np.array([*want, *want], np.uint32), np.array([len(want), len(want), 2 * len(want)]))
        decoded = library.decode(want, skip_special_tokens=False).encode()
        assert raw == decoded * 2 and ends.tolist() == [len(decoded), len(decoded), 2 * len(decoded)]


def plain_merging(rules, letters):
    """Merging by rank, the leftmost pair first."""
    parts = list(letters)
    while True:
        ranks = [(rules[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rules]
        if not ranks:
            return parts
        i = min(ranks)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_backtracking_is_merging_by_rank_for_any_rules():
    rng = random.Random(8)
    for _ in range(60):
        known, rules = list("abc"), {}
        for _ in range(rng.randint(1, 25)):
            pair = rng.choice(known), rng.choice(known)
            if pair[0] + pair[1] not in known and len(pair[0] + pair[1]) < 9:
                rules[pair] = len(rules)
                known.append(pair[0] + pair[1])
        merges = Merges(list("abc"), list(rules), "")
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
            assert [merges.spelt[t] for t in merges.encode(text)] == plain_merging(rules, text), (rules, text)


def test_rules_that_make_one_token_twice_are_an_error():
    with pytest.raises(ValueError):
        Merges(list("ab"), [("a", "a"), ("aa", "a"), ("a", "aa")], "")


def test_bounded_keeps_what_is_used_and_no_long_keys():
    made = []
    kept = Bounded(lambda k: made.append(k) or b"x", room=1000)
    for _ in range(3):
        for k in ("a", "b", "c"):
            assert kept[k] == b"x"
    assert made == ["a", "b", "c"]
    for i in range(50):
        kept[f"{i}"], kept["a"]
    assert made.count("a") == 1 and len(kept) + len(kept.old) < 12
    kept["y" * 65], kept["y" * 65]
    assert made.count("y" * 65) == 2


def test_round_trip_of_documents(spark, library):
    rows = AWKWARD + MORE + [(77, "long tail word " * 40_000, "en", "s"), (78, "x" * 300_000, "en", "s")]
    found = Counter(tuple(r) for r in bpe_codec.round_trip_digests(bpe_codec.decode_documents(bpe_codec.encode_documents(documents(spark, rows)))).collect())
    want = Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())] += 1
    assert found == want


# Runs

def plain_runs(w):
    found, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_transforms_multiply_exactly():
    rng = np.random.default_rng(2)
    for prime, root in PRIMES:
        x, y = rng.integers(0, prime, (2, 3, 32), dtype=np.uint64)
        got = back(transform(x, prime, root) * transform(y, prime, root) % np.uint64(prime), prime, root)
        for r in range(3):
            want = [sum(int(x[r, i]) * int(y[r, (k - i) % 32]) for i in range(32)) % prime for k in range(32)]
            assert got[r].tolist() == want


def test_zero_mismatches_with_numbers_that_need_two_primes():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 2, (20, 8)) * 10**6
    windows = np.tile(blocks, 3)[:, :23]
    windows[3, 9] += PRIMES[0][0] % 10**6
    want = [[(windows[i, k:k + 8] == blocks[i]).all() for k in range(16)] for i in range(20)]
    assert zero_mismatches(blocks, windows, 16).tolist() == want


def test_runs_equal_brute_force():
    rng, n_runs = random.Random(5), 0
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.randint(0, rng.choice((15, 40, 120, 300))), rng.choice((1, 2, 3, 5, 50))
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                if n > 4:
                    a, e = sorted(rng.randrange(n) for _ in range(2))
                    p = rng.randint(1, max(1, (n - a) // 2))
                    w[a:e] = [w[a + (i - a) % p] for i in range(a, e)]
            texts.append(w)
        want = [plain_runs(w) for w in texts]
        n_runs += sum(map(len, want))
        assert periodic_runs.runs_of(texts) == want
    assert n_runs > 300


def test_runs_of_long_texts():
    rng = random.Random(6)
    period = [b"%d" % rng.randrange(40) for _ in range(70_000)]
    assert periodic_runs.runs_of([period + period + period[:5], [b"a"] * 150_000, [b"a", b"b"] * 50_000]) == [
        [(0, 140_005, 70_000)], [(0, 150_000, 1)], [(0, 100_000, 2)]]


def planted(d, w):
    import zlib

    h = zlib.crc32(str(d).encode())
    if d is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query(spark):
    rows = AWKWARD + MORE + [(d + 100, t, lang, s) for d, t, lang, s in AWKWARD if t and len(t) < 9000] + [(7000 + d, AWKWARD[0][1], "en", "s") for d in range(90)]
    found = Counter(tuple(r) for r in periodic_runs.run_digests(
        periodic_runs.find_runs(documents(spark, rows), periodic_runs.planted_periods)).collect())
    want, n_planted = Counter(), 0
    for d, t, *_ in rows:
        w = planted(d, words(t))
        n_planted += w != words(t)
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[(d, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
              sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))] += 1
    assert found == want and n_planted > 3
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0


def test_runs_of_unchanged_texts(spark):
    r = periodic_runs.find_runs(documents(spark, [(4, "on " + "and off " * 8 + "end", "en", "s")])).first()
    assert [tuple(x) for x in r.runs] == [(1, 16, 2)] and r.n_words == 18 and r.collapsed == "on and off end"


# Phrases

@pytest.mark.parametrize("id_bits", (1, 2, 3, 15, 22, 42))
@pytest.mark.parametrize("shard_bits", (0, 3, 9))
def test_filters_give_back_what_they_hold(id_bits, shard_bits):
    rng, layout = np.random.default_rng(id_bits), Layout(id_bits, shard_bits)
    ids = rng.integers(0, 2**id_bits, (2000, 3))
    ids = np.concatenate([ids, ids[:5].repeat([1, 300, 70_000, 2, 999], 0)])
    high, low = layout.permuted(ids)
    assert (layout.ids(high, low) == ids).all()
    high, low, counts = added_up(high, low, np.ones(len(high), np.int64), layout.half)
    assert Counter(map(tuple, ids.tolist())) == dict(zip(map(tuple, layout.ids(high, low).astype(int).tolist()), counts.tolist()))
    counts[:3] = 2**24, 2**40 + 1, 2**62
    shard = high >> np.uint64(layout.rest)
    for s in np.unique(shard):
        own = shard == s
        got = entries(layout, built(layout, high[own], low[own], counts[own]))
        assert all((x == y[own]).all() for x, y in zip(got, (high, low, counts)))
    assert [len(x) for x in entries(layout, built(layout, high[:0], low[:0], counts[:0]))] == [0, 0, 0]


def plain_collocations(rows, least=10, absorbed=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    found = []
    for lang, count in f.items():
        here = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in here.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        scored = []
        for p, a in here.items():
            if 100 * longer[p] >= absorbed * a:
                continue
            s, _, left, r = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), left, r))
        for rank, (s, a, p, left, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, r, n[lang], -s))
    return sorted(found)


def test_stretches_are_the_same_in_slices():
    row = np.random.default_rng(4).integers(0, 4, 100)
    whole = phrases._grams(row, len(row))
    for size in (1, 2, 3, 7, 50, 99):
        parts = np.concatenate([phrases._grams(row[at:at + size + 2], size) for at in range(0, len(row), size)])
        assert Counter(map(tuple, parts.tolist())) == Counter(map(tuple, whole.tolist()))
    text = row.tolist()
    want = Counter((text[i], text[i + 1], 0) for i in range(99) if text[i] and text[i + 1])
    want += Counter(tuple(text[i:i + 3]) for i in range(98) if all(text[i:i + 3]))
    assert Counter(map(tuple, whole.tolist())) == want


def test_collocations_equal_brute_force(spark):
    rng = random.Random(9)
    names = ["new york", "New York City", "é ü", "the", "of", "a", "in the", "\x1codd", "x　y", "…"]
    rows = []
    for d in range(400):
        parts = [rng.choice(names) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randint(0, 60))]
        rows.append((d // 2, "".join(parts), rng.choice(["en", "fr", None]), "s"))
    rows += AWKWARD + MORE + [(9000, "so very long " * 60_000, "zz", "s")]
    for settings in (phrases.Phrases(), phrases.Phrases(least=3, top=40, block_words=500, shard_entries=64, held_entries=300)):
        found = sorted(tuple(r) for r in phrases.collocations(documents(spark, rows), settings).collect())
        assert found == plain_collocations(rows, settings.least, settings.absorbed, settings.top)
        con = duckdb.connect()
        con.register("documents", pd.DataFrame([(d, t, lang) for d, t, lang, _ in rows], columns=["doc_id", "text", "lang"]))
        assert sorted(con.execute(phrases.duckdb_sql(settings)).fetchall()) == found


def test_collocations_of_nothing(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, None, None), (2, "all once here", "en", "s")])).count() == 0
