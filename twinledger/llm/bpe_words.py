"""Byte-pair encoding of words by backtracking over longest matches, and decoding by an offset table. Helpers for tasks; no Spark here.

A word is spelt in the letters of its bytes, the last one being another symbol than the same letter inside a word. Every merge
of the vocabulary makes one token, so a token's number is its rank. A sequence of tokens is what merging by rank gives exactly
if each pair of neighbours is compatible, that is, if merging would not have joined anything across their border earlier. So a
word is covered from the left by the longest token at each place, shortened or taken back where a pair is not compatible; no
place is entered twice with the same state, which keeps the time linear in the word's length.
"""

from __future__ import annotations

import json

import numpy as np

from .tokenizing import _byte_letters

DEFAULT_FILE = "word_bpe_49k.json"
#: Code points between a letter inside a word and the same letter at its end.
_LAST = 0x1000
#: Pairs of tokens whose compatibility is kept.
MOST_PAIRS = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class Bounded(dict):
    """A dict that makes what it lacks. Keys of at most `longest` characters are kept, in two generations of `room` bytes each:
    when the new one is full it becomes the old one, and what is still used comes back from there."""

    def __init__(self, make, room: int, longest: int = 64):
        super().__init__()
        self.make, self.room, self.longest, self.held, self.old = make, room, longest, 0, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= self.longest:
            size = 200 + 4 * len(key) + len(got)
            if self.held + size > self.room:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += size
            self[key] = got
        return got


class _Followers(dict):
    """Which tokens may follow a token; found out when asked for."""

    def __init__(self, merges: "Merges", token: int):
        super().__init__()
        self.merges, self.token = merges, token

    def __missing__(self, token: int) -> bool:
        merges = self.merges
        if merges.n_pairs >= MOST_PAIRS:
            merges.n_pairs = 0
            for row in merges.followers:
                row.clear()
        merges.n_pairs += 1
        self[token] = got = self.token < 0 or merges.undisturbed(self.token, token, len(merges.left))
        return got


class Merges:
    """The merge rules of a vocabulary. Symbols come first, in the order given, then one token per rule, so numbers are ranks."""

    def __init__(self, symbols: list[str], rules: list[tuple[str, str]], end: str):
        import ahocorasick

        self.end = end
        number: dict[str, int] = {}
        for s in symbols:
            number.setdefault(self.spell(s), len(number))
        self.n_symbols = len(number)
        self.left, self.right, self.joined = list(range(len(number))), list(range(len(number))), {}
        for a, b in rules:
            x, y, made = number[self.spell(a)], number[self.spell(b)], self.spell(a) + self.spell(b)
            if made in number:
                raise ValueError(f"two rules make {made!r}: ranks of tokens are not those of rules")
            number[made] = len(number)
            self.joined[x, y] = number[made]
            self.left.append(x)
            self.right.append(y)
        self.spelt = list(number)
        self.length = [len(t) for t in self.spelt]
        # A token that merging its own text does not give is never in a result.
        whole = [True] * len(number)
        for t in range(self.n_symbols, len(number)):
            a, b = self.left[t], self.right[t]
            whole[t] = whole[a] and whole[b] and self.undisturbed(a, b, t)
        self.longest = ahocorasick.Automaton()
        for t, text in enumerate(self.spelt):
            if whole[t]:
                self.longest.add_word(text[::-1], t)
        self.longest.make_automaton()
        # One row per token, and one more for the start of a word, which has the number -1.
        self.followers, self.n_pairs = [_Followers(self, t) for t in [*range(len(number)), -1]], 0
        # The longest shorter token that a token begins with, -1 if there is none.
        self.shorter = [-1] * len(number)
        self.whole = {text: t for t, text in enumerate(self.spelt) if whole[t]}
        for t, text in enumerate(self.spelt):
            for cut in range(len(text) - 1, 0, -1):
                if text[:cut] in self.whole:
                    self.shorter[t] = self.whole[text[:cut]]
                    break

    def spell(self, text: str) -> str:
        """One character per symbol: the last letter of a word, with its ending, is a character of its own."""
        if self.end and text.endswith(self.end) and len(text) > len(self.end):
            inner = text[:-len(self.end)]
            return inner[:-1] + chr(ord(inner[-1]) + _LAST)
        return text

    def undisturbed(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of rank under `before` joins something across the border of a and b, both merged by themselves."""
        left, right, joined = self.left, self.right, self.joined
        while True:
            over = joined.get((a, b))
            if over is not None and over < before:
                return False
            # Undo the later of the two merges at the border; what lies across it must then be of a lower rank.
            if a > b:
                if a < self.n_symbols:
                    return True
                before, a = min(before, a), right[a]
            else:
                if b < self.n_symbols:
                    return True
                before, b = min(before, b + 1), left[b]

    def encode(self, letters: str) -> list[int]:
        """The tokens of one word given by its letters."""
        n = len(letters)
        if not n:
            return []
        text = letters[:-1] + chr(ord(letters[-1]) + _LAST) if self.end else letters
        if text in self.whole:
            return [self.whole[text]]
        # Read backwards, the automaton ends at each place with the tokens that begin there, the longest first.
        best = dict(list(self.longest.iter(text[::-1]))[::-1])
        length, shorter, followers = self.length, self.shorter, self.followers
        tokens: list[int] = []
        place, last, token = 0, -1, best.get(n - 1, -1)
        dead = set()
        while place < n:
            allowed = followers[last]
            while token >= 0 and (not allowed[token] or place + length[token] in dead):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                place += length[token]
                last, token = token, best.get(n - 1 - place, -1)
            else:
                if last < 0:
                    raise ValueError("a letter is not in the vocabulary")
                dead.add(place)
                token = tokens.pop()
                place -= length[token]
                last = tokens[-1] if tokens else -1
        return tokens


class WordBpe:
    """Encoding and decoding with a vocabulary file of the tokenizers library: BPE over byte letters with a word ending.

    Normalising and cutting into words are the library's own steps, done once per blank-free stretch of text; merging is `Merges`.
    """

    _made: dict[str, "WordBpe"] = {}

    def __init__(self, path: str, room: int = 160 << 20):
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, added = given["model"], given["added_tokens"]
        end = model.get("end_of_word_suffix") or ""
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in rules}
        symbols = sorted((t for t in model["vocab"] if t not in made), key=model["vocab"].get)
        self.merges = Merges(symbols, rules, end)
        of_spelling = {self.merges.spell(t): i for t, i in model["vocab"].items()}
        self.ids = [of_spelling[s].to_bytes(4, "little") for s in self.merges.spelt]
        self.added = {t["content"]: t["id"] for t in added}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens with conditions are not supported")
        self.stops = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        # The offset table: all tokens' texts in one row of bytes, each followed by the blank that parts tokens.
        texts = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.added.items()}}
        spelt = [texts.get(i, "").encode() + b" " for i in range(max(texts, default=-1) + 1)]
        self.lengths = np.array([len(s) for s in spelt], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.row = np.frombuffer(b"".join(spelt), np.uint8)
        self.stretches = Bounded(self._stretch, room // 2)
        usual = self._is_usual(given)
        self.plain = regex.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch if usual else None
        self.simple = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
        self.letters = dict(enumerate(_byte_letters()))

    @classmethod
    def at(cls, path: str) -> "WordBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _is_usual(given: dict) -> bool:
        """Whether the file's own steps, on plain Latin text without blanks, are lower case and the pattern of `simple`: such text
        holds no letter that composes with another or has a lower case of more than one letter."""
        steps = given["normalizer"].get("normalizers", []), given["pre_tokenizer"].get("pretokenizers", [])
        return [s["type"] for s in steps[0]] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps[1]] == ["Split", "ByteLevel"] and (
            steps[0][1]["pattern"] == {"Regex": r"\s+"}
            and steps[1][0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})

    def _word(self, letters: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.merges.encode(letters)))

    def _stretch(self, text: str) -> bytes:
        """The ids of text without an added token."""
        if not text:
            return b""
        if self.plain is None or not self.plain(text):
            return b"".join([self._word(letters) for letters, _ in self.cut(self.normalize(text))])
        text = text.lower()
        # Pieces are stretches themselves, and kept as such.
        if text.isalpha() or len(pieces := self.simple(text)) == 1:
            return self._word(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))
        return b"".join(map(self.stretches.__getitem__, pieces))

    def _plain(self, text: str) -> bytes:
        """No word holds a blank, so each stretch between blanks stands alone."""
        return b"".join(map(self.stretches.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.stops is None or not any(t in text for t in self.added):
            return self._plain(text)
        out = []
        for part in self.stops.split(text):
            known = self.added.get(part)
            out.append(np.array([known], "<u4").tobytes() if known is not None else self._plain(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The texts of consecutive id sequences that end at `ends`: their bytes in a row, and where each text ends."""
        sizes = self.lengths[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        # Each byte's place in the row: one step on from the byte before, with a jump where a token begins.
        where = np.ones(int(stops[-1]), np.int64)
        if len(ids):
            begins = self.places[ids]
            where[0] = begins[0]
            where[stops[1:-1]] = begins[1:] - (begins[:-1] + sizes[:-1] - 1)
        taken = self.row[np.cumsum(where)]
        # The blank after a text's last token goes.
        closing = stops[ends]
        full = np.diff(np.concatenate([[0], ends])) > 0
        keep = np.ones(len(taken), bool)
        keep[closing[full] - 1] = False
        return taken[keep].tobytes(), closing - np.cumsum(full)
