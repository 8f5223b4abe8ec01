"""Token ids of whole texts with a public byte-level BPE, fast enough for a corpus. Helpers for tasks; no Spark here.

Byte-level BPE splits a text into pieces before it merges bytes, and a blank followed by visible text always begins a new
piece. So a text falls apart at such blanks, and each part ("chunk") has the same ids wherever it stands. A piece also ends
between a letter and a mark or digit, and between a line break and a letter: what ends a word is a chunk without blank. Chunks are kept
with their ids, in two generations so that memory stays bounded; what is new goes through the library. Single texts with
runs of blanks, and chunks beyond plain Latin text, go through the library's own encoder whole.

A column of texts is cut in its bytes, where runs of blanks stay with the word before them. Equal chunks of some megabytes are
looked up once, and Arrow gathers their ids; new ones go through the library many at once, as they stand side by side.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks and pieces kept with their ids by a task, twice at most (old and new generation).
KEPT_CHUNKS = 600_000
#: Texts of a column are taken in slices of about so many bytes, or one text.
SLICE_BYTES = 8 << 20
#: Where a column's chunks and their ids take more, those that the slice does not hold are forgotten.
KNOWN_BYTES = 32 << 20
#: New chunks that go through the library at once.
JOINED_CHUNKS = 1000
DEFAULT_FILE = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


#: Letters of plain Latin text. A chunk that begins with BARE has no blank before it.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
BARE = "\0"
_after_letter = re.compile(f"[\n!-@[-`{{-~×÷](?<=[{LATIN}].)", re.DOTALL).sub
_after_line = re.compile(f"\n(?<=[{BARE}!-~À-ɏ]\n)(?=[{LATIN}])").sub


def apart(text: str) -> list[str]:
    """The chunks of a text without BARE; the first one has no blank before it either."""
    return _after_line(f"\n {BARE}", _after_letter(rf" {BARE}\g<0>", text)).split(" ")


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    """Whether each byte lies in one of the ranges, both ends included."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low:high + 1] = True
    return found


_LETTER = _bytes_in((65, 90), (97, 122))
_MARK = _bytes_in((33, 126), (10, 10)) & ~_LETTER
_LATER = _bytes_in((0x80, 0xBF))
_ENDS_LETTER = _LETTER | _LATER
#: First bytes of À to ȿ, and of spaces beyond ASCII.
_LATIN = _bytes_in((0xC3, 0xC8))
_MAY_BE_SPACE = _bytes_in(*((c.encode()[0],) * 2 for c in map(chr, range(128, 0x10000)) if c.isspace()))
_VISIBLE = _bytes_in((33, 126), (0xC2, 0xF4))
_NO_CHUNKS, _NO_IDS = pa.array([], pa.string()), pa.array([], pa.large_binary())


def _places(values: pa.Array) -> np.ndarray:
    """Where each string or binary value begins in the bytes of an array, and where the last one ends."""
    large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    if not len(values):
        return np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[1], "<i8" if large else "<i4")[values.offset:values.offset + len(values) + 1].astype(np.int64)


def _row(values: pa.Array) -> np.ndarray:
    """The bytes of all values, one after the other."""
    places, data = _places(values), values.buffers()[2]
    return np.frombuffer(data, np.uint8)[places[0]:places[-1]] if places[0] < places[-1] else np.zeros(0, np.uint8)


def _latin_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter of two bytes, À to ȿ without × and ÷, begins at each place."""
    first, second = data[at], data.take(at + 1, mode="clip")
    return _LATIN[first] & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)))


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin in the UTF-8 bytes of texts one after the other; offsets has the start of each and the last one's end."""
    starts = np.zeros(len(data), bool)
    blank = np.flatnonzero(data[:-1] == 32)
    visible = _VISIBLE[data[blank + 1]]
    for i in np.flatnonzero(_MAY_BE_SPACE[data[blank + 1]]).tolist():
        visible[i] = not data[blank[i] + 1:blank[i] + 4].tobytes().decode(errors="ignore")[:1].isspace()
    starts[blank[visible]] = True
    ends = offsets[1:]
    starts[ends[ends > 0] - 1] = False  # What comes after a text's last blank is another text.
    mark = np.flatnonzero(_MARK[data[1:]] & _ENDS_LETTER[data[:-1]]) + 1
    starts[mark[_LETTER[data[mark - 1]] | _latin_letter(data, mark - 2)]] = True
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[_LETTER[data[line + 1]] | _latin_letter(data, line + 1)]
    before = data[line - 1]
    starts[line[((before > 32) & (before < 127)) | (_LATER[before] & _LATIN[data[line - 2]])] + 1] = True
    starts[offsets[:-1][offsets[:-1] < ends]] = True
    return np.flatnonzero(starts)


class _Odd(Exception):
    """The text can't be cut at its blanks."""


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    letters = {b: chr(b) for b in plain}
    return [letters.get(b) or chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """A dict that makes what it lacks, in two generations: when it is full, the old half goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= KEPT_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Chunks:
    def __init__(self, tokenizer):
        import public_tokenizers
        import regex

        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.plain = re.compile("[\n!-~À-ɏ]+").fullmatch
        # The letters that a plain text begins with, and the rest.
        self.halves = re.compile(f"([{LATIN}]*)([\n!-~À-ɏ]*)").fullmatch
        self.letters = dict(enumerate(_byte_letters()))
        self.pieces, self.chunks, self.ends = _Kept(self.of_piece), _Kept(self.of_chunk), _Kept(self.of_end)

    def of_chunk(self, chunk: str) -> bytes:
        """The ids of a blank and the chunk, or of what follows BARE."""
        if chunk[:1] == BARE:
            end = chunk[1:]
            return self.of_end(end) if self.plain(end) else _bytes(self.tokenizer.encode(end, add_special_tokens=False).ids)
        halves = self.halves(chunk)
        if halves:
            # Letters are one piece whatever follows, and nothing in the pattern looks back: words and what ends them are kept apart.
            word, end = halves.groups()
            if not end:
                if not word:
                    raise _Odd
                return self.of_piece(" " + word)
            if word:
                return self.chunks[word] + self.ends[end]
            if end[0] == "\n":
                raise _Odd
            return self.of(" " + chunk)
        if chunk[0].isspace():
            raise _Odd
        return _bytes(self.tokenizer.encode(" " + chunk, add_special_tokens=False).ids)

    def of_end(self, end: str) -> bytes:
        """The ids of what ends a word: a single mark is a piece."""
        return self.pieces[end] if len(end) == 1 else self.of(end)

    def of(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def of_piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelt = piece.replace(" ", "Ġ")
        else:
            spelt = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelt)]).tobytes()


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit integers, without special tokens added."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = _Chunks(self.tokenizer)
        self.whole = not self._cuttable()
        # Letters of each token's spelling, one for each byte.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.known, self.known_ids = _NO_CHUNKS, _NO_IDS

    def _cuttable(self) -> bool:
        """Whether this vocabulary is byte-level BPE as described above: tried on a text with all kinds of pieces."""
        text = "It's the 3rd (try), isn't it?\nÜber-all: x=1; A, 42%\n\nend. naïve"
        return self.ids(text, cut=True) == _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Drops what is kept. A task calls it at its end: Python workers stay alive, and other stages need the memory."""
        for kept in (self.chunks.chunks, self.chunks.pieces, self.chunks.ends):
            kept.clear()
            kept.old = {}
        self.known, self.known_ids = _NO_CHUNKS, _NO_IDS

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column without nulls, as unsigned 32-bit integers."""
        if self.whole:
            yield from (np.frombuffer(self.ids(t), "<u4") for t in texts.to_pylist())
            return
        at = _places(texts)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
            yield from self._slice(texts.slice(first, last - first))
            first = last

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        data, places = _row(texts), _places(texts)
        places -= places[0]
        starts = chunk_starts(data, places)
        cut = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        chunks = pa.StringArray.from_buffers(len(starts), cut, pa.py_buffer(data)).dictionary_encode()
        number = pc.fill_null(pc.index_in(chunks.dictionary, self.known), -1).to_numpy()
        new = number < 0
        if self.known.nbytes + self.known_ids.nbytes > KNOWN_BYTES:
            used = pa.array(number[~new])
            self.known, self.known_ids = self.known.take(used), self.known_ids.take(used)
            number = np.cumsum(~new) - 1
        number = np.where(new, np.cumsum(new) - 1 + len(self.known), number).astype(np.int32)
        lacked = chunks.dictionary.filter(pa.array(new))
        self.known_ids = pa.concat_arrays([self.known_ids, self._encoded(lacked)])
        self.known = pa.concat_arrays([self.known, lacked])
        found = self.known_ids.take(pa.array(number[chunks.indices.to_numpy()]))
        ids, bounds = _row(found).view("<u4"), (_places(found)[np.searchsorted(starts, places)] // 4).tolist()
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        for i, whole in enumerate(special.tolist()):
            yield np.frombuffer(self.ids(texts[i].as_py()), "<u4") if whole else ids[bounds[i]:bounds[i + 1]]

    def _encoded(self, chunks: pa.Array) -> pa.Array:
        """The ids of chunks. Those that begin with a blank and visible text stay apart wherever they stand: the library gets many as one text."""
        places, data = _places(chunks), np.append(_row(chunks), np.zeros(2, np.uint8))
        first = places[:-1] - places[0]
        second = data[first + 1]
        together = (np.diff(places) > 1) & (data[first] == 32) & _VISIBLE[second] & ~_MAY_BE_SPACE[second]
        order, n = np.argsort(~together, kind="stable"), int(together.sum())
        chunks = chunks.take(pa.array(order))
        parts = [self._together(chunks.slice(i, min(JOINED_CHUNKS, n - i))) for i in range(0, n, JOINED_CHUNKS)]
        return pa.concat_arrays([*parts, self._alone(chunks.slice(n))]).take(pa.array(np.argsort(order)))

    def _together(self, chunks: pa.Array) -> pa.Array:
        text, places = _row(chunks).tobytes().decode(), _places(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        reached = np.append(0, np.cumsum(self.lengths[ids]))
        bounds = np.searchsorted(reached, places - places[0])
        # A vocabulary that joins chunks, or makes more or less of their bytes, gets them one by one.
        if any(t in text for t in self.added) or reached[-1] != places[-1] - places[0] or (reached[bounds] != places - places[0]).any():
            return self._alone(chunks)
        return pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(4 * bounds.astype(np.int64)), pa.py_buffer(ids)])

    def _alone(self, chunks: pa.Array) -> pa.Array:
        return pa.array([self.chunks.of_chunk(BARE + c) for c in chunks.to_pylist()], pa.large_binary())

    def ids(self, text: str, cut: bool | None = None) -> bytes:
        if not (cut or not self.whole) or BARE in text or any(t in text for t in self.added):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        head, *chunks = apart(text)
        try:
            rest = b"".join(map(self.chunks.chunks.__getitem__, chunks))
        except _Odd:
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not head:
            return rest
        if self.chunks.plain(head):
            return self.chunks.of(head) + rest
        return _bytes(self.tokenizer.encode(head, add_special_tokens=False).ids) + rest
