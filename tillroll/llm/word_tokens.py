"""Token ids of whole texts for a ``tokenizers`` file that drops white space.

The pre-tokenizer of such a file (letters, single digits, marks, contractions)
never joins two white-space separated words, and its normalizer works inside a
word, so the ids of a text are the ids of its words, one after the other.  Each worker keeps the ids of the words that
it has met (a bounded cache) and asks the library for new words only.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tillroll.llm.common import RaggedTable, Symbols, ragged_take

#: The cache of a worker starts anew beyond so many words or characters.
CACHE_WORDS = 600_000
CACHE_CHARS = 16_000_000

#: ``str.split`` also splits at these, the library's white space doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, one per process, without threads of its own."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def library_ids(path: str, words: list[str]) -> list[list[int]]:
    t = tokenizer(path)
    return [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]


def _classes() -> np.ndarray:
    """Of each byte: white space, letter, digit, apostrophe, other ASCII mark,
    or a byte next to which nothing is cut."""
    of = np.full(256, OTHER, np.uint8)
    of[0x21:0x7F] = MARK
    of[[32, *range(9, 14)]] = SPACE
    of[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
    of[ord("0"):ord("9") + 1] = DIGIT
    of[ord("'")] = APOSTROPHE
    return of


SPACE, LETTER, DIGIT, APOSTROPHE, MARK, OTHER = range(6)
CLASS = _classes()
#: Between which classes the pre-tokenizer always cuts: around each digit, from
#: a letter to a mark, and from a mark to a letter unless it is an apostrophe,
#: which may begin a contraction.
CUTS = np.zeros((6, 6), bool)
CUTS[DIGIT, LETTER:OTHER] = CUTS[LETTER:OTHER, DIGIT] = True
CUTS[LETTER, APOSTROPHE:OTHER] = CUTS[MARK, LETTER] = True
LOWER = bytes(range(256)).lower()


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in a row, cut in arrays at the white space of ASCII
    and where the pre-tokenizer cuts anyway, with A-Z in lower case, and how
    many words stand before each text.  Whatever else is to be cut or lowered
    the library does.  Texts that may hold special strings are cut at white
    space only and keep their case."""
    joined = b"\n".join(texts)
    special = b"<|" in joined
    raw = np.frombuffer(joined if special else joined.translate(LOWER), np.uint8)
    kind = CLASS[raw]
    inside = kind != SPACE
    starts = inside.copy()
    if len(raw):
        starts[1:] &= ~inside[:-1] if special else ~inside[:-1] | CUTS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    starts = np.flatnonzero(starts)
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, np.count_nonzero(inside)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, first)


#: Words handed to the library in one text, blanks between them.
JOINED = 512
ONE_PIECE = frozenset("0123456789")
MARKS = bytes(b for b in range(0x21, 0x7F) if CLASS[b] == MARK).decode()
_ENDS: dict[str, np.ndarray] = {}


def ends_of(path: str) -> np.ndarray:
    """Of each id whether its token ends a piece of the pre-tokenizer."""
    if path not in _ENDS:
        vocabulary = tokenizer(path).get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _ENDS[path] = ends
    return _ENDS[path]


def is_one_piece(word: str) -> bool:
    """Whether the pre-tokenizer leaves the word whole: letters, a digit, marks."""
    return word.isalpha() and word.lower().isalpha() or word in ONE_PIECE or not word.strip(MARKS)


def rows_of_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word in a row, and their numbers.  Words that are one
    piece are encoded many at a time; a text that doesn't come back with one
    piece a word is encoded word by word."""
    ends = ends_of(path)
    whole = [i for i, w in enumerate(words) if is_one_piece(w)]
    single = sorted(set(range(len(words))) - set(whole))
    groups = [whole[s:s + JOINED] for s in range(0, len(whole), JOINED)]
    flat, lens, order = [], [], []
    for group, ids in zip(groups, library_ids(path, [" ".join(words[i] for i in g) for g in groups]), strict=True):
        row = np.array(ids, np.uint32)
        last = np.flatnonzero(ends[row])
        if len(last) != len(group) or len(row) != last[-1] + 1:
            single += group
            continue
        flat.append(row)
        lens.append(np.diff(last, prepend=-1))
        order += group
    for i, ids in zip(single, library_ids(path, [words[i] for i in single]), strict=True):
        flat.append(np.array(ids, np.uint32))
        lens.append(np.array([len(ids)]))
        order.append(i)
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    lens = np.concatenate(lens)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    ids, _ = ragged_take(np.concatenate(flat), np.append(0, np.cumsum(lens)), place)
    return ids, lens[place]


class WordIds:
    """Ids of the words of many texts; ``encode`` takes a list of texts and
    returns all their ids in a row, with the offsets of the texts."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.symbols, self.table = Symbols(), RaggedTable(np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.symbols) > CACHE_WORDS or self.symbols.chars > CACHE_CHARS:
            self._clear()
        words, before = cut_words([t.encode() for t in texts])
        coded = words.dictionary_encode()
        numbers = self.symbols.number(coded.dictionary.cast(pa.large_string()).to_pylist())
        self.table.extend_flat(*rows_of_words(self.path, self.symbols.take_fresh()))
        ids, at = self.table.take(numbers[coded.indices.to_numpy()])
        return ids, at[before]
