"""Public tokenizers applied through a table of words already seen, for Arrow tasks.

A text is cut only where its tokens must end: the file's own rules never join anything across such
a place, so the ids of the parts, put together, are the ids of the text. A worker keeps one table
for each file; it is emptied when it holds `most` entries, which changes no result.
"""

from __future__ import annotations

import codecs
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MOST_WORDS = 500_000
#: For two tables side by side.
MOST_OF_TWO = 200_000
#: Texts are taken together up to this many characters, to look new words up in one call.
TOGETHER = 1 << 20

_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Full stops and commas between a letter and white space stand alone in each of the files.
_WORD = re.compile(rf"{_LETTER}++(?=[.,]*(?:[ \t-\r]|\Z))|[^ \t-\r]+")
#: Cut before a lone blank between two other characters, and before such full stops and commas of a
#: part that is otherwise all letters; white space of any kind else is not cut.
_CHUNK = re.compile(rf" {_LETTER}++(?=[.,]*+(?: \S|\Z))|[.,]++(?= \S|\Z)|(?:\s+\S*|\S+)(?:(?! \S)\s+\S*)*")
_TAIL = re.compile(rf"{_LETTER}[.,]")
_LATIN = re.compile(rf" ?{_LETTER}+")
_TABLES: dict = {}


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def words_of(text: str) -> list[str]:
    """Runs between ASCII blanks."""
    return _WORD.findall(text)


def chunks_of(text: str) -> list[str]:
    """Parts of a text that begins with a blank; together they are the text."""
    return _CHUNK.findall(text)


def batches(rows, length):
    """Lists of rows whose lengths add up to about TOGETHER."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += length(row)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def as_bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def slices(data: bytes, stops: np.ndarray) -> list[bytes]:
    """The parts of the data that end at the stops."""
    stops = stops.tolist()
    return [data[x:y] for x, y in zip([0, *stops[:-1]], stops)]


class Table:
    """Word to the bytes of its ids (little-endian, 32 bits each)."""

    most = MOST_WORDS

    def __init__(self):
        self.known: dict[str, bytes] = {}
        #: Bytes of each id, where they are known, and the parts that their ids don't give back.
        self.token_bytes: list[bytes] = []
        self.odd: set[str] = set()

    def learn(self, words: set) -> None:
        fresh = words.difference(self.known)
        if not fresh:
            return
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            self.odd.clear()
            fresh = words
        self.add(fresh)
        if self.token_bytes:
            self.odd.update(self.not_given_back(list(fresh)))

    def add(self, fresh) -> None:
        raise NotImplementedError

    def not_given_back(self, words: list[str]) -> list[str]:
        """Words of another length than their ids' bytes; the others are compared in one go, or each if that fails."""
        found = [self.known[w] for w in words]
        sizes = np.cumsum(self.lengths[np.frombuffer(b"".join(found), "<u4")])
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        made = np.diff(np.concatenate([[0], sizes])[stops], prepend=0)
        same = (made == np.fromiter(map(len, map(str.encode, words)), np.int64, len(words))).tolist()
        odd = [w for w, s in zip(words, same, strict=True) if not s]
        rest = [w for w, s in zip(words, same, strict=True) if s]
        if not self.gives_back(self.encode(rest), "".join(rest)):
            odd += [w for w in rest if not self.gives_back(self.known[w], w)]
        return odd

    def gives_back(self, ids: bytes, text: str) -> bool:
        return b"".join([self.token_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]) == text.encode()

    def encode(self, parts: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, parts))


class BpeTable(Table):
    """A byte-pair file. `lead` tells by an id whether it begins a joined word, `end` whether it ends one."""

    def __init__(self, file: bytes, plain_specials: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = plain_specials
        # Words come here once, so the file's own table would be filled for nothing.
        self.tokenizer.model._resize_cache(0)
        # The same merges for joined words, whose rules of the file are applied here: they are cut at blanks only.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.entries = [""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.entries[number] = entry
        self.ends = np.array([e.endswith("</w>") for e in self.entries])
        self.leads = np.array([e.startswith("Ġ") for e in self.entries])

    def add(self, fresh) -> None:
        joined = [w for w in fresh if self.joins(w)]
        if joined:
            self.known.update(zip(joined, self.split(joined), strict=True))
        rest = [w for w in fresh if w not in self.known]
        for word, made in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = as_bytes(made.ids)

    def joined_ids(self, text: str) -> np.ndarray:
        """Ids of words of Latin letters between single blanks; a line break stands for a blank that is encoded."""
        spelled = codecs.charmap_decode(text.encode(), "strict", _SPELLED)[0]
        return np.array(self.letters.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")


class WordTable(BpeTable):
    """The file with word ends: white space is dropped and letters are lower-cased."""

    def __init__(self, file: bytes):
        super().__init__(file, plain_specials=False)

    def joins(self, word: str) -> bool:
        return _LATIN.fullmatch(word) is not None

    def split(self, words: list[str]) -> list[bytes]:
        """Words that differ in case only are encoded once."""
        lower = [w.lower() for w in words]
        fresh = list(dict.fromkeys(lower))
        made = dict(zip(fresh, self.split_lower(fresh), strict=True))
        return [made[w] for w in lower]

    def split_lower(self, words: list[str]) -> list[bytes]:
        ids = self.joined_ids(" ".join(words))
        return slices(ids.tobytes(), 4 * (np.flatnonzero(self.ends[ids]) + 1))


class ByteTable(BpeTable):
    """The byte-level file; the strings of its special tokens are plain text."""

    most = MOST_OF_TWO

    def __init__(self, file: bytes):
        super().__init__(file, plain_specials=True)
        self.token_bytes = [_byte_level(e) for e in self.entries]
        self.lengths = np.array([len(b) for b in self.token_bytes])

    def joins(self, word: str) -> bool:
        return word[0] == " " and _LATIN.fullmatch(word) is not None

    def split(self, words: list[str]) -> list[bytes]:
        ids = self.joined_ids("".join(words).replace(" ", " \n")[1:])
        return slices(ids.tobytes(), 4 * np.append(np.flatnonzero(self.leads[ids])[1:], len(ids)))


class PieceTable(Table):
    """The sentencepiece file. A chunk's leading blank is the one that the library puts before a text."""

    most = MOST_OF_TWO

    def __init__(self, file: bytes):
        import sentencepiece

        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        if any("▁" in p.lstrip("▁") or _TAIL.search(p) for p in pieces):
            raise ValueError("a piece spans the end of a word, so texts can't be cut there")
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(b) for b in self.token_bytes])

    def add(self, fresh) -> None:
        fresh = list(fresh)
        blank, tails = [w for w in fresh if w[0] == " "], [w for w in fresh if w[0] != " "]
        found = self.processor.encode([w[1:] for w in blank], num_threads=1)
        stops = 4 * np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.known.update(zip(blank, slices(as_bytes(list(chain.from_iterable(found))), stops), strict=True))
        # No piece spans a letter and a stop, so the first piece here is the letter's.
        for word, ids in zip(tails, self.processor.encode(["a" + w for w in tails], num_threads=1), strict=True):
            self.known[word] = as_bytes(ids[1:])


def _byte_level(entry: str) -> bytes:
    """Bytes of a byte-level entry; entries with other characters (special tokens) are read as text."""
    try:
        return bytes(_LETTERS[c] for c in entry)
    except KeyError:
        return entry.encode()


def _letters() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


_LETTERS = _letters()
#: By byte, how the byte-level entries spell it; blanks stay, and line breaks become the blanks' letter.
_SPELLED = "".join(sorted(_LETTERS, key=_LETTERS.__getitem__)).replace("Ġ", " ").replace("Ċ", "Ġ")


def table(kind: type, file: bytes) -> Table:
    """This worker's table of a file."""
    key = (kind, hash(file))
    if key not in _TABLES:
        _TABLES[key] = kind(file)
    return _TABLES[key]
