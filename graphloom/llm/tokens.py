"""Token ids of whole texts by a tokenizers file, with a cache of words.

A byte-level BPE splits a text before each run of white space and treats what lies between on its
own, so the ids of a text are the ids of its pieces. Words repeat, so each Python worker keeps the
ids of the words it has met and asks the library for new ones only. Texts with unusual white space,
where the library and Python could disagree on what white space is, go to the library whole, and so
do texts with the string of a special token.

Words are kept under keys, as most pieces are one blank and a word: such a word is a key as it is, a piece
that starts with white space is its own key, and one without any before it has a mark in front. Texts are
cut many at a time, so that a word is looked up once for all of them, and new words are made together.
"""

from __future__ import annotations

import re
import struct
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

#: white space other than the ASCII kind, and characters that some engines count as such
_ODD = [
    chr(c)
    for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010))
    + (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
]
_UNEVEN = ["  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"]
_BARE = "\x1c"  # in no text that is cut, as it is one of the odd ones
_SPACE = " \t\n\x0b\x0c\r"
_PIECE = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_WORD = re.compile("[\x1c\n ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = "-.,;:!?*#%&$|)\""
_CACHE = 300_000  # words in the younger half of the cache during a task
_KEPT = 100_000  # words that a worker keeps between tasks, the ones it met first
_TOGETHER = 8_000_000  # characters of texts that are cut at once, unless one text has more
_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def together(batches: Iterable[pa.RecordBatch], chars: int = _TOGETHER) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of the rows of some batches, in their order and so many at a time; a null text is empty."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Same ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Strings of special tokens in a text are what the library takes them for.
    """

    def __init__(self, path: str, cache: int = _CACHE):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = cache
        self.words: dict[str, bytes] = {}  # ids by key
        self.old: dict[str, bytes] = {}  # the words before these
        self.cuts = (
            isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel)
            and isinstance(self.library.model, models.BPE)
            and self.library.normalizer is None
        )
        self.model = self.library.model
        self.chars = "".join(map(self._byte_level, range(256))) if self.cuts else ""
        self.packed = [_packed([k]) for k in range(self.library.get_vocab_size())] if self.cuts else []

    def _byte_level(self, byte: int) -> str:
        """How the library writes a byte."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte if byte in plain else 256 + sum(c not in plain for c in range(byte)))

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(x.ids) for x in found]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        texts = list(texts)
        out: list[bytes] = [b""] * len(texts)
        odd: list[int] = []
        even: list[int] = []
        uneven: dict[int, list[str]] = {}
        if len(self.words) > self.cache:
            self.words, self.old = {}, self.words
        every = "".join(texts)  # what is not in it is in none of them
        strange = [c for c in (*self.special, *_ODD) if c in every]
        apart = [c for c in _UNEVEN if c in every]
        del every
        for n, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or any(c in text for c in strange):
                odd.append(n)
            elif any(c in text for c in apart) or text[0] in " \n" or text[-1] in " \n":
                uneven[n] = pieces = _PIECE.findall(text)
                if pieces[0][0] not in _SPACE:
                    pieces[0] = _BARE + pieces[0]
            else:
                even.append(n)
        for n, ids in zip(even, self._even([texts[n] for n in even])):
            out[n] = ids
        keys = list(dict.fromkeys(chain.from_iterable(uneven.values())))
        known = dict(zip(keys, self._known(keys)))
        for n, pieces in uneven.items():
            out[n] = b"".join(map(known.__getitem__, pieces))
        for n, ids in zip(odd, self.whole([texts[n] for n in odd])):
            out[n] = ids
        return out

    def rest(self) -> None:
        """At the end of a task: keep the words that were met first, which tend to be frequent ones."""
        self.words, self.old = dict(islice(self.words.items(), _KEPT)), {}

    def _even(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose words are one blank or line end apart."""
        cut = pc.split_pattern(pa.array((_BARE + t.replace("\n", " \n") for t in texts), pa.large_string(), size=len(texts)), " ")
        places, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        del cut  # as all words of many texts take room
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, raw = pa.array(known, pa.large_binary()).take(coded.indices).buffers()
        ends = np.frombuffer(ends, "<i8")[places].tolist() if texts else []
        return [raw[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]

    def _known(self, keys: list[str]) -> list[bytes]:
        """Ids of the pieces with these keys, which differ."""
        words = self.words
        found = list(map(words.get, keys))
        if new := [key for key, ids in zip(keys, found) if ids is None]:
            self._learn(new)
            found = [words[key] if ids is None else ids for key, ids in zip(keys, found)]
        return found

    def _learn(self, keys: list[str]) -> None:
        """Adds new words, each step for all of them; a word, the marks after it and a line end before it are apart for the library too."""
        words, old = self.words, self.old
        made: dict[str, None] = {}  # words of letters
        rest: dict[str, None] = {}
        joined: list[tuple[str, bool, str, str]] = []
        for key, ids in zip(keys, map(old.get, keys)):
            if ids is not None:
                words[key] = ids
                continue
            word = key.rstrip(_MARKS)
            if not (word.isascii() and word.isalpha() or _WORD.fullmatch(word)):
                rest[key] = None
                continue
            marks, line = key[len(word) :], key[0] == "\n"
            if marks or line:
                word = _BARE + word[1:] if line else word
                marks = marks and _BARE + marks
                joined.append((key, line, word, marks))
                for part, parts in (word, made), (marks, rest), ("\n" if line else "", rest):
                    if part and part not in words:
                        if ids := old.get(part):
                            words[part] = ids
                        else:
                            parts[part] = None
            else:
                made[key] = None
        for key, ids in zip(rest, self.whole(list(map(_piece, rest)))):
            words[key] = ids
        tokenize, packed = self.model.tokenize, self.packed
        for key, coded in zip(made, self._coded(made)):
            words[key] = b"".join([packed[t.id] for t in tokenize(coded)])
        for key, line, word, marks in joined:
            words[key] = (words["\n"] if line else b"") + words[word] + (words[marks] if marks else b"")

    def _coded(self, keys: Iterable[str]) -> list[str]:
        """Pieces, none of which has a zero byte, as the library writes their bytes."""
        return charmap_decode("\0".join(map(_piece, keys)).encode(), "strict", self.chars)[0].split(self.chars[0])


def _piece(key: str) -> str:
    """The piece of a text that has this key."""
    return key[1:] if key[0] == _BARE else key if key[0] in _SPACE else " " + key
