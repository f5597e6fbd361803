"""Token ids of texts, by the tokenizers library, with each distinct part of a word encoded once.

Vocabularies whose splitting pattern never joins characters across white space give
``encode(text) == encode(part_1) + encode(part_2) + ...``. For these, a worker cuts a text by the pattern
itself, remembers the ids of the parts it has met, within fixed numbers of parts and characters, and asks
the library's model for new ones only. Words with characters that composing, lower-casing or the pattern
might treat specially go through the whole library. Any other vocabulary is encoded text by text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: Parts that are remembered, and eight times as many as words that need the whole library. Longer ones than
#: LONGEST_KEPT characters aren't, so the bytes held have a bound.
KEPT = 200_000
LONGEST_KEPT = 64

# The normaliser and splitter of the public word-level vocabulary.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMAL = ["NFC", "Replace", "Lowercase"]

#: White space that ends a word, and Latin-1 characters whose composing and lower-casing are one to one.
PLAIN = r"!-~\xa1-\xac\xae-\xff"
PLAIN_TEXT = re.compile(rf"[\x20\x09-\x0D{PLAIN}]*")
PLAIN_WORD = re.compile(rf"[{PLAIN}]+")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
# The splitter, for small letters of that range.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


class Remembered(dict):
    """Values of a function by key: those of the first ``limit`` keys met.

    Later keys are computed each time they occur, as most of them are rare; after four times ``limit`` of
    these everything is forgotten and filled anew, so that other texts get other keys.
    """

    def __init__(self, make: Callable, limit: int, longest: int = LONGEST_KEPT):
        super().__init__()
        self.make, self.limit, self.longest, self.spent = make, limit, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            if len(key) <= self.longest:
                self[key] = value
        else:
            self.spent += 1
            if self.spent > 4 * self.limit:
                self.clear()
                self.spent = 0
        return value


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    table, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


def _state(part) -> dict:
    """What a part of a tokenizer consists of, without its vocabulary."""
    return json.loads(part.__getstate__()) if part is not None else {}


def _by_word(library) -> bool:
    steps = _state(library.normalizer).get("normalizers", [])
    first = (_state(library.pre_tokenizer).get("pretokenizers") or [{}])[0]
    model = library.model
    return (
        [s.get("type") for s in steps] == WORD_NORMAL
        and first.get("pattern", {}).get("Regex") == WORD_SPLIT
        and first.get("behavior") == "Removed"
        and not any(t.lstrip or t.rstrip or t.normalized for t in library.get_added_tokens_decoder().values())
        and type(model).__name__ == "BPE"
        and not model.dropout
    )


class Encoder:
    """Texts to little-endian unsigned ids: 32-bit ones, or by :meth:`coded` ones of ``width`` bytes, which
    is 2 where all ids of the vocabulary fit, else 4. A null or empty text has none."""

    def __init__(self, path: str, words_kept: int = KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.by_word = _by_word(self.library)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.model = self.library.model
        self.parts = Remembered(self._part, words_kept)
        self.words = Remembered(self._whole, max(1, words_kept // 8))

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def wide(self, coded: bytes) -> bytes:
        """The same ids as unsigned 32-bit."""
        return np.frombuffer(coded, f"<u{self.width}").astype("<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """A stretch that the splitting pattern yields, already lower-cased."""
        spelled = part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(spelled)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, PLAIN_SPLIT.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if not PLAIN_WORD.fullmatch(word) or any(s in word for s in self.special):
            return self.words[word]
        return self._plain(word)

    def __call__(self, text: str | None) -> bytes:
        return self.wide(self.coded(text))

    def coded(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        if PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join([self._word(w) for w in BLANK.split(text) if w])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a worker process keeps it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
