"""Token ids of whole texts with a public vocabulary file.

The vocabulary's rules never look across white space, so a text's ids are those of its words one after the other.  Texts are taken in
batches: Arrow splits them and numbers the different words, each of which is looked up once, and numpy puts the ids of all words together.
Mostly, letters A-Z are lower-cased and punctuation behind a word is cut off beforehand, which leaves fewer words.  Each worker keeps the ids of words
it has met.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 1

# Words a worker remembers (entries stay once the memory is full), and the longest of them.
REMEMBERED = 600_000
LONGEST = 48
# Bytes of text that are split at once; a longer text is cut between words.
BATCH_BYTES = 8 << 20

# Byte-level vocabularies write each byte as a printable character: itself where it is one, else the next from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

# Punctuation behind a letter is a piece of its own.  The one letter whose lower case ends in another sign is left to the tokenizer.
_TAIL = r"([^\P{L}\x{130}])([.,;:!?]+)([\x20\x09-\x0D]|$)"
# A mark may compose with a small letter and not with the capital, so texts with marks are lower-cased word by word, after composition.
# No mark's UTF-8 begins with a smaller byte.
_FIRST_MARK = 0xCC
# The vocabulary's added tokens begin like this; they count as written, before anything is lower-cased.
_ADDED = b"<|"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_TO_TEXT = pc.CastOptions(pa.string(), allow_invalid_utf8=True)
_kept: dict[str, Words] = {}


def _lower(word: bytes) -> str:
    """Lower case letter by letter, without regard to the place in the word."""
    return "".join(map(str.lower, word.decode("utf-8", "replace")))


class Words:
    """ids of a word as little-endian unsigned 32-bit integers, by the word's UTF-8 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}

    def encode(self, word: bytes) -> bytes:
        if _ADDED not in word:
            if word.isascii():
                if word.isalpha():
                    return array("I", [t.id for t in self.merge(word.lower().decode())]).tobytes()
            else:
                # A word of letters is one piece for the merges; the rest goes through the tokenizer's own rules.
                letters = _lower(word)
                if letters.isalpha() and unicodedata.is_normalized("NFC", word.decode("utf-8", "replace")):
                    written = letters.encode().decode("latin-1").translate(_BYTE_CHARS)
                    return array("I", [t.id for t in self.merge(written)]).tobytes()
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def all(self, words: list[bytes]) -> list[bytes]:
        """ids of each of ``words``."""
        found = list(map(self.known.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = self.encode(words[i])
                if len(self.known) < REMEMBERED and len(words[i]) <= LONGEST:
                    self.known[words[i]] = ids
        return found


def words_of(path: str) -> Words:
    """This worker's memory for the vocabulary at ``path``."""
    if path not in _kept:
        _kept[path] = Words(path)
    return _kept[path]


def _marked(texts: pa.Array) -> np.ndarray:
    """Which texts may hold a mark."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    signs = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    found = np.zeros(len(texts), bool)
    found[np.searchsorted(offsets - offsets[0], np.flatnonzero(signs >= _FIRST_MARK), side="right") - 1] = True
    return found


def _batch(words: Words, texts: pa.Array) -> list[bytes]:
    """ids of every text."""
    plain = pc.cast(texts, options=_TO_TEXT)
    lowered = pc.ascii_lower(plain)
    marked = _marked(texts)
    if marked.any():
        lowered = pc.if_else(pa.array(marked), plain, lowered)
    ready = pc.replace_substring_regex(lowered, _TAIL, r"\1 \2\3")
    added = pc.match_substring(texts, _ADDED)
    if pc.any(added).as_py():
        ready = pc.if_else(added, plain, ready)
    lists = pc.ascii_split_whitespace(ready)
    coded = lists.flatten().dictionary_encode()
    found = words.all(coded.dictionary.cast(pa.binary()).to_pylist())
    pool = np.frombuffer(b"".join(found), np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at = coded.indices.to_numpy()
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    # Where in the pool the ids of each word of each text are.
    places = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - lengths), lengths)
    places += np.arange(len(places))
    ids = pool[places]
    cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
    return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _cut(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + BATCH_BYTES)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def encoded(words: Words, texts: pa.Array, end_id: int = END_ID) -> Iterator[bytes]:
    """For each of ``texts`` (binary, no NULLs) its ids and the end id, four bytes each."""
    end = end_id.to_bytes(4, "little")
    totals = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(totals, totals[at] + BATCH_BYTES, side="right")) - 1
        if to <= at:
            yield b"".join(ids for part in _cut(texts[at].as_py()) for ids in _batch(words, pa.array([part], pa.binary()))) + end
            to = at + 1
        else:
            for ids in _batch(words, texts.slice(at, to - at)):
                yield ids + end
        at = to


def encode(words: Words, text: bytes, end_id: int = END_ID) -> bytes:
    """The same for one text."""
    return next(encoded(words, pa.array([text], pa.binary()), end_id))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
