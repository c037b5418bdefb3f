"""Token ids of whole texts, with the merges of each distinct word done once per worker."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters only are cut into words here; the library's own patterns agree on them in every Unicode version.
PLAIN = re.compile(f"[\\x20-\\x7e\\n\\t{LETTERS}]*")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two public vocabularies cut a text before merging (fixed by their files).
CUTS = {
    "ByteLevel": re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
    "Sequence": re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+"),
}
CACHED_WORDS = 250_000
_open: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones stand for themselves."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(other)}


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes, filled by the library's merges as words turn up."""

    def __init__(self, model) -> None:
        self.merge, self.letters = model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.merge(spelled)]).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Encodes with the tokenizers library; ids come as little-endian unsigned 32-bit bytes.

    The vocabularies cut a text into words and merge inside a word only, so ids of
    a plain text are the joined ids of its words. Other texts, and other
    vocabularies, go to the library whole, and so do texts with the content of an added token,
    which the library turns into that token's id.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        known = os.path.basename(path) in ("byte_bpe_50k.json", "word_bpe_49k.json") and sys.byteorder == "little"
        self.cut = CUTS.get(kind) if known else None
        self.lower = kind == "Sequence"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Words(self.tokenizer.model)

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self.library(texts)
        out, find, get = [], self.cut.findall, self.words.__getitem__
        for text in texts:
            if PLAIN.fullmatch(text) and not any(a in text for a in self.added):
                out.append(b"".join(map(get, find(text.lower() if self.lower else text))))
            else:
                out += self.library([text])
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; workers live on between tasks and keep it."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
