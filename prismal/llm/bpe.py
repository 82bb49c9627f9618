"""Byte-pair encoding of whole texts with the tokenizers library, one encoding per distinct chunk.

A text is cut only where the tokenizer's own splitter always cuts, so encoding the chunks one by one gives the ids
of the whole text. Chunks repeat (words do), hence a bounded cache per Python worker.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Characters with the Unicode property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of these letters, and of these signs, are whole pieces for either splitter if nothing but the other, white space or the end follows.
LATIN, SIGNS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "-.,;:!?$#*%&()"
#: byte: a blank goes with the word after it, other white space stands alone. word: white space is dropped.
CHUNKS = {
    "byte": re.compile(f" ?[{LATIN}]+(?![^ \\n{SIGNS}])| ?[{SIGNS}]+(?![^ \\n{LATIN}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "word": re.compile(f"[{LATIN}]+(?![^ \\n{SIGNS}])|[{SIGNS}]+(?![^ \\n{LATIN}])|[^ \\t\\n\\r]+"),
}
#: The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on.
SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(b if b in SEEN else 256 + sum(x not in SEEN for x in range(b))) for b in range(256)}
#: Longer chunks are encoded each time, so that the cache's size is bounded in bytes too.
LONGEST = 48


class Encoder:
    """ids of texts as little-endian bytes; width 2 where every id of the vocabulary fits, else 4."""

    def __init__(self, path: str, kind: str, cached: int = 800_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # a control token's name inside a text stays ordinary text
        self.tokens = self.tok.model.tokenize
        # no added token could be found inside a word, and no normalizer changes its bytes
        self.direct = all(t.special for t in self.tok.get_added_tokens_decoder().values()) and (kind == "word" or self.tok.normalizer is None)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.kind, self.find = kind, CHUNKS[kind].findall
        self.cached = cached
        self.lead = 1 if kind == "byte" else 0
        self.cache = Chunks(self)

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def one(self, chunk: str) -> bytes:
        """The ids of a chunk. A word of letters is what the model gets of it, so it goes there; all else goes through the whole tokenizer."""
        word = chunk[self.lead :]
        if self.direct and word.isalpha() and chunk[: self.lead] in ("", " "):
            if self.kind == "byte":
                return self.pack([t.id for t in self.tokens("Ġ" + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)))])
            if word.isascii():
                return self.pack([t.id for t in self.tokens(word)])
        return self.pack(self.tok.encode(chunk, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "word":  # that tokenizer lowers case itself; doing so for A-Z first leaves fewer distinct chunks
            texts = [t.encode().lower().decode() for t in texts]
        get = self.cache.__getitem__
        return [b"".join(map(get, self.find(t))) for t in texts]


class Chunks(dict):
    """Ids by chunk, filled as chunks are asked for."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.one(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.encoder.cached:
                self.clear()
            self[chunk] = ids
        return ids


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per Python worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary(name: str) -> str:
    """Path of a file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)
