"""Token ids of whole texts, cached by chunk.

The tokenizers used here never join characters across a space or a line feed, so a text's ids are the
concatenation of the ids of the chunks between them. Each Python worker keeps the ids of the chunks it has
met; only new chunks go through the tokenizer. ``encode`` therefore returns exactly what encoding the whole
text returns (tests compare both).
"""

from __future__ import annotations

import os

import numpy as np

MAX_CACHED_CHUNKS = 1_000_000
PUNCTUATION = ",.!?;:%*#&$"
_ENCODERS: dict[str, ChunkEncoder] = {}


class ChunkEncoder(dict):
    """Chunk -> its ids as little-endian bytes (unsigned 16 bits where the vocabulary allows, else 32)."""

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = id_dtype(self.tokenizer.get_vocab_size(with_added_tokens=True))

    def __missing__(self, chunk: str) -> bytes:
        """Punctuation after an ASCII letter is a token run of its own unless an apostrophe or a special token's sign is in
        it, and ASCII letters are lower-cased by the tokenizer, so variants of a chunk share one call."""
        word = chunk.rstrip(PUNCTUATION)
        if word != chunk and word and word[-1].isascii() and word[-1].isalpha():
            ids = self[word] + self[chunk[len(word) :]]
        elif chunk.isascii() and "<" not in chunk and chunk != (lower := chunk.lower()):
            ids = self[lower]
        else:
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            ids = np.array(found, dtype=self.dtype).tobytes()
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if len(self) > MAX_CACHED_CHUNKS:
            self.clear()
            self[""] = b""
        chunks = text.replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), dtype=self.dtype)


def id_dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoder(tokenizer_path: str) -> ChunkEncoder:
    """The worker's encoder for a word-level tokenizer file that lower-cases and drops white space."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def default_tokenizer() -> str:
    """Place of the installed word-level tokenizer, on whichever machine this is called."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
