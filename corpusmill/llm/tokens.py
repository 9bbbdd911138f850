"""Token ids of a published byte-level BPE vocabulary, by the tokenizers library.

A byte-level BPE encodes each pre-token by itself, so a text's ids are its pre-tokens' ids in order. For texts of
Latin-1 characters the pre-tokens come from the vocabulary's own split pattern and each distinct pre-token goes
through the library once per worker; other texts, and texts that hold a special token's string, go through the library whole.
So does every text where the vocabulary's settings are not those that this split is made for.
"""

from __future__ import annotations

import json
import re

#: The split pattern of the vocabulary's byte-level pre-tokenizer, with its Unicode classes written out
#: for Latin-1 and the word branch first (no other branch can start where it matches).
LETTER, DIGIT, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PATTERN = f" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct pre-tokens held by a worker before it starts anew: bounds memory, not results.
HELD = 500_000
END = 2
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Pre-token -> its ids as little-endian uint32 bytes; what is not there yet goes through the library's model."""

    def __init__(self, library) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(256)}  # the library's spelling of a character's bytes
        self.model = library.model
        self.words = [i.to_bytes(4, "little") for i in range(library.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= HELD:
            self.clear()
        ids = self[piece] = b"".join([self.words[t.id] for t in self.model.tokenize(piece.translate(self.spelling))])
        return ids


def splits_plainly(settings: dict) -> bool:
    """Whether a vocabulary is a plain byte-level BPE: no normalizer, the byte-level split without a leading space, no other model options."""
    split, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    return bool(plain and settings.get("normalizer") is None and model["type"] == "BPE" and not any(model.get(k) for k in options))


class Encoder:
    """encode(text) -> little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path())
        self.known = splits_plainly(json.loads(self.library.to_str()))
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.split = re.compile(PATTERN).findall
        self.held = _Pieces(self.library)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.held.__getitem__, self.split(text)))


_held: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each vocabulary and worker."""
    path = path or vocabulary_path()
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
