"""Token ids by a public word-level BPE vocabulary, with a cache of words.

The vocabulary's pre-tokenizer drops white space and cuts the rest into words,
single digits and runs of symbols, each encoded on its own.  So the ids of a
text are the ids of its space-separated tokens, and a token met before needs no
second encoding.  A new token's pieces are merged by ``tiktoken``'s core over
the same vocabulary: the word end is a byte that UTF-8 never has, joined to the
last byte before any other merge, and each vocabulary entry keeps its merge rank.

Texts with characters outside the plain range below go to the ``tokenizers``
library whole, so all ids are those of
``Tokenizer.encode(text, add_special_tokens=False)`` (tested over the corpus
tables and random texts).  Where ``tiktoken`` is absent or has changed, every text
goes to ``tokenizers``: slower, with the same ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

WORD_VOCABULARY = "word_bpe_49k.json"
WORD_END = b"\xff"

# Characters whose folding and class are the same in Python and the tokenizer:
# ASCII text, ASCII white space and the Latin-1 letters, digits and symbols.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]")
_PIECES = re.compile(
    "'(?:s|t|re|ve|m|ll|d)"                        # the vocabulary's own contractions
    "|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
    "|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\sa-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_encoder(ranks: dict[bytes, int]):
    """The function of ``tiktoken`` that merges one piece; None where the package or the function is not there."""
    try:
        import tiktoken

        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    except (ImportError, AttributeError):
        return None


class WordEncoder:
    """Encodes texts; keeps the ids of at most ``most`` tokens and starts anew beyond."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(letters[c] for c in (token[:-4] if end else token)) + WORD_END * end

        # ranks: last bytes of words first, single bytes, then the merges in their order
        entries = [c + "</w>" for c in letters if letters[c] != 255] + list(letters)
        entries += [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        self.ids = np.array([vocab.get(e, 0) for e in entries], dtype="<u4")
        ranks = {raw(e): i for i, e in enumerate(entries)}
        self.pieces_of = _piece_encoder(ranks)
        self.most = most
        self.known: dict[str, bytes] = {}

    def _learn(self, token: str) -> bytes:
        if len(self.known) >= self.most:
            self.known.clear()
        got: list[int] = []
        for piece in _PIECES.findall(token):
            got += self.pieces_of(piece.encode() + WORD_END)
        out = self.known[token] = self.ids[got].tobytes() if got else b""
        return out

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if self.pieces_of is None or _OTHER.search(text) or "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        known, learn = self.known.get, self._learn
        return b"".join([known(t) or learn(t) for t in text.lower().split()])


@lru_cache(maxsize=2)
def word_encoder(name: str = WORD_VOCABULARY) -> WordEncoder:
    """The worker's encoder; ``name`` is a vocabulary file's name, or a path with a slash."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return WordEncoder(name)
