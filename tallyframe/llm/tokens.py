"""Token ids of whole texts by public vocabularies."""

import array
import base64
from collections.abc import Callable
from functools import cache

import numpy as np


def byte_encoder(
    ranks_path: str, pattern: str, special: dict[str, int] | None = None
) -> Callable[[str], bytes]:
    """Function from text to its ids as little-endian unsigned 32-bit integers.

    ``ranks_path`` names a file of base64 tokens and ranks, ``pattern`` the pre-token pattern. The
    strings in ``special`` become the ids given there wherever they stand; others that look like
    special tokens are ordinary text.
    """
    import tiktoken

    special = special or {}

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    if not special:
        return lambda text: array.array("I", encoding.encode_ordinary(text)).tobytes()
    names = set(special)
    return lambda text: array.array("I", encoding.encode(text, allowed_special=names)).tobytes()


class TokenSide:
    """A tokenizer with the bytes of its tokens, built once in each task."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], table: list[bytes]):
        self.encode, self.table = encode, table
        self.sizes = np.array([len(token) for token in table], np.int64)
        self.written = cache(self._written)

    def joined(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, one after the other."""
        return b"".join(map(self.table.__getitem__, ids))

    def _written(self, mark: str) -> np.ndarray:
        """Decimal ids, each followed by a mark."""
        return np.array([f"{i}{mark}" for i in range(len(self.table))], object)


def byte_level_side(ranks_path: str, pattern: str) -> TokenSide:
    """Byte-level vocabulary of ``byte_encoder``; special tokens' strings are ordinary text."""
    encode = byte_encoder(ranks_path, pattern)
    with open(ranks_path, "rb") as lines:
        tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return TokenSide(lambda texts: [array.array("I", encode(t)).tolist() for t in texts], table)


def piece_side(model_path: str) -> TokenSide:
    """Piece model that adds a leading space: U+2581 is a space, ``<0xHH>`` a byte, and control
    pieces stand for nothing but their own name."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def token(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("\u2581", " ").encode()

    table = [token(i) for i in range(model.get_piece_size())]
    return TokenSide(lambda texts: model.encode(texts, num_threads=1), table)
