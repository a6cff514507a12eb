"""Token ids of whole texts under the byte-level vocabulary of 50,257 entries.

The vocabulary has two public files, one for each of two libraries that give the same ids. Texts of letters, digits, ASCII signs and line
ends go through the faster one; all others, where the libraries may split white space or marks differently, and texts that could
spell a special token go through the library that the vocabulary's JSON file is for.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np

from .shared import kept_in_worker

#: The vocabulary; its files lie where public_tokenizers.path says, unless a folder is given.
VOCABULARY = "byte_bpe_50k"
#: Texts made of these only are split alike by both libraries: ASCII without control characters (but line ends), Latin letters.
_PLAIN = re.compile("[\n -~À-ÖØ-öø-ɏ]*")


def _file(name: str, folder: str | None) -> str:
    import public_tokenizers

    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


@cache
def _tokenizer(folder: str | None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_file(f"{VOCABULARY}.json", folder))


@cache
def _ranks(folder: str | None) -> dict[bytes, int]:
    with open(_file(f"{VOCABULARY}.tiktoken", folder), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def _fast(folder: str | None):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(folder), special_tokens={})


@cache
def token_bytes(folder: str | None = None) -> np.ndarray:
    """The number of bytes that each id stands for; special tokens: of their spelling."""
    sizes = np.zeros(_tokenizer(folder).get_vocab_size(), np.int64)
    for token, rank in _ranks(folder).items():
        sizes[rank] = len(token)
    for special, entry in _tokenizer(folder).get_added_tokens_decoder().items():
        sizes[special] = len(entry.content.encode())
    return sizes


for _loaded in (_tokenizer, _ranks, _fast, token_bytes):
    kept_in_worker(_loaded.cache_clear)


def encode(text: str, folder: str | None = None) -> np.ndarray:
    """The ids of a text, without added special tokens; an empty text has none."""
    if "<|" not in text and _PLAIN.fullmatch(text):
        return np.array(_fast(folder).encode_ordinary(text), np.uint16)
    return np.array(_tokenizer(folder).encode(text, add_special_tokens=False).ids, np.uint16)
