"""Tokenizers of a worker process: each file is loaded once, however many tasks the process runs."""

from __future__ import annotations

import os
from functools import cache

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Texts that are encoded at once: the encodings of one call are all held.
ENCODED_AT_ONCE = 2_048


@cache
def byte_level(path: str, plain_specials: bool = False) -> Tokenizer:
    """The tokenizer of a .json file; with ``plain_specials`` the strings of special tokens are ordinary text."""
    loaded = Tokenizer.from_file(path)
    loaded.no_padding()
    loaded.no_truncation()
    loaded.encode_special_tokens = plain_specials
    return loaded


@cache
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    """The processor of a .model file."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
