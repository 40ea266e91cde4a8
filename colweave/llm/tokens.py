"""Token ids from a public tokenizer file, by the fastest library that gives the same ids."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False):
    """A function from a text to its ids, as the tokenizers library gives them without added special tokens.

    The ids of a byte-level BPE follow from its ranks, so a rank file beside `path` is read into tiktoken, which takes a
    fifth of the time. Texts that hold a special token's string, and those that tiktoken refuses, go to tokenizers; with
    `ordinary` such strings are text like any other.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = ordinary
    with open(path, encoding="utf-8") as f:
        special = [] if ordinary else [t["content"] for t in json.load(f).get("added_tokens", [])]
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    fast = None
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except BaseException as e:  # a panic of the library is no Exception; interrupts are
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode
