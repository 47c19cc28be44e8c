"""Token ids of the byte-level BPE vocabulary, as the ``tokenizers`` library gives them.

Texts in the Latin range go through the merge ranks of the same vocabulary, which give the same ids several times
faster; every other text, and a text with a very long run without blanks, goes through the library itself.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

VOCABULARY, RANKS, END = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"
#: Code points of the fast way; runs of other characters than blanks that it takes.
_OTHER, LONGEST_RUN = re.compile("[^\x00-ɏ]"), 2000
_RUN = re.compile(r"[^ \n]{%d}" % LONGEST_RUN)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None, ranks: str | None = None):
    """A function from text to an array of ids (uint32). Paths default to the installed public files."""
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    @functools.cache
    def slow():  # a worker that meets no such text doesn't load it
        return Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))

    with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={END: len(merges)})

    def encode(text: str) -> np.ndarray:
        if (not text.isascii() and _OTHER.search(text)) or (len(text) >= LONGEST_RUN and _RUN.search(text)):
            return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)

    return encode
