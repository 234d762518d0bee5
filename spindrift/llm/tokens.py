"""Public tokenizers, read from the files of a folder that is given as a parameter."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files; another may be named in the environment or given to the operators.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the split pattern published with the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file."""
    return os.path.join(folder or FOLDER, name)


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a file of base64 tokens and ranks; loaded once in a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
