"""Where the public vocabulary files lie; their folder is a parameter."""

from __future__ import annotations

import os

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file, in ``folder`` or else in the installed ``public_tokenizers`` package."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
