"""Where vocabulary files of public tokenizers are found."""

from __future__ import annotations

import os


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name in the folder of the installed public tokenizers."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
