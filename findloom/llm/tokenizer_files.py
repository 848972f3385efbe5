"""Where the public vocabulary files are; operators take the path as a parameter."""

from __future__ import annotations

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
