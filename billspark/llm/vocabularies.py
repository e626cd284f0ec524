"""Places of public vocabulary files; they are read where they are and never copied."""

from __future__ import annotations

import public_tokenizers

#: Byte-level BPE with 50,257 ids.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Its end-of-document id.
END_OF_DOCUMENT = 50256
