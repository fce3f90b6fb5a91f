"""op4: every piece of every document, packed."""

import public_tokenizers

from .common import table
from .packing import packed_pieces


def op4_pack(spark, sf_dir):
    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
