"""Queries of this folder; collected by the repository's entry module when the folder is there."""

from __future__ import annotations

from .bpe import op8_bpe_round
from .embeddings import op10_embedding_classes
from .langid import op9_language
from .linequality import op3_line_quality
from .metrictrees import OP13_SQL, op13_vector_codes
from .packing import op1_pack_documents
from .partenum import op12_spelling_variants
from .rules import op7_quality_rules
from .sharding import op4_shard_documents
from .simhash import op6_simhash_classes
from .tokencount import op2_token_counts
from .urllists import OP5_SQL, op5_url_lists
from .winnowing import OP11_SQL, op11_decontamination

QUERIES = {
    "op1_pack_documents": op1_pack_documents,
    "op2_token_counts": op2_token_counts,
    "op3_line_quality": op3_line_quality,
    "op4_shard_documents": op4_shard_documents,
    "op5_url_lists": op5_url_lists,
    "op6_simhash_classes": op6_simhash_classes,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe_round": op8_bpe_round,
    "op9_language": op9_language,
    "op10_embedding_classes": op10_embedding_classes,
    "op11_decontamination": op11_decontamination,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}

#: Operators that SQL can express.
ORACLES: dict[str, str] = {"op5_url_lists": OP5_SQL, "op11_decontamination": OP11_SQL, "op13_vector_codes": OP13_SQL}
