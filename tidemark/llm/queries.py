"""Queries of the training-data operators and, where SQL can express them, the SQL."""

from __future__ import annotations

from .decontaminate import op1_decontaminate
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .kmeans_tree import op8_kmeans_tree
from .packing import op9_packing, op10_token_matrices
from .pii import op7_pii
from .quality import op5_quality
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .toxicity import op2_toxicity
from .warc import OP4_SQL, op4_warc_archive

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc_archive": op4_warc_archive,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii": op7_pii,
    "op8_kmeans_tree": op8_kmeans_tree,
    "op9_packing": op9_packing,
    "op10_token_matrices": op10_token_matrices,
}

ORACLE_SQL = {"op3_suffix_dedup": OP3_SQL, "op4_warc_archive": OP4_SQL, "op6_jaccard_join": OP6_SQL}
