"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from parlance.llm.brown_lm import op10_brown_lm
from parlance.llm.centroid_clusters import OP11_SQL, op11_centroid_clusters
from parlance.llm.decontaminate import op8_decontamination
from parlance.llm.embedding_dedup import LOWER_SQL, OP2_SQL, embedding_links_lower, op2_embedding_dedup
from parlance.llm.html_text import OP13_SQL, op13_html_text
from parlance.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from parlance.llm.line_dedup import op4_line_dedup
from parlance.llm.mixing import OP9_SQL, op9_source_mixing
from parlance.llm.pii import op5_pii
from parlance.llm.quality import op6_quality
from parlance.llm.secrets import op1_secrets
from parlance.llm.spelling_variants import OP12_SQL, op12_spelling_variants
from parlance.llm.token_output import op3_token_output

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_output": op3_token_output,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_source_mixing": op9_source_mixing,
    "op10_brown_lm": op10_brown_lm,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_html_text": op13_html_text,
    "embedding_links_lower": embedding_links_lower,
}

#: Where SQL is missing it can't express the operator (see tests/llm). op13's SQL reads pages of one
#: article alone; the rest of its method is held by tests.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": OP2_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_source_mixing": OP9_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_html_text": OP13_SQL,
    "embedding_links_lower": LOWER_SQL,
}
