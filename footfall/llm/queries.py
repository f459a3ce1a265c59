"""The registered queries of this subpackage, and SQL for the same answers where SQL can express them."""

import corpus_pipeline
from footfall.llm.decontaminate import decontaminate_query
from footfall.llm.exact_dedup import EXACT_SQL, exact_query
from footfall.llm.html_text import html_query
from footfall.llm.language_id import language_query
from footfall.llm.lexical_search import RANKED_SQL, ranked_query
from footfall.llm.lsh_forest import nearest_query
from footfall.llm.mixing import MIXING_SQL, mixing_query
from footfall.llm.near_dup import near_dup_query
from footfall.llm.pii import pii_query
from footfall.llm.pitman_yor import scoring_query
from footfall.llm.quality import quality_query
from footfall.llm.subvector_clusters import CLUSTERS_SQL, clusters_query
from footfall.llm.warc_audit import AUDIT_SQL, audit_query

QUERIES = {
    "op1_html_text": html_query,
    "op2_language_id": language_query,
    "op3_quality": quality_query,
    "op4_lsh_forest": nearest_query,
    "op5_near_dup": near_dup_query,
    "op6_mixing": mixing_query,
    "op7_pii": pii_query,
    "op8_warc_audit": audit_query,
    "op9_pitman_yor": scoring_query,
    "op10_decontaminate": decontaminate_query,
    "op11_lexical_search": ranked_query,
    "op12_subvector_clusters": clusters_query,
    "op13_exact_dedup": exact_query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op6_mixing": MIXING_SQL,
    "op8_warc_audit": AUDIT_SQL,
    "op11_lexical_search": RANKED_SQL,
    "op12_subvector_clusters": CLUSTERS_SQL,
    "op13_exact_dedup": EXACT_SQL,
}
