"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .block_search import OP11_SQL, op11_ranked_search
from .chat_format import OP9_SQL, op9_chat_format
from .jaccard_join import op6_ngram_jaccard_join
from .language_id import op2_language_id
from .near_vectors import op8_embedding_near_dedup
from .packing import op4_lexical_packing
from .pattern_packing import op13_best_fit_packing
from .sentencepiece_codec import op5_sentencepiece
from .spelling_variants import OP12_SQL, op12_spelling_variants
from .substring_dedup import op1_substring_dedup
from .topk_search import OP7_SQL, op7_topk_search
from .toxicity import op3_toxicity
from .warc_index import op10_warc_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_language_id, op3_toxicity, op4_lexical_packing, op5_sentencepiece, op6_ngram_jaccard_join,
        op7_topk_search, op8_embedding_near_dedup, op9_chat_format, op10_warc_index, op11_ranked_search, op12_spelling_variants, op13_best_fit_packing,
    )
}

ORACLE_SQL: dict[str, str] = {"op7_topk_search": OP7_SQL, "op9_chat_format": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_spelling_variants": OP12_SQL}
