"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .embedding_dedup import op10_embedding_dedup
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import op3_exact_dedup
from .html_extract import op7_html_extract
from .ngram_join import op9_ngram_join
from .packing import op4_best_fit_packing
from .quality import op1_quality
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op2_toxicity
from .url_filter import SQL as URL_SQL
from .url_filter import op5_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_exact_dedup, op4_best_fit_packing, op5_url_filter, op6_bpe, op7_html_extract, op8_suffix_dedup, op9_ngram_join, op10_embedding_dedup)
}
ORACLES = {"op3_exact_dedup": EXACT_SQL, "op5_url_filter": URL_SQL}
