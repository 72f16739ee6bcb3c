"""The queries opN_<name> of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .centroids import OP12_SQL, op12_centroids
from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .line_dedup import OP7_SQL, op7_line_dedup
from .mixing import op1_mixing
from .packing import op13_packing
from .pii import op8_pii
from .simhash import op9_simhash
from .token_files import op10_token_files
from .toxicity import op5_toxicity
from .url_filter import op3_url_filter
from .winnowing import op4_winnowing

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_byte_bpe, op3_url_filter, op4_winnowing, op5_toxicity, op6_exact_dedup, op7_line_dedup, op8_pii, op9_simhash,
        op10_token_files, op11_collocations, op12_centroids,
        op13_packing,
    )
}
SQL = {"op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_collocations": OP11_SQL, "op12_centroids": OP12_SQL}
