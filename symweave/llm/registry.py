"""Queries of this subpackage, and their SQL where there is any."""

from .chat_format import OP6_SQL, op6_prefix_target
from .conversation_repair import op11_conversation_repair
from .cutting_stock import op13_cutting_stock
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .hilbert_sharding import op2_hilbert_sharding
from .language_ppm import op8_language_ppm
from .line_quality import op1_line_quality
from .pattern_packing import op5_pattern_packing
from .periodic_runs import op12_periodic_runs
from .pii_information import op4_information_pii
from .sentencepiece_backend import op10_sentencepiece_backend
from .simhash import op9_simhash
from .toxicity_cnn import op7_toxicity_cnn

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_quality, op2_hilbert_sharding, op3_exact_dedup, op4_information_pii, op5_pattern_packing,
        op6_prefix_target, op7_toxicity_cnn, op8_language_ppm, op9_simhash, op10_sentencepiece_backend,
        op11_conversation_repair, op12_periodic_runs, op13_cutting_stock,
    )
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op6_prefix_target": OP6_SQL}
