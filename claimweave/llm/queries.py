"""The queries of this subpackage and the SQL for those that SQL can state."""

from .ann import op8_nearest
from .bpe import op4_byte_bpe
from .chat import OP9_SQL, op9_chat_format
from .decontaminate import OP2_SQL, op2_decontaminate
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .line_dedup import OP7_SQL, op7_line_dedup
from .lm import op5_lm_score
from .near_dedup import op6_minhash
from .phrases import OP11_SQL, op11_phrases
from .quality import op13_quality
from .token_counts import OP10_SQL, op10_token_counts
from .toxicity import op1_toxicity
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_minhash": op6_minhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_nearest": op8_nearest,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
    "op11_phrases": op11_phrases,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality": op13_quality,
}
ORACLE_SQL = {
    "op2_decontaminate": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_token_counts": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
