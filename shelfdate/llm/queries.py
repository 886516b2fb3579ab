"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from .chat import OP6_SQL, op6_snapshot_collapse
from .embeddings import op3_pruned_graph
from .imatch import op7_imatch_fingerprints
from .language import op1_language_bitmask
from .language_model import op5_log_frequency_bloom
from .main_text import op11_main_text
from .minhash import op8_minhash_components
from .mixing import op9_length_count_mix
from .packing import op4_deficit_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .ranked_search import OP12_SQL, op12_accumulator_search
from .sql import OP2_SQL, OP3_SQL, OP8_SQL
from .substrings import op2_window_repeats
from .toxicity import op10_ordinal_toxicity

QUERIES = {
    "op1_language_bitmask": op1_language_bitmask,
    "op2_window_repeats": op2_window_repeats,
    "op3_pruned_graph": op3_pruned_graph,
    "op4_deficit_packing": op4_deficit_packing,
    "op5_log_frequency_bloom": op5_log_frequency_bloom,
    "op6_snapshot_collapse": op6_snapshot_collapse,
    "op7_imatch_fingerprints": op7_imatch_fingerprints,
    "op8_minhash_components": op8_minhash_components,
    "op9_length_count_mix": op9_length_count_mix,
    "op10_ordinal_toxicity": op10_ordinal_toxicity,
    "op11_main_text": op11_main_text,
    "op12_accumulator_search": op12_accumulator_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op2_window_repeats": OP2_SQL,
    "op3_pruned_graph": OP3_SQL,
    "op6_snapshot_collapse": OP6_SQL,
    "op8_minhash_components": OP8_SQL,
    "op12_accumulator_search": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
