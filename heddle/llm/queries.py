"""Registered queries of the training-data operators, and their SQL where there is one."""

from heddle.llm.merkle import OP12_SQL, op12_merkle_manifest
from heddle.llm.mixing import op5_low_discrepancy_mix
from heddle.llm.near_documents import OP6_SQL, op6_odd_sketch_minhash
from heddle.llm.near_vectors import OP4_SQL, op4_pivot_permutation
from heddle.llm.pieces import op2_sampled_pieces
from heddle.llm.ppm import op1_ppm_score
from heddle.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from heddle.llm.quality_rules import op7_ngram_ratio
from heddle.llm.secret_scan import op11_structural_secrets
from heddle.llm.sharding import op10_vector_bin_packing
from heddle.llm.substrings import OP8_SQL, op8_relative_lempel_ziv
from heddle.llm.token_planes import op9_token_planes
from heddle.llm.toxicity import op3_ftrl_toxicity

QUERIES = {q.__name__: q for q in (op1_ppm_score, op2_sampled_pieces, op3_ftrl_toxicity, op4_pivot_permutation, op5_low_discrepancy_mix, op6_odd_sketch_minhash, op7_ngram_ratio, op8_relative_lempel_ziv, op9_token_planes, op10_vector_bin_packing, op11_structural_secrets, op12_merkle_manifest, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op4_pivot_permutation": OP4_SQL, "op6_odd_sketch_minhash": OP6_SQL, "op8_relative_lempel_ziv": OP8_SQL, "op12_merkle_manifest": OP12_SQL, "op13_prefix_trie": OP13_SQL}
