"""The named queries of this subpackage and their SQL counterparts."""

from newsgraph.llm.chat_format import CHAT_FORMAT_SQL, op8_chat_format
from newsgraph.llm.decontaminate import op7_decontaminate
from newsgraph.llm.jaccard_join import op2_jaccard_join
from newsgraph.llm.language_id import op6_language_id
from newsgraph.llm.license_scan import LICENSE_SCAN_SQL, op9_license_scan
from newsgraph.llm.line_dedup import LINE_DEDUP_SQL, op4_line_dedup
from newsgraph.llm.packing import op10_packing
from newsgraph.llm.prefix_trie import PREFIX_TRIE_SQL, op13_prefix_trie
from newsgraph.llm.sql import DECONTAMINATE_SQL, JACCARD_JOIN_SQL, SUBSTRING_DEDUP_SQL, SUFFIX_DEDUP_SQL
from newsgraph.llm.substring_dedup import op1_substring_dedup
from newsgraph.llm.suffix_dedup import op3_suffix_dedup
from newsgraph.llm.token_files import op12_token_files
from newsgraph.llm.vector_codes import VECTOR_CODES_SQL, op11_vector_codes
from newsgraph.llm.voronoi_knn import VORONOI_KNN_SQL, op5_voronoi_knn

OP_QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_files": op12_token_files,
    "op13_prefix_trie": op13_prefix_trie,
}

OP_ORACLES = {
    "op1_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op2_jaccard_join": JACCARD_JOIN_SQL,
    "op3_suffix_dedup": SUFFIX_DEDUP_SQL,
    "op7_decontaminate": DECONTAMINATE_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op5_voronoi_knn": VORONOI_KNN_SQL,
    "op8_chat_format": CHAT_FORMAT_SQL,
    "op9_license_scan": LICENSE_SCAN_SQL,
    "op11_vector_codes": VECTOR_CODES_SQL,
    "op13_prefix_trie": PREFIX_TRIE_SQL,
}
