"""The queries this subpackage registers, and their SQL."""

from . import collocations, langid, license_scan, line_dedup, mih, mixing, mtree, near_dup, packing, quality, simhash, spelling, window_dedup

QUERIES = {f.__name__: f for f in (
    mtree.op1_mtree_topk,
    mih.op2_multi_index_hashing,
    license_scan.op3_license_sentences,
    quality.op4_bradley_terry_quality,
    packing.op5_length_buckets,
    near_dup.op6_circulant_minhash,
    mixing.op7_pareto_mixing,
    langid.op8_hyperdimensional_language,
    line_dedup.op9_winnowed_lines,
    window_dedup.op10_count_min_windows,
    collocations.op11_prefix_growth_collocations,
    simhash.op12_deletion_variant_simhash,
    spelling.op13_errata_trie_spelling,
)}

ORACLES = {
    "op1_mtree_topk": mtree.ORACLE,
    "op3_license_sentences": license_scan.ORACLE,
    "op6_circulant_minhash": near_dup.ORACLE,
    "op7_pareto_mixing": mixing.ORACLE,
    "op9_winnowed_lines": line_dedup.ORACLE,
    "op10_count_min_windows": window_dedup.ORACLE,
    "op11_prefix_growth_collocations": collocations.ORACLE,
}
