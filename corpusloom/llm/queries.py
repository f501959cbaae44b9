"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import ann, chat_format, decontam, licences, near_dups, near_vectors, pieces, pii, prefix_trie, quality, suffix_dedup, url_filter, whitening

QUERIES = {
    "op1_decontaminate": decontam.query,
    "op2_classify_quality": quality.query,
    "op3_encode_pieces": pieces.query,
    "op4_scan_licences": licences.query,
    "op5_find_pii": pii.query,
    "op6_filter_urls": url_filter.query,
    "op7_format_chats": chat_format.query,
    "op8_remove_repeats": suffix_dedup.query,
    "op9_near_duplicates": near_dups.query,
    "op10_nearest_vectors": ann.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_near_vectors": near_vectors.query,
    "op13_whiten_vectors": whitening.query,
}

SQL = {
    "op1_decontaminate": decontam.SQL,
    "op4_scan_licences": licences.SQL,
    "op6_filter_urls": url_filter.SQL,
    "op7_format_chats": chat_format.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
}
