"""The queries of the operators in this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat_format, collocations, decontaminate, language_id, lattice, license_scan, line_dedup, ngram_join, pii, piece_codec, spelling, url_filter


def queries():
    return {
        "op1_license_scans": license_scan.query,
        "op2_approximate_nearest_neighbours": ann.query,
        "op3_decontamination": decontaminate.query,
        "op4_line_dedup": line_dedup.query,
        "op5_pii": pii.query,
        "op6_url_filters": url_filter.query,
        "op7_sentencepiece": piece_codec.query,
        "op8_ngram_jaccard_join": ngram_join.query,
        "op9_chat_formatting": chat_format.query,
        "op10_language_id": language_id.query,
        "op11_spelling_variants": spelling.query,
        "op12_embedding_near_dedup": lattice.query,
        "op13_phrase_collocations": collocations.query,
    }


def oracle_sql():
    return {
        "op1_license_scans": license_scan.SQL, "op8_ngram_jaccard_join": ngram_join.SQL, "op6_url_filters": url_filter.SQL, "op9_chat_formatting": chat_format.SQL,
        "op11_spelling_variants": spelling.SQL, "op12_embedding_near_dedup": lattice.SQL, "op13_phrase_collocations": collocations.SQL,
    }
