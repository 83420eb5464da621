"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, filter_audit, fingerprints, html_text, lm_scoring, near_dedup, packing, pieces, quality, suffix_dedup, token_files, warc, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_warc": warc.op2_warc,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_files": token_files.op5_token_files,
    "op6_quality": quality.op6_quality,
    "op7_html_text": html_text.op7_html_text,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_pieces": pieces.op13_pieces,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_warc": warc.OP2_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
