"""The package's queries and their SQL."""

from __future__ import annotations

from . import bytes_bpe, exact_dedup, fill_middle, imatch, importance, language_id, licenses, near_dedup, packing, quality, sentencepieces, token_files, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_sentencepiece": sentencepieces.op2_sentencepiece,
    "op3_packing": packing.op3_packing,
    "op4_licenses": licenses.op4_licenses,
    "op5_warc": warc.op5_warc,
    "op6_quality": quality.op6_quality,
    "op7_token_files": token_files.op7_token_files,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_imatch": imatch.op9_imatch,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_importance": importance.op11_importance,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_byte_bpe": bytes_bpe.op13_byte_bpe,
}

ORACLES = {"op10_exact_dedup": exact_dedup.OP10_SQL, "op11_importance": importance.OP11_SQL, "op12_fill_middle": fill_middle.OP12_SQL}
