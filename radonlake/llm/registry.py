"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, licenses, line_dedup, media, packing, quality, rules, secrets, simhash, token_files

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_simhash": simhash.op2_simhash,
    "op3_licenses": licenses.op3_licenses,
    "op4_token_files": token_files.op4_token_files,
    "op5_bpe": bpe.op5_bpe,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "op8_media": media.op8_media,
    "op9_quality": quality.op9_quality,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES = {"op10_line_dedup": line_dedup.OP10_SQL}
