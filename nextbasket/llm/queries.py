"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard, lines, lm, mpeg, negatives, packing, resample, secrets, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_media_mpeg": mpeg.op1_media_mpeg,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_secrets": secrets.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_lm_score": lm.op7_lm_score,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_packing": packing.op9_packing,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_resample": resample.op11_resample,
    "op12_negatives": negatives.op12_negatives,
    "op13_simhash": simhash.op13_simhash,
}
ORACLE_SQL = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op11_resample": resample.OP11_SQL,
    "op12_negatives": negatives.OP12_SQL,
}
