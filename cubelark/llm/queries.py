"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import decontaminate, langid, licenses, lm, media, minhash, packing, pii, substring, toxicity

QUERIES = {
    "op1_substring_dedup": substring.query,
    "op2_media_columns": media.query,
    "media_pages": media.pages_query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_lm_scoring": lm.query,
    "op6_language_id": langid.query,
    "op7_license_scan": licenses.query,
    "op8_decontamination": decontaminate.query,
    "op9_pii": pii.query,
    "op10_minhash_dedup": minhash.query,
}
SQL = {
    "op1_substring_dedup": substring.SQL,
    "op8_decontamination": decontaminate.SQL,
}
