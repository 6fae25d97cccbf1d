"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fablake.llm import (
    codebooks,
    decontaminate,
    divergence,
    langid,
    licenses,
    linededup,
    neardup,
    packing,
    quality,
    revisits,
    sharding,
    toxicity,
    urlrules,
)

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_warc_revisits": revisits.op7_warc_revisits,
    "op8_packing": packing.op8_packing,
    "op9_url_filters": urlrules.op9_url_filters,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_vector_codes": codebooks.op11_vector_codes,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_toxicity": toxicity.op13_toxicity,
}

#: Learned models, tokenizers and hash trees have no SQL form; tests hold those queries against brute force.
ORACLE = {
    "op5_line_dedup": linededup.ORACLE,
    "op7_warc_revisits": revisits.ORACLE,
    "op9_url_filters": urlrules.ORACLE,
    "op10_near_duplicates": neardup.ORACLE,
    "op11_vector_codes": codebooks.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
