"""The registered queries of this subpackage and the SQL each is checked against."""

from __future__ import annotations

from rankforge.llm import (
    archives, decontaminate, negatives, pages, periodic, personal, pieces, quality, repetition, secrets, sharding, simhash,
    urls,
)

QUERIES = {
    "op1_personal_data": personal.query,
    "op2_main_text": pages.query,
    "op3_quality_classifier": quality.query,
    "op4_sentencepiece": pieces.query,
    "op5_url_filter": urls.query,
    "op6_secret_scan": secrets.query,
    "op7_quality_rules": repetition.query,
    "op8_sharding": sharding.query,
    "op9_decontamination": decontaminate.query,
    "op10_simhash": simhash.query,
    "op11_periodic_runs": periodic.query,
    "op12_warc": archives.query,
    "op13_hard_negatives": negatives.query,
}

#: The others have no SQL form, or one that is too slow on whole tables; tests/llm holds them against plain versions.
ORACLES = {
    "op5_url_filter": urls.SQL,
    "op7_quality_rules": repetition.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_warc": archives.SQL,
    "op13_hard_negatives": negatives.SQL,
}
