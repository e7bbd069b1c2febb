"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import decontamination, forest, packing, quality, simhash, suffixes, tokenfile, toxicity, urls, warc

QUERIES = {
    "op1_suffixes": suffixes.op1_suffixes,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": simhash.op4_simhash,
    "op5_tokens": tokenfile.op5_tokens,
    "op6_forest": forest.op6_forest,
    "op7_urls": urls.op7_urls,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op10_warc": warc.OP10_SQL,
}
