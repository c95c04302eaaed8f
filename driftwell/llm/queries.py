"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import (
    decontamination, exact_dedup, jaccard_join, license_scan, minhash, periodic_runs, phrases, piece_bpe, quality, secret_scan, sharding, substring_dedup, toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op10_quality": quality.op10_quality,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentencepiece": piece_bpe.op6_sentencepiece,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op11_minhash": minhash.op11_minhash,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op11_minhash": minhash.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
