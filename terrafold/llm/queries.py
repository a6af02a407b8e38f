"""The queries of this subpackage and their SQL, added by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import audio, bpe, chunking, licenses, metric, minhash, mixing, pii, quality, runs, secrets, spelling, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
    "op4_remove_repeats": suffix.op4_remove_repeats,
    "op5_near_duplicates": minhash.op5_near_duplicates,
    "op6_personal_data": pii.op6_personal_data,
    "op7_substring_dedup": chunking.op7_substring_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_audio_alignment": audio.op9_audio_alignment,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_ngram_jaccard_join": metric.op11_ngram_jaccard_join,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLE: dict[str, str] = {"op1_secret_scan": secrets.ORACLE, "op2_license_scan": licenses.ORACLE}
