"""Registry of this package's queries and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notelake.llm import licenses, ppm, quality_forest, secrets
from notelake.llm.decontaminate import OP3_SQL, op3_benchmark_decontamination
from notelake.llm.language_id import OP7_SQL, op7_language_id
from notelake.llm.licenses import op10_license_scan
from notelake.llm.mixing import OP2_SQL, op2_mix_sources
from notelake.llm.ngram_join import OP5_SQL, op5_ngram_jaccard_join
from notelake.llm.ppm import op8_ppm_score
from notelake.llm.quality_forest import op4_quality_forest
from notelake.llm.secrets import op6_secret_scan
from notelake.llm.toxicity import op9_toxicity
from notelake.llm.warc import OP1_SQL, op1_warc_salvage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_mix_sources": op2_mix_sources,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_forest": op4_quality_forest,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_ppm_score": op8_ppm_score,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    # what SQL can express of operators with columns that it can't
    "quality_rules_base": quality_forest.quality_rules_base,
    "secret_scan_base": secrets.secret_scan_base,
    "unigram_base": ppm.unigram_base,
    "license_phrases": licenses.license_phrases,
}

ORACLE: dict[str, str] = {
    "op1_warc_salvage": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op7_language_id": OP7_SQL,
    "quality_rules_base": quality_forest.BASE_SQL,
    "secret_scan_base": secrets.BASE_SQL,
    "unigram_base": ppm.BASE_SQL,
    "license_phrases": licenses.BASE_SQL,
}
