"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, jaccard, licenses, linededup, media, packing, resample, toxicity, urls
from tessera.llm.common import table

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_redirect_equivalence": urls.op4_redirect_equivalence,
    "op5_snapshot_collapse": chat.op5_snapshot_collapse,
    "op6_positive_unlabelled": toxicity.op6_positive_unlabelled,
    "op7_avi_motion_jpeg": lambda spark, sf_dir: media.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")),
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_latent_retrieval": decontaminate.op9_latent_retrieval,
    "op10_importance_resampling": resample.op10_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": jaccard.OP3_SQL,
    "op4_redirect_equivalence": urls.OP4_SQL,
    "op5_snapshot_collapse": chat.OP5_SQL,
}
