"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import decomposition, decontaminate, language, licenses, neardup, packing, pii, quality, ranked, secrets, sharding, toxicity, whitening

QUERIES = {"op1_secret_scan": secrets.query, "op2_sharding": sharding.query, "op3_minhash_neardup": neardup.query, "op4_license_scan": licenses.query, "op5_pii": pii.query, "op6_toxicity": toxicity.query, "op7_packing": packing.query, "op8_decontamination": decontaminate.query, "op9_language": language.query, "op10_quality_rules": quality.query, "op11_whitening": whitening.query, "op12_ranked_search": ranked.query, "op13_binary_packing": decomposition.query}
ORACLE_SQL: dict[str, str] = {"op4_license_scan": licenses.ORACLE, "op10_quality_rules": quality.ORACLE, "op12_ranked_search": ranked.ORACLE}
