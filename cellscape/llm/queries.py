"""The queries of the training-data operators and their DuckDB SQL."""

from cellscape.llm import audio, chat, decontaminate, licenses, lm, manifest, mixing, neardup, negatives, pipeline, quality, rules, secrets, tokens


def queries():
    return {
        "op1_media_audio": audio.op1_media_audio,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_chat_format": chat.op3_chat_format,
        "op4_quality": quality.op4_quality,
        "op5_secret_scans": secrets.op5_secret_scans,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_mixing": mixing.op8_mixing,
        "op9_lm_scores": lm.op9_lm_scores,
        "op10_license_scans": licenses.op10_license_scans,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_quality_rules": rules.op12_quality_rules,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {"op2_near_duplicates": neardup.SQL, "op7_decontamination": decontaminate.SQL, "op8_mixing": mixing.SQL, "op11_hard_negatives": negatives.SQL, "op13_merkle_manifest": manifest.SQL}
