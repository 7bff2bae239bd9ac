"""The registered query of each training-data operator, with SQL where SQL can express it."""

from __future__ import annotations

from . import alignment, centroids, fingerprints, language, licences, media, mixing, near_dedup, packing, pii, secrets, slack, substrings

QUERIES = {
    "op1_near_dedup_omh": near_dedup.op1_near_dedup_omh,
    "op2_pii_anchors": pii.op2_pii_anchors,
    "op3_mpeg_audio": media.op3_mpeg_audio,
    "op4_licences_automaton": licences.op4_licences_automaton,
    "op5_scaled_sketch": fingerprints.op5_scaled_sketch,
    "op6_pack_ffd": packing.op6_pack_ffd,
    "op7_mix_systematic": mixing.op7_mix_systematic,
    "op8_secrets_worklist": secrets.op8_secrets_worklist,
    "op9_repeats_difference_cover": substrings.op9_repeats_difference_cover,
    "op10_language_crf": language.op10_language_crf,
    "op11_pack_min_slack": slack.op11_pack_min_slack,
    "op12_pca_filtered_kmeans": centroids.op12_pca_filtered_kmeans,
    "op13_align_tokenizers": alignment.op13_align_tokenizers,
}
ORACLE_SQL = {
    "op7_mix_systematic": mixing.ORACLE_SQL,
    "op12_pca_filtered_kmeans": centroids.ORACLE_SQL,
}
