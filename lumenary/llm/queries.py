"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from . import ann, bpe, centroids, decontaminate, dominance, html_text, jaccard_join, language_id, license_scan, pii, quality_cnn, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ann": ann.op3_ann,
    "op4_jaccard_components": jaccard_join.op4_jaccard_components,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language": language_id.op6_language,
    "op7_pii": pii.op7_pii,
    "op8_licenses": license_scan.op8_licenses,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality": quality_cnn.op10_quality,
    "op11_centroids": centroids.op11_centroids,
    "op12_dominance": dominance.op12_dominance,
    "op13_html": html_text.op13_html,
}
ORACLES = {"op1_url_filter": url_filter.SQL, "op4_jaccard_components": jaccard_join.SQL, "op8_licenses": license_scan.SQL, "op11_centroids": centroids.SQL, "op12_dominance": dominance.SQL}
