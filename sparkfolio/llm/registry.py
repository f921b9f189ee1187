"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, crossentropy, exact_dedup, media, packing, quality, records, simhash, spelling, substring, token_counts, url_graph

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_quality": quality.op2_quality,
    "op3_token_records": records.op3_token_records,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_bpe": bpe.op6_bpe,
    "op7_simhash": simhash.op7_simhash,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_cross_entropy": crossentropy.op9_cross_entropy,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_centroids": centroids.op12_centroids,
    "op13_url_filters": url_graph.op13_url_filters,
}

#: The others hash with XXH64, encode with a vocabulary, fit a model or pack: tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op8_substring_dedup": substring.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_url_filters": url_graph.OP13_SQL,
}
