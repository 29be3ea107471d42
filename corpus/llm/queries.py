"""The queries of the ten problems, over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from . import language, overlap, packing, prose, repetition, sampling, spans, splits, tokens, truncation

QUERIES = {
    "p1_found": splits.divided_persons,
    "p1_splits": splits.person_splits,
    "p1_shares": splits.split_shares,
    "p2_found": overlap.split_overlaps,
    "p2_counts": overlap.overlap_counts,
    "p3_found": repetition.repetitive_rows,
    "p3_scores": repetition.repetition_scores,
    "p4_found": sampling.unmet_targets,
    "p4_report": sampling.target_report,
    "p4_sample": sampling.drawn_samples,
    "p5_found": prose.rows_without_prose,
    "p5_statistics": prose.text_quality,
    "p5_against": prose.against_features,
    "p6_found": spans.shared_passages,
    "p6_shared": spans.shared_parts,
    "p7_found": truncation.cut_rows,
    "p7_rates": truncation.cut_rates,
    "p8_ids": tokens.document_ids,
    "p8_decoded": tokens.round_trip,
    "p9_packed": packing.packed_documents,
    "p9_report": packing.packing_report,
    "p10_found": language.mislabelled_documents,
    "p10_labels": language.document_languages,
    "p10_stretches": language.document_stretches,
}

SQL = {"p1_found": splits.P1_SQL, "p4_found": sampling.P4_SQL}
