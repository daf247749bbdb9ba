"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pageloom.llm import (
    boilerplate, idfiles, licences, mixing, packing, simhash, structural, surrogates, toxicity, variants, weighted,
    whitening, winnow,
)

QUERIES = {
    "op1_hilbert_packing": packing.packed_pieces,
    "op2_surrogates": surrogates.replaced_entities,
    "op3_structural_secrets": structural.secret_spans,
    "op4_licence_dice": licences.licence_passages,
    "op5_winnowing": winnow.benchmark_leaks,
    "op6_site_lines": boilerplate.site_lines,
    "op7_token_files": idfiles.token_files,
    "op8_string_kernel_toxicity": toxicity.toxic_documents,
    "op9_weighted_sampling": weighted.weighted_fingerprints,
    "op10_simhash": simhash.simhash_components,
    "op11_source_mix": mixing.source_mix,
    "op12_whitening": whitening.whitened_embeddings,
    "op13_spelling_variants": variants.vocabulary_variants,
}

CHECK_SQL = {
    "op5_winnowing": winnow.LEAKS_SQL,
    "op6_site_lines": boilerplate.SITE_LINES_SQL,
    "op11_source_mix": mixing.SOURCE_MIX_SQL,
}
