"""The corpus queries by name."""

from paceline.llm import decontaminate, knn, phrases, pii, suffix, toxicity, urlfilter, warc, whitening
from paceline.llm.bpe import op10_bpe_forced_boundary
from paceline.llm.lattice import op5_lattice_likelihood
from paceline.llm.quality import op3_quality_subword
from paceline.llm.simhash import op8_simhash_tiled

QUERIES = {
    "op1_voronoi_topk": knn.op1_voronoi_topk,
    "op2_toxicity_nearest": toxicity.op2_toxicity_nearest,
    "op3_quality_subword": op3_quality_subword,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_lattice_likelihood": op5_lattice_likelihood,
    "op6_warc_zstd": warc.op6_warc_zstd,
    "op7_pii_boosting": pii.op7_pii_boosting,
    "op8_simhash_tiled": op8_simhash_tiled,
    "op9_template_leaks": decontaminate.op9_template_leaks,
    "op10_bpe_forced_boundary": op10_bpe_forced_boundary,
    "op11_url_automaton": urlfilter.op11_url_automaton,
    "op12_whitening_subspace": whitening.op12_whitening_subspace,
    "op13_phrase_collocation": phrases.op13_phrase_collocation,
}
ORACLES: dict[str, str] = {
    "op1_voronoi_topk": knn.ORACLE,
    "op6_warc_zstd": warc.ORACLE,
    "op11_url_automaton": urlfilter.ORACLE,
    "op13_phrase_collocation": phrases.ORACLE,
}
