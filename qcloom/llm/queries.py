"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import collocate, decontaminate, htmltext, langid, mixing, ngramjoin, quality, repeats, resample, tokencount, urlfilter, vectors, warc

QUERIES = {
    "op1_pareto_mix": mixing.query,
    "op2_ngram_jaccard": ngramjoin.query,
    "op3_url_templates": urlfilter.query,
    "op4_page_differences": htmltext.query,
    "op5_subspace_pigeonhole": vectors.query,
    "op6_language_codes": langid.query,
    "op7_suffix_automaton": decontaminate.query,
    "op8_factorisation_quality": quality.query,
    "op9_common_prefix_intervals": repeats.query,
    "op10_token_cache": tokencount.query,
    "op11_importance_resampling": resample.query,
    "op12_warc_segments": warc.query,
    "op13_collocations": collocate.query,
}

SQL = {
    "op1_pareto_mix": mixing.SQL,
    "op2_ngram_jaccard": ngramjoin.SQL,
    "op3_url_templates": urlfilter.SQL,
    "op5_subspace_pigeonhole": vectors.SQL,
    "op7_suffix_automaton": decontaminate.SQL,
    "op11_importance_resampling": resample.SQL,
    "op12_warc_segments": warc.SQL,
    "op13_collocations": collocate.SQL,
}
