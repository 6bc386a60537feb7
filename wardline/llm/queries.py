"""The queries of this package and their SQL."""

from __future__ import annotations

from . import ann, dialogue, hmm, html, media, mixing, packing, periodic, rollups, signature, substring, toxicity, warc
from .common import ready


def _on(query):
    def run(spark, sf_dir):
        ready(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _on(q) for name, q in _QUERIES.items()}


_QUERIES = {
    "op1_jaccard_join": signature.op1_query,
    "op2_media_columns": media.op2_query,
    "op3_toxicity": toxicity.op3_query,
    "op4_html": html.op4_query,
    "op5_ann": ann.op5_query,
    "op6_packing": packing.op6_query,
    "op7_substring_dedup": substring.op7_query,
    "op8_mixing": mixing.op8_query,
    "op9_warc": warc.op9_query,
    "op10_token_counts": rollups.op10_query,
    "op11_periodic_runs": periodic.op11_query,
    "op12_hidden_markov": hmm.op12_query,
    "op13_conversation_repair": dialogue.op13_query,
    "rollup_word_counts": rollups.rollup_words_query,
    "unigram_scores": hmm.unigram_query,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": signature.OP1_SQL, "op8_mixing": mixing.OP8_SQL, "op9_warc": warc.OP9_SQL, "op13_conversation_repair": dialogue.OP13_SQL, "rollup_word_counts": rollups.ROLLUP_WORDS_SQL, "unigram_scores": hmm.UNIGRAM_SQL}
