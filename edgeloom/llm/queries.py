"""The subpackage's registered queries and their SQL."""

from . import bpe, collocations, divergence, embeddings, lines, media, minhash, mixing, packing, quality, repeats, scoring, token_store

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_minhash": minhash.op3_minhash,
    "op4_lines": lines.op4_lines,
    "op5_media": media.op5_media,
    "op6_repeats": repeats.op6_repeats,
    "op7_quality": quality.op7_quality,
    "op8_token_store": token_store.op8_token_store,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_scoring": scoring.op10_scoring,
    "op11_divergence": divergence.op11_divergence,
    "op12_collocations": collocations.op12_collocations,
    "op13_bpe": bpe.op13_bpe,
}

#: Tokenizers, classifiers and mixing predictors have no SQL; tests compare
#: those queries with brute force.
ORACLES = {
    "op2_mixing": mixing.oracle(),
    "op3_minhash": minhash.ORACLE,
    "op4_lines": lines.ORACLE,
    "op6_repeats": repeats.ORACLE,
    "op9_embeddings": embeddings.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
