"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from tabframe.llm import (
    bpe, collocations, embeddings, exact_dedup, jaccard, langid, licenses, merkle, mixing, quality, substrings, toxicity, warc)

QUERIES = {
    "op1_suffix_dedup": substrings.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_langid": langid.op9_langid,
    "op10_bpe": bpe.op10_bpe,
    "op11_licenses": licenses.op11_licenses,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op2_warc": warc.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op12_collocations": collocations.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
