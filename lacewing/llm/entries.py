"""The operators' queries and their SQL, by name."""

from . import decontamination, embeddings, language_id, lines, merkle, mixing, packing, phrases, quality, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_language_id": language_id.op2_language_id,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_collocations": phrases.op12_collocations,
    "op13_packing": packing.op13_packing,
}
SQL = {
    "op1_substrings": substrings.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op6_embeddings": embeddings.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_collocations": phrases.ORACLE,
}
