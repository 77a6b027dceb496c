"""The queries of this folder and their SQL twins."""

from . import bpe, decontaminate, extract, language, lattice, licenses, mixing, ngram_join, ppm, quality, repair, spelling, toolcalls

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_ppm": ppm.op2_ppm,
    "op3_quality": quality.op3_quality,
    "op4_extract": extract.op4_extract,
    "op5_language": language.op5_language,
    "op6_licenses": licenses.op6_licenses,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_toolcalls": toolcalls.op8_toolcalls,
    "op9_lattice": lattice.op9_lattice,
    "op10_bpe": bpe.op10_bpe,
    "op11_spelling": spelling.op11_spelling,
    "op12_repair": repair.op12_repair,
    "op13_mixing": mixing.op13_mixing,
}
ORACLES = {
    "op8_toolcalls": toolcalls.OP8_SQL,
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_mixing": mixing.OP13_SQL,
}
