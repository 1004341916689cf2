"""The numbered operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from . import audio, bpe, chat, collocations, exact_dedup, line_dedup, mixing, quality, resharding, simhash, suffix_dedup, vector_codes, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_quality": quality.query,
    "op5_warc": warc.query,
    "op6_simhash": simhash.query,
    "op7_resharding": resharding.query,
    "op8_bpe": bpe.query,
    "op9_audio": audio.query,
    "op10_mixing": mixing.query,
    "op11_collocations": collocations.query,
    "op12_chat": chat.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op10_mixing": mixing.oracle(),
    "op11_collocations": collocations.SQL,
    "op12_chat": chat.SQL,
}
