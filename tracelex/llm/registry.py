"""The queries of this subpackage and the SQL that checks them, where SQL can express them."""

from tracelex.llm import alignment, decontaminate, fertility, jaccard, pieces, quotes, secrets, shards, suffixes, topk, toxicity, warc, whitening

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quotes": quotes.op4_quotes,
    "op5_fertility": fertility.op5_fertility,
    "op6_jaccard": jaccard.op6_jaccard,
    "op6_links": jaccard.op6_links,
    "op7_secrets": secrets.op7_secrets,
    "op8_shards": shards.op8_shards,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_suffixes": suffixes.op10_suffixes,
    "op11_topk": topk.op11_topk,
    "op12_alignment": alignment.op12_alignment,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op4_quotes": quotes.OP4_SQL,
    "op6_jaccard": jaccard.OP6_SQL,
    "op6_links": jaccard.OP6_LINKS_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_topk": topk.OP11_SQL,
}
