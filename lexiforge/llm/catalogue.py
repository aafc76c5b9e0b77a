"""The queries of this folder by name, and the SQL for those that SQL can express."""

from lexiforge.llm import alignment, embeddings, htmltext, langid, media, mixing, pii, runs, secrets, sentencepieces, simhash, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepieces.query,
    "op2_source_mixing": mixing.query,
    "op3_pii_pseudonyms": pii.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_language_mixture": langid.query,
    "op6_embedding_near_dedup": embeddings.query,
    "op7_toxicity_mil": toxicity.query,
    "op8_warc_index": warc.query,
    "op9_media_sniffing": media.query,
    "op10_secret_scan": secrets.query,
    "op11_html_text": htmltext.query,
    "op12_token_alignment": alignment.query,
    "op13_periodic_runs": runs.query,
}

ORACLES = {"op2_source_mixing": mixing.ORACLE, "op8_warc_index": warc.ORACLE, "op10_secret_scan": secrets.ORACLE}
