"""Every query of the folder on the smallest tables: contract columns, one row per document, SQL where there is some; the toxicity fit in plain form."""

import os

import duckdb
import numpy as np
import pytest

from lexiforge.llm import catalogue, langid, toxicity

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_sentencepiece": ("documents", "doc_id ids n_ids exact"),
    "op2_source_mixing": ("documents", "doc_id size source_size target taken"),
    "op3_pii_pseudonyms": ("documents", "doc_id text n_pii"),
    "op4_simhash_near_dedup": ("documents", "doc_id fingerprint component_id"),
    "op5_language_mixture": ("documents", "doc_id held_out lang_pred score"),
    "op6_embedding_near_dedup": ("embeddings", "vec_id n_links component_id kept"),
    "op7_toxicity_mil": ("documents", "doc_id held_out score predicted"),
    "op8_warc_index": ("pages", "page_id payload_bytes payload_digest record_type refers_to"),
    "op9_media_sniffing": ("documents", "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"),
    "op11_html_text": ("pages", "page_id url text n_chars"),
    "op12_token_alignment": ("documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
    "op13_periodic_runs": ("documents", "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"),
    "op10_secret_scan": ("documents", "doc_id n_assign n_access n_hex base_sha256 spans"),
}


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_keeps_its_contract(spark, name):
    import zlib

    table, columns = COLUMNS[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(df.columns)
    rows = df.collect()
    key = df.columns[0]
    assert sorted(r[key] for r in rows) == [x for (x,) in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    if name in catalogue.ORACLES:
        found = con.execute(catalogue.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
        assert sorted(tuple(text(r[c]) for c in names) for r in rows) == sorted(tuple(map(text, r)) for r in found.fetchall())
    if "held_out" in columns:
        mod, rest = (4, 2) if name.startswith("op5") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    if "predicted" in columns:
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    if name.startswith("op1_"):
        assert all(r.exact and r.n_ids == len(r.ids or []) for r in rows)


def _plain_loss(w, docs, names, decay):
    """Mean log loss of the noisy-or, a sentence at a time, and the decay."""
    loss = 0.0
    for d in docs:
        clean = (1 / (1 + np.exp(w[-1]))) ** d["others"]
        for s in d["hits"]:
            clean *= 1 / (1 + np.exp(w[-1] + sum(w[f] for f in s)))
        loss -= np.log(1 - clean) if d["toxic"] else np.log(clean)
    return loss / len(docs) + decay * sum(x * x for x in w[:-1]) / 2 / len(names) ** 0.5


def test_toxicity_fit_goes_down_the_plain_loss():
    """The fit ends where the plain loss has no slope left, checked by differences."""
    rng = np.random.default_rng(3)
    names = ["a", "b", "c"]
    docs = []
    for _ in range(60):
        hits = [sorted(set(rng.integers(0, 3, 2).tolist())) for _ in range(rng.integers(0, 3))]
        odds = 1 if any(0 in s for s in hits) else 0
        docs.append({"toxic": int(odds if rng.random() < 0.8 else 1 - odds), "hits": hits, "others": int(rng.integers(1, 4))})
    decay = 0.05
    m = toxicity._descend(docs, names, 6000, decay=decay, rate=0.01)
    w = np.array([*m.weights.values(), m.bias])
    slope = [(_plain_loss(w + h, docs, names, decay) - _plain_loss(w - h, docs, names, decay)) / 2e-5 for h in np.eye(4) * 1e-5]
    assert np.abs(slope).max() < 2e-3


def test_toxicity_scores_match_the_plain_formula(spark):
    model = toxicity.Model(-3.0, {"bad": 4.0, "worse": 2.0, "wors*": 0.5})
    texts = ["bad thing here. fine words! worse, bad", "fine. fine? fine", "", None, "WORSE\nBad."]
    got = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        clean = 1.0
        for _, _, s in toxicity.sentences(t):
            known = {f for word in s.split() for f in toxicity.features(word)} & set(model.weights)
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[f] for f in known))))
        assert abs(r.toxicity.score - (1 - clean)) < 1e-9


def test_language_sets_match_fits_of_every_set():
    """The chosen set's penalised likelihood is that of the best of all sets, fitted one by one."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.ones(langid.GRAMS) * 0.01, 3).T + 1e-12)
    texts = [np.concatenate([rng.choice(langid.GRAMS, n, p=np.exp(logp[:, k]) / np.exp(logp[:, k]).sum()) for k, n in enumerate(ns)]).astype(np.uint16) for ns in ((200, 0, 0), (100, 120, 0), (60, 70, 80), (0, 3, 0))]
    got = langid.mixtures(texts, logp, rounds=60)
    for g, share in zip(texts, got):
        u, c = np.unique(g, return_counts=True)
        best = (-np.inf, None)
        for k in (1, 2, 3):
            for own in combinations(range(3), k):
                p, s = np.exp(logp[u][:, own]), np.full(k, 1 / k)
                for _ in range(60):
                    r = p * s
                    s = (r * (c / r.sum(axis=1))[:, None]).sum(axis=0) / c.sum()
                best = max(best, ((c * np.log(p @ s)).sum() - 6.0 * (k - 1) * np.log(c.sum() + 1), own))
        assert tuple(np.flatnonzero(share > 0)) == best[1]


def test_small_sources_reach_their_targets_beside_a_huge_one(spark):
    """Sources of a few words are neither lost nor doubled when blocks are far larger than their targets."""
    from pyspark.sql import functions as F

    from lexiforge.llm import mixing

    huge = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 2000)").alias("text"), F.lit("a").alias("source"))
    small = spark.createDataFrame([(1000 + i, "x " * n, s) for i, (n, s) in enumerate([(3, "b"), (9, "b"), (2, "c"), (40, "d"), (1, "e")])], "doc_id long, text string, source string")
    rows = mixing.mix(huge.unionByName(small)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    got = {r.source: (r.taken, r.target) for r in rows}
    assert all(got[s][0] == int(got[s][1]) for s in "bcde") and abs(got["a"][0] - got["a"][1]) < 0.01 * got["a"][1]
