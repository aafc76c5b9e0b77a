"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

from lexiforge.llm import simhash

COLUMNS = "doc_id long, text string"


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _expected(rows):
    """Smallest id of each component of all pairs of at least 0.8, by brute force."""
    sets, root = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(i for i in root if top(i) == i)


def _pairs(share_of_words, kinds, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(2000 * rng.random() ** 3)}" for _ in range(20000)]
    rows = []
    for n in (60, 150, 400):
        for kind in kinds:
            for share in share_of_words:
                base = rng.choices(vocabulary, k=n)
                k = max(1, int(n * share))
                if kind == "appended":
                    copy = base + rng.choices(vocabulary, k=k)
                elif kind == "deleted":
                    at = rng.randrange(n - k)
                    copy = base[:at] + base[at + k :]
                else:
                    copy = list(base)
                    for at in rng.sample(range(n), max(1, k // 5)):
                        copy[at] = "edited"
                rows += [" ".join(base), " ".join(copy)]
    return list(enumerate(rows))


def _kept(spark, rows):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect())


def test_near_copies_with_passages_are_found(spark):
    rows = _pairs([0.05, 0.1, 0.14, 0.18, 0.2, 0.22, 0.24, 0.26, 0.3], ["appended", "deleted", "scattered"], 1)
    assert _kept(spark, rows) == _expected(rows)


def test_texts_that_share_less_stay(spark):
    """Templates at 0.6 to 0.79 are no copies; every similarity is checked exactly."""
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        base = [f"a{rng.randrange(10**6)}" for _ in range(200)]
        k = rng.randint(52, 90)  # 196 shingles, of which 196 / (196 + k) are common
        rows += [" ".join(base), " ".join(base + [f"b{rng.randrange(10**6)}" for _ in range(k)])]
    rows = list(enumerate(rows))
    assert _expected(rows) == list(range(80))
    assert _kept(spark, rows) == list(range(80))


@pytest.mark.parametrize(("small", "dense"), [(64, 4), (3, 4), (3, 0), (3, 1000)])
def test_large_groups_of_one_template(spark, monkeypatch, small, dense):
    """A group around 0.8 of each other: some pairs link, others don't, in pairs, in blocks and in dense blocks."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(4)
    base = [f"a{k}" for k in range(120)]
    rows = []
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy + [f"y{rng.randrange(10**6)}" for _ in range(rng.choice([0, 5, 12, 30]))]))
    rows = list(enumerate(rows))
    want = _expected(rows)
    assert 3 < len(want) < 57
    assert _kept(spark, rows) == want


def test_chains_lose_no_pair_within_the_distance():
    """Ring.near gives exactly the pairs whose full Hamming distance is within tau."""
    import numpy as np

    rng, ring = np.random.default_rng(5), simhash.Ring(*simhash.STAGE_RING)
    bits = rng.random((4000, 256)) < rng.uniform(0.05, 0.5, (4000, 1))
    x = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    assert ring.near(x).tolist() == np.flatnonzero(bits.sum(axis=1) <= ring.tau).tolist()
    assert ring.near(x, np.arange(7)).tolist() == [i for i in range(7) if bits[i].sum() <= ring.tau]


def test_fingerprints_of_near_copies_pass_the_chains():
    """Of 3000 pairs of sets at a Jaccard similarity of just 0.8, none is lost before the exact comparison."""
    import numpy as np

    rng, ring, lost = np.random.default_rng(6), simhash.Ring(*simhash.STAGE_RING), 0
    for _ in range(3000):
        n = int(rng.choice([64, 70, 100, 200, 400]))
        own = rng.integers(0, 2**64, n, np.uint64)
        other = np.r_[own[: 8 * n // 9], rng.integers(0, 2**64, n // 9, np.uint64)]
        x = np.frombuffer(simhash.folded(own, 4), ">u8") ^ np.frombuffer(simhash.folded(other, 4), ">u8")
        lost += not len(ring.near(x.astype(np.uint64).reshape(1, 4)))
    assert lost == 0


def test_passages_of_a_few_texts_give_few_pairs(spark):
    """Each of 100,000 texts holds one of 3334 passages, with about 30 texts each: in a large table too these are no index keys."""
    word = "concat('{0}', pmod(xxhash64(pmod(id, {1}), {2}, j), 1000000))"
    words = "array_join(transform(sequence(1, 20), j -> " + word + "), ' ')"
    docs = spark.range(0, 100_000, 1, 8).selectExpr(
        "id as doc_id", f"concat({words.format('o', 1_000_000, 1)}, ' ', {words.format('p', 3334, 2)}) as text"
    )
    index = simhash.shingle_classes(docs, "doc_id", "text").selectExpr("explode(keys) as key").groupBy("key").count()
    assert index.selectExpr("sum(count * (count - 1) div 2)").first()[0] < 200_000
