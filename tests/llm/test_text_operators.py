"""SimHash, mixing, personal data, secrets, language, toxicity and SentencePiece on odd rows and against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lexiforge.llm import langid, mixing, pii, secrets, sentencepieces, simhash, toxicity
from tests.llm.conftest import COLUMNS, ODD


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_roots(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_and_components_match_brute_force(spark, odd):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(60)) for _ in range(25)]
    texts = base + [t.replace("ab", "zz", 1) for t in base] + [t + " tail" for t in base] + [t for _, t, *_ in ODD]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [int.from_bytes(got[i].fp, "big") for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == plain_roots(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    on_odd = simhash.near_duplicates(odd).collect()
    assert len(on_odd) == len(ODD) and {r.component_id for r in on_odd if r.doc_id in (2, 3)} == {2}


def test_ring_keeps_every_pair_within_tau_and_tiles_lose_none(spark):
    rng = np.random.default_rng(5)
    ring = simhash.Ring(64, 3, 7)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre] + [centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 40)).astype(np.uint64), axis=0) for k in (1, 2, 3, 4, 3, 2)]))
    a, b = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 3
    keys = ring.keys(fps.reshape(-1, 1))
    assert all(set(keys[i]) & set(keys[j]) for i, j in zip(a[near], b[near]))
    rows = [(int(f).to_bytes(8, "big"),) for f in fps]
    for tile in (2, 2048):
        links = simhash.links(spark.createDataFrame(rows, "fp binary"), ring, tile=tile).collect()
        place = {f[0]: i for i, f in enumerate(rows)}
        lab = simhash._forest(len(fps), *(np.array([place[bytes(x[k])] for x in links], int) for k in (0, 1)))
        assert (lab == simhash._forest(len(fps), a[near], b[near])).all()


def test_one_of_each_group_stays(spark, odd, empty):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(500)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(12)]
    near = [" ".join(w if i != 77 else "other" for i, w in enumerate(t.split())) for t in base]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base + near + base)]
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect())
    assert kept == list(range(12))
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "4", "5", "6", "7", "None"]
    assert simhash.keep_one(empty).count() == 0


def test_mix_follows_targets(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), "en", rng.choice(["a", "b", "c", "d", None, "e", "e", "e", "e"]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(x for x in sizes if x is not None) + [None]
    target, open_, left = {}, list(order), sum(sizes.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    while True:  # reshare until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            open_.remove(s)
    assert len(got) == len(rows)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.01 * target[s] + 2
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.mix(odd.where("text = ''")).first().taken == 0
    taken = sum(int(r.taken / r.size + 0.5) for r in got if r.size)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == taken
    assert mixing.mixed_documents(odd).columns == odd.columns


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_feistel(values, radices, tweak, key):
    half = len(values) // 2
    a, b, ra, rb = values[:half], values[half:], radices[:half], radices[half:]
    for n in range(1, 7):
        own, bases, other = (b, rb, a) if n % 2 else (a, ra, b)
        h = hashlib.sha512(f"{key}|{tweak}|{n}|{','.join(map(str, other))}".encode()).hexdigest()
        new = [(v + int(h[i % 32 * 4 : i % 32 * 4 + 4], 16)) % r for i, (v, r) in enumerate(zip(own, bases))]
        a, b = (a, new) if n % 2 else (new, b)
    return a + b


def plain_permuted(text, tweak, key):
    kinds = [(10, 48) if c.isdigit() else (26, 97) if c.islower() else (26, 65) if c.isupper() else None for c in text]
    new = iter(plain_feistel([ord(c) - k[1] for c, k in zip(text, kinds) if k], [k[0] for k in kinds if k], tweak, key))
    return "".join(chr(next(new) + k[1]) if k else c for c, k in zip(text, kinds))


def test_pseudonyms_keep_formats_link_and_match_brute_force(spark, odd, empty):
    cards = [c for c in (f"4{i:014d}{d}" for i in range(0, 9000, 7) for d in range(10)) if luhn(c)][:300]
    mails = [f"u{i}.Ab@x{i % 3}.example.com" for i in range(200)]
    phones = [f"+1 ({200 + i}) 555-{1000 + i}" for i in range(200)]
    ips = [f"10.{i}.3.{255 - i}" for i in range(200)]
    dates = [f"20{i:02d}-02-1{i % 10}" for i in range(90)] + ["2020-02-29", "29.02.2020", "2020/02/29"]
    ssns = [f"{i:03d}-45-{6000 + i}" for i in range(1, 600)]
    kinds = {"card": cards, "email": mails, "phone": phones, "ip": ips, "date": dates, "ssn": ssns}
    bad = ["4583540886970626", "300.1.1.1", "2021-02-29", "666-12-1234", "000-12-1234"]
    rows = [(0, f"see {v}, and {v}", "en", "s", 0) for vs in kinds.values() for v in vs] + [(1, f"see {v}, and {v}", "en", "s", 0) for v in bad]
    got = pii.pseudonymised(spark.createDataFrame(rows, COLUMNS), "k").collect()
    at = 0
    for kind, values in kinds.items():
        seen = set()
        for v in values:
            m = re.fullmatch(r"see (.+), and (.+)", got[at].text)
            assert m[1] == m[2] and [x.kind for x in got[at].pii] == [kind, kind], (v, got[at].text)
            assert re.sub("[a-z]", "a", re.sub(r"\d", "0", re.sub("[A-Z]", "A", m[1]))) == re.sub("[a-z]", "a", re.sub(r"\d", "0", re.sub("[A-Z]", "A", v))) or kind == "ip"
            if kind == "card":
                assert luhn(m[1]) and m[1] == (b := "4" + plain_permuted(v[1:-1], "card", "k")) + m[1][-1] and luhn(b + m[1][-1])
            if kind == "email":
                local, domain = v.split("@")
                assert m[1] == plain_permuted(local, domain, "k") + "@" + domain
            if kind == "ip":
                assert m[1] == ".".join(map(str, plain_feistel([int(x) for x in v.split(".")], [256] * 4, "ip", "k")))
            if kind == "phone":
                assert m[1] == "+1" + plain_permuted(v[2:], "phone+1", "k")
            seen.add(m[1])
            at += 1
        assert len(seen) == len(set(values))
    assert [r.text for r in got[at:]] == [f"see {v}, and {v}" for v in bad]
    done = pii.pseudonymised(odd, "k")
    assert sorted(str(r.text) for r in done.collect()) == sorted(str(t) for _, t, *_ in ODD) and pii.pseudonymised(empty, "k").count() == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern, group, least) in enumerate([
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x for *_, x in sorted(out)]


def test_secrets_match_plain_regexes(spark, odd, empty):
    rng = random.Random(4)
    bits = ["token", "=", "token: ", "API_KEY", "apikey='", "abcdef0123456789" * 2, "AKIA", "AKIA" + "Z9" * 9, " ", "é😀", "secret", "=ab", "passwd=\"", "x/y+z_1", "\n", "PASSWORD :", "eyJ", "a" * 30, "AKIAK"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(800)] + [None, "", "token=token: abcdefgh", "-----BEGIN RSA PRIVATE KEY-----"]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    got = secrets.scan(rows).select("doc_id", secrets.listed(secrets.F.filter("spans", lambda s: s["rule"] < 3)).alias("base"), secrets.listed(secrets.F.col("spans")).alias("all")).collect()
    assert {r.doc_id: r.base for r in got} == {i: ",".join(plain_spans(t or "")) for i, t in enumerate(texts)}
    assert next(r["all"] for r in got if r.doc_id == len(texts) - 1) == "private_key:0:31"
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(empty).count() == 0


def test_trigram_queries_hold_for_every_match():
    query = secrets.trigram_query(secrets.BASE[0].regex)
    assert query and not secrets.trigram_query(secrets.BASE[2].regex)
    for text in ("PassWord = abcdefg", "api_key:zzzzzz", "APIKEY=zzzzzz", "secret='aaaaaa"):
        assert all(any(all(g in text.lower() for g in s) for s in c) for c in query)
    assert not any(all(g in "nothing here" for g in s) for c in query for s in c)
    assert secrets.trigram_query("ab[0-9]+") == [] and secrets.trigram_query("(?:abc|x)y*") == []


def test_language_of_odd_rows_and_mixtures(spark, odd, empty):
    words = {"en": "the of and thing other where", "fr": "le la que être nous vous", "de": "der die und nicht über schön"}
    rng = random.Random(5)
    text = lambda l, n: " ".join(rng.choices(words[l].split(), k=n))
    rows = [(i, text(l, 60), l, "s", 0) for i, l in enumerate(list(words) * 20)]
    names, logp = langid.learn(spark.createDataFrame(rows, COLUMNS))
    assert names == ["de", "en", "fr"] and np.allclose(np.exp(logp).sum(axis=0), 1)
    tests = [(0, text("fr", 50), None, "s", 0), (1, text("de", 60) + " " + text("en", 30), None, "s", 0)]
    got = {r.doc_id: r.languages for r in langid.predicted(spark.createDataFrame(tests, COLUMNS), names, logp).collect()}
    assert [x.lang for x in got[0]] == ["fr"] and [x.lang for x in got[1]] == ["de", "en"]
    assert abs(got[1][0].share - 0.66) < 0.15
    odd_ones = langid.predicted(odd, names, logp).collect()
    assert len(odd_ones) == len(ODD) and all(not r.languages for r in odd_ones if not r.text or r.doc_id == 4)
    assert langid.learn(empty)[0] == [] and langid.predicted(empty, names, logp).count() == 0
    assert all(not r.languages for r in langid.predicted(odd, [], np.empty((langid.GRAMS, 0))).collect())


def test_mixtures_match_a_plain_expectation_maximisation():
    rng = np.random.default_rng(6)
    logp = np.log(rng.dirichlet(np.full(langid.GRAMS, 0.01), 2).T + 1e-9)
    g = rng.choice(langid.GRAMS, 300, p=(p := 0.7 * np.exp(logp[:, 0]) + 0.3 * np.exp(logp[:, 1])) / p.sum()).astype(np.uint16)
    share = np.array([0.5, 0.5])
    for _ in range(12):
        r = np.exp(logp[g]) * share
        share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(langid.mixtures([g, np.empty(0, np.uint16)], logp), [share, [0, 0]], atol=1e-6)


def test_toxicity_learns_and_locates(spark, odd, empty):
    rng = random.Random(7)
    calm = "the cat sat on a mat with some other friends near rivers".split()
    docs, labels = [], []
    for i in range(400):
        said = [" ".join(rng.choices(calm, k=8)) for _ in range(6)]
        if i % 4 == 0:
            said[rng.randrange(6)] += rng.choice([" stupid", " idiot", " vequ" + rng.choice(["mo", "ta", "ron"])])
        docs.append((i, ". ".join(said), "en", "s", 0))
        labels.append((i, int(i % 4 == 0)))
    frame, marks = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels + [(1000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, marks.where("doc_id is null or doc_id < 300"))
    got = {r.doc_id: r for r in toxicity.scored(frame, model).collect()}
    assert all((got[i].toxicity.score >= toxicity.TOXIC) == (i % 4 == 0) for i in range(400))
    for i in range(300, 400, 4):
        found = [got[i].text[s.start : s.end] for s in got[i].toxicity.offending]
        assert len(found) == 1 and re.search("stupid|idiot|vequ", found[0])
    scored = toxicity.scored(odd, model).collect()
    assert len(scored) == len(ODD) and all(r.toxicity.score < 0.05 for r in scored if not r.text)
    assert toxicity.clean(odd, model).columns == odd.columns
    none = toxicity.fit(empty, marks)
    assert toxicity.scored(empty, none).count() == 0 and toxicity.scored(odd, none).first().toxicity.score < 0.01
    word = "stupid thing. " * 50
    assert toxicity.scored(spark.createDataFrame([(1, word, "", "", 0)], COLUMNS), model).first().toxicity.score == pytest.approx(1)


def plain_best(text, pieces, unknown):
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + unknown
        for p, s in pieces.items():
            if text[:end].endswith(p) and best[end - len(p)] + s > best[end]:
                best[end] = best[end - len(p)] + s
    return best[-1]


def test_pieces_are_optimal_and_round_trip(spark, odd, empty):
    rng = random.Random(8)
    pieces = {"".join(rng.choices("ab ", k=rng.randint(1, 4))).lstrip() or " ": -rng.randint(1, 30) for _ in range(25)} | {"a": -40, " ": -35}
    pieces = {p: s for p, s in pieces.items() if " " not in p.lstrip(" ")} | {" a": -3, " ab": -9}
    v = sentencepieces.Vocabulary(tuple((p, 300 + i, float(s)) for i, (p, s) in enumerate(pieces.items())), tuple(range(256)), 299)
    enc, score = sentencepieces.Encoder(v), {300 + i: s for i, s in enumerate(pieces.values())}
    for _ in range(300):
        t = "".join(rng.choices("aab b\nc▁é", k=rng.randint(0, 25)))
        ids = np.frombuffer(enc.encode(t), np.int32).tolist()
        total = sum(score.get(i, 0) for i in ids)
        lone = sum(1 for c in (" " + t if t else t) if c not in pieces and c not in "ab ") if t else 0
        best = plain_best(" " + t, pieces, v.unknown_score) if t else 0
        unknown = sum(1 for i in ids if i < 256)
        chars = len(bytes(i for i in ids if i < 256).decode("utf-8"))
        assert total + chars * v.unknown_score == best and (unknown >= lone)
    vocabulary = sentencepieces.load()
    got = sentencepieces.tokens(odd, vocabulary).collect()
    assert len(got) == len(ODD) and all(r.exact for r in got)
    assert {r.doc_id: r.n_ids for r in got if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    assert sentencepieces.tokens(empty, vocabulary).count() == 0
    back = sentencepieces.decoded(spark.createDataFrame([([10**6, -5],), (None,)], "ids array<int>"), vocabulary).collect()
    assert back[1].decoded is None and set(back[0].decoded) == {"�"}
