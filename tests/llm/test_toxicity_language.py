import pickle

import numpy as np
import pyarrow as pa

from tests.llm import helpers as h
from weft.llm import language, queries, toxicity
from weft.llm import text as tx

SF = "/root/testdata/sf0.1"


def entries(rng, lists, copies=None):
    """A model with these entries, of random weights."""
    bounds, index = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)
    weight = rng.random(len(index)) + 0.1
    weight /= np.repeat(np.sqrt(np.add.reduceat(weight**2, bounds[:-1])), np.diff(bounds))
    n, v = len(lists), int(index.max()) + 1
    many = rng.integers(1, 4, n) if copies is None else np.full(n, copies)
    return toxicity.Model(np.arange(v, dtype=tx.U64), np.arange(v, dtype=np.int32), np.ones(v, dtype=np.float32), 1.0, np.arange(n), many, rng.integers(0, 2, n) * many, bounds, index, None, weight.astype(np.float32))


def nearest(cosine, many, k):
    """Entries in order until k examples are reached, and all as near as the last."""
    order = [i for i in np.argsort(-cosine, kind="stable") if cosine[i] > 0]
    upto = np.cumsum(many[order])
    last = int(np.searchsorted(upto, k))
    return {i for i in order if last >= len(order) or cosine[i] >= cosine[order[last]] - 1e-9}


def test_nearest_are_exact_and_blocks_are_left_out():
    rng = np.random.default_rng(7)
    # clusters of entries, with rare and common terms, and copies
    lists = []
    for c in range(20):
        lists += [np.unique(np.concatenate([c * 300 + rng.choice(30, 6), c * 300 + rng.integers(30, 300, rng.integers(1, 60)), 6000 + rng.choice(40, 3)])) for _ in range(40)]
    lists[11] = lists[3]
    m = entries(rng, lists)
    m.weight[m.bounds[11] : m.bounds[12]] = m.weight[m.bounds[3] : m.bounds[4]]
    dense = np.zeros((len(lists), len(m.vocabulary)))
    dense[np.repeat(np.arange(len(lists)), np.diff(m.bounds)), m.index] = m.weight
    for block in (16, 40, 1000):
        index = toxicity.Index(m, block=block)
        assert len(index.postings) and (block == 1000 or sum(map(len, index.columns)))
        queries_ = [(m.index[m.bounds[i] : m.bounds[i + 1]], m.weight[m.bounds[i] : m.bounds[i + 1]], -1 if i % 2 else i) for i in range(0, 800, 3)]
        for (term, w, skip), (rows, c) in zip(queries_, index.search(queries_, 10), strict=True):
            cosine = dense[:, term] @ w.astype(float)
            many = m.n.copy()
            if skip >= 0:
                many[skip] -= 1
                if not many[skip]:
                    cosine[skip] = 0
            assert set(rows.tolist()) == nearest(cosine, many, 10) and np.allclose(np.minimum(cosine[rows], 1), c, atol=1e-6)
        if block == 40:  # the bounds leave out most blocks, though all share terms
            assert index.read < 0.4 * index.blocks
    assert toxicity.Index(m, 16).nearest(lists[3], m.weight[m.bounds[3] : m.bounds[4]])[0][:2].tolist() == [3, 11]
    one = toxicity.Index(entries(rng, [np.array([0, 1]), np.array([1])]), 1)
    assert one.nearest(np.array([0]), np.ones(1))[0].tolist() == [0] and one.nearest(np.zeros(0, dtype=int), np.zeros(0))[0].tolist() == []


def test_equal_neighbours_vote_alike():
    c = np.array([0.9, 0.5, 0.5, 0.5])
    n, pos = np.array([2, 6, 6, 4]), np.array([0, 6, 0, 4])
    odds = toxicity.vote(n, pos, c, 0.1, 10)
    w = 0.25 * 8 / 16  # eight places left for sixteen examples
    assert np.isclose(odds, np.log((10 * w + 0.1) / (2 * 0.81 + 6 * w + 0.9)))
    again = np.array([0, 3, 1, 2])
    assert np.isclose(odds, toxicity.vote(n[again], pos[again], c[again], 0.1, 10))
    assert np.isclose(toxicity.vote(np.array([3]), np.array([3]), np.array([1.0]), 0.2, 10), np.log(3.2 / 0.8))


def test_calibration_is_the_best_within_its_bounds():
    rng = np.random.default_rng(1)
    cases = [(np.repeat([-13.8, 13.8], 50), np.repeat([0, 1], 50)), (np.repeat([-2.0, -1.9], [500, 3]), np.repeat([0, 1], [500, 3])), (rng.normal(0, 3, 300), rng.integers(0, 2, 300))]
    x = rng.normal(0, 2, 400)
    cases.append((x, (rng.random(400) < 1 / (1 + np.exp(-1.5 * x - 1))).astype(int)))
    for x, y in cases:
        a, b = toxicity._calibrate(x, y)
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        loss = lambda a, b: (np.logaddexp(0, a * x + b) - t * (a * x + b)).sum() + (a - 1) ** 2 / 2 + b * b / 2  # noqa: B023, E731
        assert 0.5 <= a <= 3
        assert all(loss(a, b) <= loss(min(max(a + da, 0.5), 3), b + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    assert toxicity._calibrate(np.zeros(3), np.ones(3)) == (1.0, 0.0)


def plain_scores(texts, sample, m):
    """Scores by sets, sums and sorting: ``sample`` has (text, label); only the scale of weights, slope and shift are the model's."""
    import math
    from collections import Counter

    def counts(t):
        ws = [w.encode() for w in h.words(t)]
        return Counter([("w", w) for w in ws] + [("h", w[: toxicity.PREFIX]) for w in ws if len(w) > toxicity.PREFIX])

    all_counts = [counts(t) for t in texts]
    df = Counter(x for c in all_counts for x in c)
    own = [(counts(t), y) for t, y in sample]
    vocabulary = {x for c, _ in own for x in c}
    n1, n0 = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    pos, neg = Counter(x for c, y in own if y for x in c), Counter(x for c, y in own if not y for x in c)
    terms = sorted(vocabulary)
    scale = dict(zip(terms, toxicity._scale(np.array([pos[x] for x in terms], dtype=float), np.array([neg[x] for x in terms], dtype=float), float(n1), float(n0)), strict=True))
    idf = {x: scale[x] * (math.log(1 + len(texts)) + 1 - math.log(1 + df[x])) for x in terms}
    unseen = m.unseen

    def vector(c):
        v = {x: (1 + math.log(n)) * idf.get(x, unseen) for x, n in c.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    index = [(vector(c), y) for c, y in own if c]
    base = sum(y for _, y in index) / len(index)
    out = []
    for c in all_counts:
        if not c:
            out.append(m.blank_rate)
            continue
        v = vector(c)
        near = sorted(((min(sum(w * e.get(x, 0) for x, w in v.items()), 1.0), y) for e, y in index), key=lambda s: -s[0])
        near = [s for s in near if s[0] > 0]
        kth = near[min(toxicity.K, len(near)) - 1][0] if near else 0
        above, tied = [s for s in near if s[0] > kth + 1e-7], [s for s in near if abs(s[0] - kth) <= 1e-7]
        share = min(1.0, (toxicity.K - len(above)) / len(tied)) if tied else 0
        votes = [(s * s, y) for s, y in above] + [(s * s * share, y) for s, y in tied]
        p = (sum(w * y for w, y in votes) + toxicity.PRIOR * base) / (sum(w for w, _ in votes) + toxicity.PRIOR)
        p = min(max(p, 1e-6), 1 - 1e-6)
        out.append(1 / (1 + math.exp(-(m.slope * math.log(p / (1 - p)) + m.shift))))
    return out


def test_toxicity_scores_match_a_plain_version(spark):
    """Terms, IDF, votes and scores; every term is weighed, copies find their examples, equal texts with both labels are in between."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 40)) + (" idiot" if i % 5 == 0 else "") for i in range(120)]
    texts = [*texts, *texts[:30], *["half of these are marked"] * 60, "unseen unheard", "", None, "W1 w1 w2; w3!"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    said = {i: int(i % 5 == 0 if i < 120 else i % 2) for i in [*range(120), *range(150, 210), 211]}
    m = toxicity.train(docs, h.labels(spark, [(i, 1, y) for i, y in said.items()]))
    folds = {r.doc_id for r in docs.where(queries.ln.fold(queries.F.col("doc_id"), 5) != 0).collect()}
    sample = [(texts[i], y) for i, y in said.items() if i in folds]
    assert m.n.sum() == sum(bool(t) for t, _ in sample)
    sent = pickle.loads(pickle.dumps(m))
    assert all(np.array_equal(getattr(sent, c), getattr(m, c)) for c in ("index", "idf", "bounds", "vocabulary", "place", "n", "pos")) and np.allclose(sent.weights(), m.weights())
    rows = {r.doc_id: r.t for r in toxicity.scores(docs, m, out="t").collect()}
    assert np.allclose([rows[i].score for i in range(len(texts))], plain_scores(texts, sample, m), atol=2e-4)
    for i in range(30):  # a copy finds its example
        assert rows[i + 120].score == rows[i].score
        if i in folds:
            assert rows[i + 120].neighbours[0] == i and rows[i + 120].cosines[0] > 0.9999
    assert 0.2 < rows[150].score < 0.8 and rows[211].score == rows[212].score == m.blank_rate
    assert np.mean([rows[i].score for i in range(0, 120, 5)]) > 0.5 > np.mean([rows[i].score for i in range(1, 120, 5)])


def test_toxicity_held_out(spark):
    got = queries.op3_toxicity(spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    own = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert own[own.toxic == 1].predicted.mean() > 0.8
    assert own[own.toxic == 0].predicted.mean() < 0.03


def test_toxicity_awkward(spark):
    docs = h.awkward(spark, ["you idiot"] * 5)
    m = toxicity.train(docs, h.labels(spark, [(i, 1, int(i == 8)) for i in range(9)] + [(None, 1, 1), (3, 0, None)]))
    rows = toxicity.scores(docs, m, out="t").collect()
    assert len(rows) == len(h.AWKWARD) + 5
    assert all(0 <= r.t.score <= 1 for r in rows)
    blank = toxicity.train(h.none(spark), h.labels(spark))
    assert toxicity.scores(h.none(spark), blank, out="t").collect() == []
    assert {r.t.score for r in toxicity.scores(docs, blank, out="t").collect()} == {0.0}


def test_vectors_match_plain_counts():
    texts = ["Abc abd", "", "é1é", "xy", "aaaa aaaa"]
    idf = np.ones(language.DIMENSIONS, dtype=np.float32)
    run = next(tx.runs(pa.array(texts)))
    (_, _, x), = language.vectors(run, idf)
    assert np.allclose(np.sqrt((x * x).sum(axis=1)), [1, 0, 1, 0, 1], atol=1e-6)
    for i, t in enumerate(texts):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t.lower().encode())
        assert (x[i] > 0).sum() <= len({raw[k : k + 3] for k in range(len(raw) - 2)})
    (_, _, y), = language.vectors(next(tx.runs(pa.array(["zz", "Abc abd"]))), idf)
    assert np.allclose(y[1], x[0])  # a row's vector doesn't hang on its neighbours


def test_language_held_out(spark):
    got = queries.op4_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    own = docs[docs.held_out]
    assert len(got) == 10_000 and (own.lang == own.lang_pred).mean() > 0.98
    assert got.rejected.mean() < 0.001


def test_language_awkward(spark):
    docs = h.awkward(spark)
    m = language.train(docs)
    rows = language.identify(docs, m, out="l").collect()
    assert len(rows) == len(h.AWKWARD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.l.lang == ("en" if letters else "und") and 0 <= r.l.score <= 1 and (letters or r.l.rejected)
    empty = language.train(h.none(spark))
    assert language.identify(h.none(spark), empty, out="l").collect() == []
    assert {r.l.lang for r in language.identify(docs, empty, out="l").collect()} == {"und"}


def test_every_length_can_be_rejected(spark):
    docs = spark.read.parquet(f"{SF.replace('0.1', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    m = language.train(docs)
    assert (m.least > 0).all()
    rng = np.random.default_rng(1)
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. ", "Все люди рождаются свободными и равными в своем достоинстве и правах. "]
    texts = [(f * (n // len(f) + 1))[:n] for n in (12, 30, 300, 3000, 30_000, 300_000) for f in ("".join(rng.choice(list("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ0123456789"), 1000)), *foreign)]
    planted = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert [r.doc_id for r in language.identify(planted, m, out="l").collect() if not r.l.rejected] == []
    own = language.identify(docs, m, out="l").selectExpr("avg(int(l.rejected))").first()[0]
    assert own < 0.01


def test_thresholds_borrow_from_the_nearest_lengths():
    size, cosine = np.array([16] * 30 + [64] * 5 + [4096] * 40), np.array([0.2] * 30 + [0.5] * 5 + [0.8] * 40)
    least = language._least(size, cosine) / language.REJECT
    assert np.allclose(least[[0, 4, 5]], 0.2) and np.allclose(least[[12, 20, 31]], 0.8)
    assert not language._least(np.zeros(0), np.zeros(0)).any()


def test_language_sample_is_rows_not_ids(spark):
    """An id that many rows share is as many examples as it has texts; repeated rows are one; the sample is no larger than asked for."""
    texts = [f"der die das und ist nicht {i} wort satz" for i in range(30)]
    rows = [(1, t, "de") for t in texts] + [(1, texts[0], "de")] * 50 + [(k, f"the and of is not {k} word line", "en") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    for sample in (10, 400):
        m = language.train(docs, among=lambda i: i.isNotNull(), sample=sample, clusters=2)
        assert m.langs == ["de", "en"]
        got = language.identify(docs, m, out="t").select("lang", "t.lang").collect()
        assert all(r[0] == r[1] for r in got) and len(got) == len(rows)


def test_queries_alike_share_a_matrix():
    """Terms that many queries and entries have are multiplied as a matrix; rare ones, and a query on its own, read postings.  All give exact cosines."""
    rng = np.random.default_rng(3)
    common = [np.unique(np.concatenate([rng.choice(12, 8), 100 + rng.integers(0, 900, 20)])) for _ in range(300)]
    m = entries(rng, common, copies=1)
    index = toxicity.Index(m, block=100)
    dense = np.zeros((len(common), len(m.vocabulary)))
    dense[np.repeat(np.arange(len(common)), np.diff(m.bounds)), m.index] = m.weight
    asked = [(m.index[m.bounds[i] : m.bounds[i + 1]], m.weight[m.bounds[i] : m.bounds[i + 1]], i) for i in range(200)]
    laid, columns = [], toxicity.Index._columns

    def seen(self, *rest):
        laid.append(columns(self, *rest))
        return laid[-1]

    toxicity.Index._columns = seen
    try:
        together = index.search(asked)
        many, laid[:] = max(x.sum(axis=0).max() for x in laid), []
        alone = [index.search([q])[0] for q in asked]
    finally:
        toxicity.Index._columns = columns
    assert 8 <= many < 200 and not any(x.any() for x in laid)
    for (term, w, skip), (rows, c), (rows1, c1) in zip(asked, together, alone, strict=True):
        cosine = dense[:, term] @ w.astype(float)
        cosine[skip] = 0
        assert set(rows.tolist()) == set(rows1.tolist()) == nearest(cosine, m.n, toxicity.K)
        assert np.allclose(c, np.minimum(cosine[rows], 1), atol=1e-6) and np.allclose(c, c1)


def test_distinct_terms_with_equal_first_bits():
    term = np.array([5, 1 << 40, 5, 4, 1 << 63, 4, (1 << 40) + 1], dtype=tx.U64)
    for x in (term, term[:0], term[[1, 4, 1]]):
        own, again = toxicity._distinct(x)
        assert own.tolist() == sorted(set(x.tolist())) and (own[again] == x).all()
