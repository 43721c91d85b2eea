"""Search, classifiers, secrets and tokens against brute force, libraries and held-out rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, quality, secret_scan, sentence_pieces, token_count, topk
from tests.llm.fixtures import awkward, documents, prose

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


# search


def plain_top(rows, k, step):
    ints = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for a, (q, qv) in enumerate(ints):
        if q is not None and qv is not None and q % step == 0:
            s = sorted((-sum(x * y for x, y in zip(qv, v)), i) for b, (i, v) in enumerate(ints) if b != a and v is not None and i is not None)
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 64, 16384])
def test_top_k_equals_brute_force(spark, shard):
    rng = random.Random(shard)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(150)]
    rows += [(150, None), (152, [1.0, None] + [0.0] * 6), (154, [math.nan] * 8), (156, [math.inf] * 8), (158, [0.0] * 8), (160, []), (None, [0.5] * 8)]
    rows += [(200 + i, [0.25] * 8) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 10, shard).collect())
    assert got == plain_top(rows, 5, 10)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 50).collect())
    assert got == sorted([(0, 1, 1, 256 * 512), (0, 2, 0, 65536)] * 2)
    assert topk.top_k(df.filter("false")).count() == 0


@pytest.mark.parametrize("shard", [4, 16384])
def test_large_components_are_scored_exactly(spark, shard):
    rows = [(i, [float(i % 7), -1.0 * i, 0.5]) for i in range(20)]
    rows += [(100, [9000.0, 9000.0, 1e-3]), (110, [2.0**20, 1.0, -(2.0**20)]), (120, [2.0**20, 3.0, -(2.0**20)]), (121, [1e6, -1e6]), (130, [9000.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 10, shard).collect())
    assert got == plain_top(rows, 5, 10)


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1.7e308]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, 3, 50).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def test_index_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    v = rng.normal(0, 30, (4000, 16)).astype(int)
    index = topk.ImpactIndex(v)
    for i in range(0, 400, 40):
        rows, scores = index.search(v[i], 5, i)
        want = v @ v[i]
        want[i] = np.iinfo(np.int64).min
        assert sorted(scores)[-5:] == sorted(want)[-5:]


# classifiers


def noisy(rng, n):
    texts, labels = [], []
    for i in range(n):
        t = prose(rng, rng.randrange(20, 200)).capitalize() + "."
        bad = i % 6 == 0
        texts.append(" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in t.split()) if bad else t)
        labels.append(int(not bad))
    return texts, labels


def test_quality_learns_outside_the_held_out_fold(spark):
    rng = random.Random(5)
    texts, labels = noisy(rng, 600)
    docs = documents(spark, texts + awkward(rng) + [None], list(range(len(texts) + len(awkward(rng)))) + [None])
    marks = spark.createDataFrame([(i, y, None) for i, y in enumerate(labels)] + [(None, 1, 0), (3, None, 0), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r for r in quality.report(docs, marks).collect()]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.97
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.report(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)  # held-out labels are never learned from
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_quality_without_labels_or_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, ["a", None])
    assert [r.score for r in quality.report(docs, marks).collect()] == [0.5, 0.5]
    assert quality.report(docs.filter("false"), marks).count() == 0


def test_quality_equals_a_plain_solve(spark):
    """Scaling, ridge weights and calibration against one dense solve over all labelled rows outside the fold."""
    rng = random.Random(6)
    texts, labels = noisy(rng, 240)
    texts[5], labels[7] = None, None
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)] + [(3, labels[3], 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.measure(docs), marks)
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in range(len(texts))])
    part = np.array([zlib.crc32(str(i).encode()) % 30 // 3 % quality.PARTS for i in range(len(texts))])
    x = quality.statistics([None if t is None else t.encode() for t in texts])
    may = fold != 1
    assert np.allclose(model.centre, x[may].mean(axis=0)) and np.allclose(model.scale[x[may].std(axis=0) > 1e-9], x[may].std(axis=0)[x[may].std(axis=0) > 1e-9])
    rows = np.flatnonzero(may & np.array([q is not None for q in labels]))
    z, y = model.features(x[rows]), np.array([float(labels[i]) for i in rows])
    assert np.isclose(model.base, y.mean())

    def solved(some, share):
        a = z[some].T @ z[some] + quality.RIDGE * len(rows) * share * np.eye(quality.FEATURES)
        return np.linalg.solve(a, z[some].T @ (y[some] - y.mean()))

    assert np.allclose(model.ridge, solved(np.ones(len(rows), bool), 1), atol=1e-8)
    raw = np.zeros(len(rows))
    for p in range(quality.PARTS):
        own = part[rows] == p
        raw[own] = y.mean() + z[own] @ solved(~own, 1 - 1 / quality.PARTS)
    bins = np.clip(np.floor(raw * quality.BINS / 2 + quality.BINS / 4), 0, quality.BINS - 1)
    at = np.unique(bins)
    means, sizes = np.array([y[bins == b].mean() for b in at]), np.array([float((bins == b).sum()) for b in at])
    # The monotone fit by its definition: the largest of the least means of stretches around a bin.
    mean = lambda i, j: (means[i : j + 1] * sizes[i : j + 1]).sum() / sizes[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(b, len(at))) for i in range(b + 1)) for b in range(len(at))]
    assert np.allclose(model.values, want) and np.allclose(model.knots, [raw[bins == b].mean() for b in at])
    got = {r.doc_id: r.score for r in quality.report(docs, marks).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], np.clip(np.interp(model.raw(x), model.knots, want), 0, 1))


def test_pooling_is_the_nearest_monotone_fit():
    assert quality.pooled(np.array([1.0, 0.0, 2.0, 1.0]), np.array([1.0, 1, 1, 3])).tolist() == [0.5, 0.5, 1.25, 1.25]


def test_statistics_do_not_hang_on_neighbours():
    texts = [(t or "").encode() for t in awkward(random.Random(1))]
    together = quality.statistics(texts)
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    make = lambda syllables: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ech"], "cc": ["éa", "oux", "ñi"]}
    langs = [rng.choice(list(kinds)) for _ in range(500)]
    texts = [make(kinds[k]) for k in langs]
    extra = [None, "", "123 !!", "7", "x" * 50000]
    docs = documents(spark, texts + extra, langs=langs + ["aa", None, "bb", None, None])
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert len(got) == len(texts) + len(extra)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(got[i].lang_pred == k for i, k in enumerate(langs)) / len(langs) > 0.98
    assert [got[500 + i].lang_pred for i in range(4)] == ["und"] * 4 and got[504].lang_pred in kinds
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.report(swapped).collect()} == {(i, r.lang_pred, r.score) for i, r in got.items()}


def test_letters_are_unicode_letters():
    assert [langid.has_letter(t) for t in ("½ ² Ⅷ ① 7_", "", None, "é", "漢", "ʰ 1", "\u0301")] == [False, False, False, True, True, True, False]


def test_copies_crowd_out_no_language(spark):
    """A text of one language three thousand times over, others with a few texts; reruns learn the same."""
    rng = random.Random(4)
    texts = ["the same text again and again"] * 3000
    langs = ["en"] * 3000
    for i in range(60):
        for k, alphabet in (("de", "äöüß"), ("fr", "éèçà")):
            texts.append(" ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(12)))
            langs.append(k)
    docs = documents(spark, texts, langs=langs)
    models = [langid.fit(d, sample=30) for d in (docs, docs.repartition(7))]
    assert models[0].langs == ["de", "en", "fr"] and (models[0].weights == models[1].weights).all()
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred <> lang").count() == 0


def test_many_copies_of_few_texts_are_learned(spark):
    """A language of 8,000 rows made of 5 texts beside one of many texts: every one of the 5 is in the sample."""
    rng = random.Random(6)
    few = [" ".join("".join(rng.choice("äöüßk") for _ in range(6)) for _ in range(20)) for _ in range(5)]
    texts = [few[i % 5] for i in range(8000)] + [" ".join("".join(rng.choice("thweo") for _ in range(4)) for _ in range(15)) for _ in range(600)]
    langs = ["de"] * 8000 + ["en"] * 600
    docs = documents(spark, texts, langs=langs)
    assert langid.fit(docs).langs == ["de", "en"]
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang_pred <> lang").count() == 0


def plain_ftrl(rows, langs, idf, epochs, batch, seed=5):
    """Follow-the-regularised-leader over dense TF-IDF rows, coordinate by coordinate."""
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    learn = rows[len(rows) // 5 :]
    x = np.zeros((len(learn), langid.BUCKETS + 1))
    for i, (_, buckets, counts) in enumerate(learn):
        x[i, buckets] = np.log1p(counts) * idf[buckets]
        x[i] /= np.linalg.norm(x[i])
        x[i, -1] = 1
    used = np.flatnonzero(x.any(axis=0))
    x, y = x[:, used], np.array([r[0] for r in learn])
    z, squares, w = (np.zeros((len(used), len(langs))) for _ in range(3))
    for _ in range(epochs):
        for at in range(0, len(learn), batch):
            xs, ys = x[at : at + batch], y[at : at + batch]
            p = np.exp(xs @ w - (xs @ w).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ys)), ys] -= 1
            g = xs.T @ p
            for j in range(len(used)):
                for c in range(len(langs)):
                    sigma = (math.sqrt(squares[j, c] + g[j, c] ** 2) - math.sqrt(squares[j, c])) / langid.ALPHA
                    z[j, c] += g[j, c] - sigma * w[j, c]
                    squares[j, c] += g[j, c] ** 2
                    if abs(z[j, c]) <= langid.L1:
                        w[j, c] = 0
                    else:
                        w[j, c] = -(z[j, c] - math.copysign(langid.L1, z[j, c])) / ((langid.BETA + math.sqrt(squares[j, c])) / langid.ALPHA + langid.L2)
    return used, w


def test_language_weights_equal_a_plain_fit():
    rng = random.Random(8)
    rows = []
    for i in range(25):
        counts = {}
        for _ in range(20):
            b = rng.randrange(12) + 6 * (i % 2)
            counts[b] = counts.get(b, 0) + 1
        at = np.array(sorted(counts), np.int32)
        rows.append((i % 2, at, np.array([counts[b] for b in at.tolist()], np.int32)))
    model = langid.Model(["a", "b"], np.linspace(1, 2, langid.BUCKETS))
    langid._train(model, rows)
    used, want = plain_ftrl(rows, model.langs, model.idf, langid.EPOCHS, langid.BATCH)
    got = np.vstack([model.weights, model.bias])
    assert np.allclose(got[used], want, atol=1e-9) and not np.delete(got, used, axis=0).any()


def test_languages_without_any_to_learn(spark):
    docs = documents(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.report(docs).collect()} == {("und", 0.0)}
    assert langid.report(docs.filter("false")).count() == 0


def test_weights_are_sparse(spark):
    docs = documents(spark, [f"alpha{i} beta" for i in range(60)] + [f"ωμεγα{i} ψι" for i in range(60)], langs=["a"] * 60 + ["b"] * 60)
    model = langid.fit(docs)
    assert model.langs == ["a", "b"] and (model.weights == 0).mean() > 0.9 and model.temperature > 0


# secrets


@pytest.fixture(scope="module")
def language():
    return secret_scan.Language(secret_scan.read_words(PIECES))


@pytest.fixture(scope="module")
def forest(language):
    return secret_scan.train(language)


def test_forest_tells_findings_it_has_not_seen(language, forest):
    rows = secret_scan.made_findings(language, 600, seed=99)
    x = np.array([secret_scan.features(b, c, a, p, language) for b, c, a, p, _ in rows])
    assert ((forest.probability(x) >= 0.5) == np.array([r[4] for r in rows])).mean() > 0.93


def test_secrets_are_found_where_they_stand(spark, language, forest):
    rng = random.Random(7)
    key = "".join(rng.choices("0123456789abcdef", k=40))
    text = f"é some words\napi_key = \"{key}\" then 4417744280351547 and 34@mail7.example.com"
    docs = documents(spark, [text, key + " " * 3, *awkward(rng), None])
    found = secret_scan.scan(docs, language, forest).collect()
    hits = [r for r in found if r.is_secret and r.doc_id == 0]
    assert [(r.start, r.end) for r in hits] == [(text.index(key), text.index(key) + 40)]
    assert all(0 <= r.score <= 1 for r in found)
    assert secret_scan.scan(docs.filter("false"), language, forest, path="missing").count() == 0


def test_findings_can_be_given(spark, language):
    rows = [("k = ", f"A1b2C3d4E5f6G7h{i}", "", None, 1) for i in range(40)] + [("", f"plainwordswords{i}", "", None, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "before string, candidate string, after string, path string, label int")
    f = secret_scan.train(language, df, max_findings=60)
    p = f.probability(np.array([secret_scan.features(b, c, a, q, language) for b, c, a, q, _ in rows]))
    assert p[:40].min() > p[40:].max()


# tokens


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts(rng):
    texts = [t for t in awkward(rng)] + [prose(rng, 700, 3000), prose(rng, 500).replace(" ", ""), " " * 700, "a  b" * 300, "▁x ▁" * 100]
    return texts + ["".join(rng.choice("ab é漢🙂\n\tß") for _ in range(rng.randrange(1, 900))) for _ in range(12)]


@pytest.mark.parametrize("giant", [50, 32768])
def test_encoding_is_the_library_s(spark, library, giant):
    texts = odd_texts(random.Random(10))
    docs = documents(spark, texts, [i if i % 9 else None for i in range(len(texts))])
    got = sentence_pieces.encode(docs, PIECES, chunk=97, giant=giant).collect()
    want = sorted((str(i if i % 9 else None), library.encode(t or "")) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), list(r.token_ids)) for r in got) == want
    assert all(r.n_tokens == len(r.token_ids) for r in got)
    back = sentence_pieces.decode(spark.createDataFrame(got), PIECES)
    marked = {str(r.doc_id) for r in got if not r.round_trip}
    assert back.count() == len(texts) and len(marked) <= 1  # the text that holds the visible space
    assert sentence_pieces.encode(docs.filter("false"), PIECES).count() == 0


class ToyUnigram(sentence_pieces.PieceModel):
    """A unigram model without a file, for the scan alone."""

    def __init__(self, scores):
        self.scores, self.unigram, self.pairs = scores, True, {}
        self.ids = {p: i for i, p in enumerate(scores)}
        self.bytes, self.longest = {}, max(map(len, scores))
        self.joins = {c for p in scores if len(p) > 1 for c in p}
        self.worst = min(scores.values()) - 10.0


def test_unigram_scan_finds_a_best_path():
    rng = random.Random(12)
    pieces = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -rng.random() * 5 for _ in range(25)} | {"a": -3.0, "b": -3.5, "c": -4.0}
    model = ToyUnigram(pieces)
    for _ in range(40):
        text = "".join(rng.choices("abc", k=rng.randint(40, 90)))
        best = [0.0] + [-math.inf] * len(text)
        for i in range(len(text)):
            for n in range(1, model.longest + 1):
                if text[i : i + n] in pieces and i + n <= len(text):
                    best[i + n] = max(best[i + n], best[i] + pieces[text[i : i + n]])
        cuts = [0, *range(17, len(text) - 17, 17), len(text)]
        parts = [sentence_pieces.transfer(model, text, a, b, b == len(text)) for a, b in zip(cuts, cuts[1:])]
        at = sentence_pieces.boundary_path([p[2] for p in parts])
        found = []
        for (a, b), p, i, j in zip(zip(cuts, cuts[1:]), parts, at, at[1:]):
            found += sentence_pieces.chunk_pieces(model, text, a, b, p[0][i], p[1][j])
        names = list(pieces)
        assert "".join(names[i] for i in found) == text
        assert abs(sum(pieces[names[i]] for i in found) - best[-1]) < 1e-9


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=(2, 3)), rng.normal(size=(3, 4)), rng.normal(size=(4, 2))
    a[0, 1] = -np.inf
    f = sentence_pieces.combined
    assert np.allclose(f(f(a, b), c), f(a, f(b, c)))


def test_token_counts_equal_greedy_matching(spark):
    from tokenizers import Tokenizer, models

    initial, continuing = token_count.read_vocabulary(PIECES)
    vocabulary = {p: i for i, p in enumerate(["[UNK]", *initial, *("##" + c for c in continuing)])}
    plain = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9))
    rng = random.Random(13)
    texts = [t.replace("#", "") if t else t for t in odd_texts(rng)]
    got = {r.doc_id: r for r in token_count.report(documents(spark, texts), (initial, continuing)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        pieces = [plain.encode(w.decode()).tokens for w in words]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces))
    assert token_count.report(documents(spark, texts).filter("false"), (initial, continuing)).count() == 0


def test_small_automata_equal_plain_greedy():
    rng = random.Random(14)
    for _ in range(300):
        some = lambda n: {"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(n)}
        first, rest = some(3), some(4)
        m = token_count.LongestMatch(first, rest)
        word = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        at, n = 0, 0
        while at < len(word):
            fits = [k for k in range(1, len(word) - at + 1) if word[at : at + k] in (rest if at else first)]
            if not fits:
                n = -1
                break
            at, n = at + max(fits), n + 1
        assert m.count(word) == n
