"""Language identification, toxicity chain and language model: held-out quality, exact parts, edge cases."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kvloom.llm import language_id, language_model, toxicity
from tests.llm.conftest import DATA

# language identification


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_masks_are_the_languages_that_hold_a_gram():
    r = np.random.default_rng(2)
    names = [f"l{i:03d}" for i in range(70)]
    profiles = language_id.Profiles(names, 1 << 16)
    sets = [r.integers(0, 1 << 62, 200).astype(np.uint64) for _ in names]
    for i, s in enumerate(sets):
        profiles.insert(i, s)
    profiles.close()
    for i, s in enumerate(sets):
        assert ((profiles.masks(s)[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = profiles.masks(r.integers(0, 1 << 62, 5000).astype(np.uint64))
    for i in (0, 69):
        rate = ((other[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        assert rate == pytest.approx(profiles.false[i], abs=0.01)


def test_language_edge_cases(spark, documents):
    rows = [(i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 ... !", "de"), (103, "und die katze", None), (None, "the cat", "en"), (104, "the dog " * 30000, "en"), (105, "THE DOG AND", "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(documents(rows)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "de" and got[None][0] == got[104][0] == got[105][0] == "en"
    assert language_id.identify(documents([])).count() == 0
    assert [r.lang_pred for r in language_id.identify(documents([(1, "nothing to learn from", None)])).collect()] == ["und"]


def test_long_texts_are_the_sum_of_their_pieces(monkeypatch):
    texts = ["Der Hund, und die Katze! " * 40, "", "x" * 90, "the cat"]
    profiles = language_id.Profiles(["de", "en"])
    for i, x in enumerate(("der hund und die katze", "the cat and the dog")):
        profiles.insert(i, language_id.grams([x])[1])
    profiles.close()
    whole = profiles.predict(texts)
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 50)
    cut = profiles.predict(texts)
    assert cut[0] == whole[0] == ["de", "und", whole[0][2], "en"] and cut[1] == pytest.approx(whole[1])
    assert all(len(p) <= 50 for x in texts for p in language_id._pieces(x)) and all("".join(language_id._pieces(x)) == x for x in texts)


def test_too_many_languages_are_an_error(spark, documents, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, "the cat and the dog", f"l{i % 3}") for i in range(60)]
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.identify(documents(rows))
    assert language_id.identify(documents([r for r in rows if r[2] != "l2"])).count() == 40


# toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = r.choices(plain, k=40), int(r.random() < 0.2)
        if toxic:
            words[r.randrange(40)] = r.choice(bad)
            words[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(r.random() < 0.8), toxic))
    return rows, labels


def test_chain_on_held_out_documents(spark, documents):
    rows, labels = toxic_rows(800, 3)
    table = spark.createDataFrame([x for x in labels if x[0] < 500], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.judge(documents(rows), table).collect()}
    held = [x for x in labels if x[0] >= 500]
    assert sum(got[i] == bool(t) for i, _, t in held) >= 0.98 * len(held)


def test_later_models_see_out_of_fold_probabilities():
    r = np.random.default_rng(1)
    first = r.random(600) < 0.5
    row, feature = np.flatnonzero(first), np.zeros(first.sum(), np.int64)
    sample = toxicity.Sample(row, feature, 1, np.stack([first, first], axis=1).astype(int), np.arange(600) % toxicity.FOLDS)
    seen = []

    def fit_folds(k, earlier):
        seen.append(earlier)
        return [sample.fit_without(k, f, earlier) for f in range(toxicity.FOLDS + 1)]

    chain = toxicity.fit_chain(sample, fit_folds)
    for f in range(toxicity.FOLDS):  # what the later model sees of a fold comes from a model without it
        model, inside = sample.fit_without(0, f, np.zeros((600, 0))), sample.fold == f
        assert seen[1][inside, 0] == pytest.approx(model.probability(row, feature, 600, np.zeros((600, 0)))[inside])
    assert len(chain) == 2 and len(chain[0].chain) == 0 and len(chain[1].chain) == 1 and chain[1].chain[0] > 0


def test_fit_is_the_minimum_of_the_loss():
    r = np.random.default_rng(3)
    row, feature = np.repeat(np.arange(200), 5), r.integers(0, 30, 1000)
    y = (r.random(200) < 0.4).astype(float)
    model = toxicity.fit(row, feature, 30, r.random((200, 1)), y)
    z = toxicity._margins(row, feature, 30, np.zeros((200, 1)), np.r_[model.words, model.chain], model.bias, 200)
    assert model.words.shape == (30,) and np.isfinite(z).all()
    earlier = np.zeros((200, 0))
    model = toxicity.fit(row, feature, 30, earlier, y)
    loss = lambda x, b: toxicity._loss(toxicity._margins(row, feature, 30, earlier, x, b, 200), y, x)
    least = loss(model.words, model.bias)
    for k in range(30):
        for gap in (-0.05, 0.05):
            moved = model.words.copy()
            moved[k] += gap
            assert loss(moved, model.bias) > least
    assert loss(model.words, model.bias + 0.05) > least < loss(model.words, model.bias - 0.05)


def test_training_rows_are_bounded_when_a_labelled_id_repeats(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda sample, _: seen.append(len(sample.labels)) or [])
    rows, labels = toxic_rows(60, 4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxicity.train(documents(rows * 30), table, most_texts=30)
    assert seen and seen[0] <= 60


def test_toxicity_edge_cases(spark, documents):
    rows, labels = toxic_rows(300, 5)
    table = spark.createDataFrame([*labels, (None, 1, 1), (0, None, None), (99999, 1, 1), (labels[0][0], 1, labels[0][2])], "doc_id long, quality int, toxic int")
    docs = documents([*rows, (1000, None), (1001, ""), (None, "vile awful nasty"), (1, rows[1][1]), (1002, "word1 " * 60000)])
    got = toxicity.judge(docs, table).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    assert not by[1000].rejected and not by[1001].rejected and not by[1002].rejected and by[None].rejected
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity.judge(docs, none).collect())
    assert toxicity.judge(documents([]), table).count() == 0


# language model


def tokens_of(text):
    """bytes.split() breaks at the six white-space characters of the contract; the end token is empty."""
    return [*(text or "").encode().lower().split(), b""]


def trained(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def check_scores(rows, got):
    counts = Counter()
    for i, t in rows:
        if trained(i):
            counts.update(tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in rows:
        tokens = tokens_of(t)
        want.setdefault(i, []).append((len(tokens), sum(counts[w] > 0 for w in tokens), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, round(r.base_score, 6)))
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}


@pytest.mark.parametrize("sent", [1 << 19, 40])
def test_base_scores_are_exact(spark, documents, monkeypatch, sent):
    monkeypatch.setattr(language_model, "SENT", sent)
    r = random.Random(2)
    rows = [(i, " ".join(f"W{int(r.paretovariate(0.6))}" for _ in range(r.randint(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "w1 unknown-word"), (3, rows[3][1]), (902, "w1 " * 20000), (903, "a\x0bb\x0cc\xa0d\nÉ"), (904, "Z" * 9000 + " w1 " + "z" * 9000)]
    check_scores(rows, language_model.score_texts(documents(rows)).collect())


def test_model_beats_its_base_on_held_out_text(spark, documents):
    r = random.Random(6)
    pairs = {w: r.sample([f"n{i}" for i in range(40)], 2) for w in [f"n{i}" for i in range(40)]}
    rows = []
    for i in range(400):
        words = ["n0"]
        for _ in range(60):
            words.append(r.choice(pairs[words[-1]]))
        rows.append((i, " ".join(words)))
    held = [x for x in language_model.score_texts(documents(rows)).collect() if x.held_out]
    assert held and sum(x.score for x in held) > 0.9 * sum(x.base_score for x in held)


def read(texts):
    return list(language_model.read(pa.array(texts, pa.string())))


@pytest.mark.parametrize("segment", [8, 64, 1 << 16])
def test_reading_agrees_with_splitting(monkeypatch, segment):
    monkeypatch.setattr(language_model, "SEGMENT", segment)
    monkeypatch.setattr(language_model, "LONG", min(language_model.LONG, segment // 2))
    monkeypatch.setattr(language_model, "_powers", [])
    r = random.Random(segment)
    texts = ["", None, " ", "a", "x" * 70 + " y", "  lead", "trail  \n", "A\tB\x0bC\x0cD\rE", "é\xa0ü É", None]
    texts += ["".join(r.choice(" ab\nCé") for _ in range(r.randint(0, 200))) for _ in range(60)] + [""]
    names, seen = {}, []
    for t in read(texts):
        seen += zip(t.row.tolist(), t.name.tolist(), t.twin.tolist(), t.before.tolist(), t.skip.tolist(), strict=True)
    want = [(i, w) for i, x in enumerate(texts) for w in tokens_of(x)]
    assert [x[0] for x in seen] == [i for i, _ in want]
    for (_, name, twin, _, _), (_, w) in zip(seen, want, strict=True):
        assert names.setdefault(w, (name, twin)) == (name, twin)
    assert len(set(names.values())) == len(names)
    for k, (i, _, _, before, skip) in enumerate(seen):
        assert before == (seen[k - 1][1] if k >= 1 and seen[k - 1][0] == i else 0)
        assert skip == (seen[k - 2][1] if k >= 2 and seen[k - 2][0] == i else 0)


def test_tally_keeps_tokens_of_one_name_apart():
    name, twin = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    got = language_model.tally(name, twin, np.array([1, 10, 100, 1000]))
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(5, 1, 101), (5, 2, 10), (9, 1, 1000)]
    table = language_model.Names(name[:2], twin[:2])
    assert table.ranks(name, twin).tolist() == [0, 1, 0, -1]


def vocabulary(known, rare, unknown=2, seed=0):
    """Known sent tokens, unknown sent ones, and as many that are not sent, with their counts."""
    r = np.random.default_rng(seed)
    name, twin = (r.integers(1, 1 << 62, known + unknown + rare).astype(np.uint64) for _ in range(2))
    counts = np.r_[np.sort(r.integers(1, 500, known))[::-1], np.zeros(unknown, np.int64), r.integers(1, 5, rare)]
    sent = known + unknown
    leaves = np.bincount(language_model.leaf_of(twin[sent:]), weights=counts[sent:] + 1, minlength=language_model.LEAVES).astype(np.int64)
    total = int(counts.sum() + known + rare + 1)
    return language_model.Vocabulary(name[:sent], twin[:sent], counts[:sent], leaves, total), name, twin, counts


def every_token(name, twin, before=7, skip=8):
    n = len(name)
    return language_model.Tokens(np.zeros(n, np.int64), name, twin, np.full(n, before, np.uint64), np.full(n, skip, np.uint64))


@pytest.mark.parametrize(("known", "rare"), [(3, 0), (100, 0), (700, 900), (0, 5)])
def test_model_is_a_distribution_and_starts_as_the_base(known, rare):
    v, name, twin, counts = vocabulary(known, rare)
    model, t = language_model.Model.start(v), every_token(name, twin)
    for noise in (0.0, 0.4):
        model.weights += np.random.default_rng(1).normal(0, noise, model.weights.shape).astype(np.float32)
        (_, _, base, p), (_, _, _, gain) = language_model.scores_of(t, v, model)
        p, sent = 10.0**p, len(v.counts)
        p[sent:] *= 10.0**gain * (counts[sent:] + 1)
        if not noise:
            assert p == pytest.approx((counts + 1) / v.total, rel=1e-4)
            assert 10.0 ** base[:sent] == pytest.approx((counts[:sent] + 1) / v.total)
        unknown = 10.0 ** language_model.scores_of(every_token(np.array([1], np.uint64), np.array([1], np.uint64)), v, model)[0][3]
        assert p[counts > 0].sum() + unknown[0] == pytest.approx(1, abs=1e-3)
        assert p[known : known + 2] == pytest.approx(unknown[0])


def test_scores_agree_with_softmaxes_one_by_one():
    v, name, twin, _ = vocabulary(900, 300)
    model = language_model.Model.start(v)
    model.weights += np.random.default_rng(2).normal(0, 0.4, model.weights.shape).astype(np.float32)
    t = every_token(name, twin)
    places = v.places(t)
    got = model.log_probabilities(places, t.before, t.skip)
    f = [int(x[0]) for x in language_model.features(t.before[:1], t.skip[:1])]
    b = language_model.BRANCHES

    def number(k, before):
        """Nodes: the root, then class by class the inner nodes level by level."""
        classes, digits = [int(language_model.DIGITS[i]) for i in range(b)], len(before)
        return 1 + sum((b**d - 1) // (b - 1) for d in classes[:k]) + (b**digits - 1) // (b - 1) + int("".join(map(str, before)) or "0", b)

    for i in range(0, len(name), 7):
        k, code = int(places.class_[i]), int(places.inner[i])
        digits = [code // b**j % b for j in reversed(range(language_model.DIGITS[k]))]
        path = [(0, int(language_model.BRANCH[k]))] + [(number(int(language_model.BRANCH[k]), digits[:j]), d) for j, d in enumerate(digits)]
        want = 0.0
        for node, branch in path:
            z = model.bias[node].astype(float)
            for x in f:
                z = z + model.weights[((x ^ (node * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_model.WEIGHT_BITS)]
            want += z[branch] - math.log(np.exp(z).sum())
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_steps_are_taken_at_every_position_and_lower_the_loss():
    texts = pa.array(["a b c a b " * 150, None, "c b"] * 3)
    tokens = [t for x in texts.to_pylist() for t in tokens_of(x)]
    parts = [language_model.tally(t.name, t.twin, np.ones(len(t.row), np.int64)) for t in language_model.read(texts)]
    name, twin, counts = language_model.tally(*map(np.concatenate, zip(*parts, strict=True)))
    order = np.argsort(-counts, kind="stable")
    v = language_model.Vocabulary(name[order], twin[order], counts[order], np.zeros(language_model.LEAVES, np.int64), len(tokens) + 5)
    start = language_model.Model.start(v)
    steps = language_model.Steps(start)
    loss = lambda m: -sum(language_model.scores_of(t, v, m)[0][3].sum() for t in language_model.read(texts))
    for turn in range(1, 4):
        steps.learn(texts, v)
        assert steps.seen == turn * len(tokens)
    assert loss(steps.model) < 0.7 * loss(start)


def plain_step(steps, places, before, skip):
    """A step whose weights move float by float."""
    d, b = language_model.Decisions(places, language_model.features(before, skip)), language_model.BRANCHES
    error, total = d.odds(steps.model)
    error /= total[:, None]
    error.reshape(-1)[np.arange(0, error.size, b) + d.branch] -= 1
    square = np.square(error) @ np.ones(b, np.float32)
    for at in d.weights:
        np.add.at(steps.sums, at, square)
        move = error * (np.float32(language_model.RATE) / np.sqrt(steps.sums[at]))[:, None]
        np.subtract.at(steps.model.weights.reshape(-1), (at[:, None] * b + np.arange(b)).ravel(), move.ravel())


def test_steps_are_those_of_plain_updates_in_less_time():
    v, name, twin, _ = vocabulary(30_000, 2_000)
    r = np.random.default_rng(4)
    draw = lambda: (r.zipf(1.3, language_model.BATCH) - 1) % len(name)  # noqa: E731  frequent features repeat within a batch
    at, start = draw(), language_model.Model.start(v)
    t = language_model.Tokens(np.zeros(len(at), np.int64), name[at], twin[at], name[draw()], name[draw()])
    places, ours, plain = v.places(t), language_model.Steps(start), language_model.Steps(start)
    took = {language_model.Steps.step: [], plain_step: []}
    for _ in range(30):
        for step, steps in zip(took, (ours, plain), strict=True):
            began = time.thread_time()
            step(steps, places, t.before, t.skip)
            took[step].append(time.thread_time() - began)
    assert (ours.model.weights == plain.model.weights).all() and (ours.sums == plain.sums).all() and ours.model.weights.any()
    assert min(took[language_model.Steps.step]) < 0.9 * min(took[plain_step])


def test_words_that_are_not_sent_keep_their_identity_as_history():
    a, b = read(["rare0 a", "rare1 a"])[0], read(["rare0 a"])[0]
    f, g = np.stack(language_model.features(a.before, a.skip)), np.stack(language_model.features(b.before, b.skip))
    assert (f[:, :3] == g).all() and (f[:, 1] != f[:, 4]).any() and (f[:, 0] == f[:, 3]).all()


@pytest.mark.parametrize("sent", [1 << 20, 2500])
def test_features_tell_rare_words_apart(spark, documents, monkeypatch, sent):
    monkeypatch.setattr(language_model, "SENT", sent)
    # more words than are sent before the pairs, which are of equal counts: only their histories tell them apart
    head = [(1000 + i, " ".join(f"h{j}" for j in range(i % 5, 2500, 5)) + " " + " ".join(f"h{j}" for j in range(i % 5, 2500, 5))) for i in range(300)]
    pairs = [(i, " ".join(f"x{j} y{j}" for j in random.Random(i).sample(range(40), 40))) for i in range(50)]
    seen = next(i for i in range(5000, 6000) if not trained(i))
    unseen = next(i for i in range(seen + 1, 6000) if not trained(i))
    rows = [*head, *pairs, (seen, " ".join(f"x{j} y{j}" for j in range(40))), (unseen, " ".join(f"x{j} y{(j + 20) % 40}" for j in range(40)))]
    got = {r.doc_id: r for r in language_model.score_texts(documents(rows)).collect()}
    assert got[seen].base_score == pytest.approx(got[unseen].base_score)
    assert got[seen].score > got[unseen].score + 4


def test_model_beats_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in language_model.score_texts(docs).collect() if r.held_out]
    better = sum(r.score > r.base_score for r in held)
    assert better >= 0.9 * len(held) and sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)


def test_no_training_text(spark, documents):
    held = next(i for i in range(100) if not trained(i))
    got = language_model.score_texts(documents([(held, "a b")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]
    assert language_model.score_texts(documents([])).count() == 0
