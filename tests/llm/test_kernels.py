"""Byte kernels, tokeniser and model arithmetic against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrove.llm import attention as A
from docgrove.llm import bpe, lm_scoring
from docgrove.llm import spans as S
from docgrove.llm.common import lean

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECES = ["a", "b", "S", "s", "t", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "!", "?", "é", "ß", "日", " ", "😀", "́", "½", "<|endoftext|>", "\x00", "_"]
texts = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)), max_size=8)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(docs):
    data, offsets = S.flat(pa.array(docs, pa.string()))
    for rule, find in ((WORD, S.words), (ALNUM, S.alnum_words)):
        starts, ends, counts = find(data, offsets)
        got = [data[a:b].tobytes().lower() for a, b in zip(starts, ends)]
        per = [rule.findall((d or "").encode().lower()) for d in docs]
        assert got == [w for p in per for w in p]
        assert counts.tolist() == [len(p) for p in per]
        h = S.hash_spans(data, starts, ends, lower=True)
        seen = {}
        for w, x in zip(got, h.tolist()):
            assert seen.setdefault(w.lower(), x) == x
        assert len(set(seen.values())) == len(seen)
    assert S.code_points(data, offsets).tolist() == [len(d or "") for d in docs]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder()


@given(texts)
@settings(max_examples=100, deadline=None)
def test_ids_equal_the_tokenizers(docs):
    e = bpe.encoder()
    data, offsets = S.flat(pa.array(docs, pa.string()))
    got = [x.tolist() for x in bpe.encoded(data, offsets)]
    assert got == [e.tokenizer.encode(d or "", add_special_tokens=False).ids + [0] for d in docs]


def test_maps_drop_the_tokenizer_that_another_stage_left():
    bpe.encoder()
    assert list(lean(lambda it: it, encodes=True)(iter([1, 2]))) == [1, 2] and bpe._encoders
    assert list(lean(lambda it: it)(iter([1, 2]))) == [1, 2] and not bpe._encoders


def test_slices_and_empty_batches():
    a = pa.array(["one", None, "two three", ""]).slice(1, 2)
    data, offsets = S.flat(a)
    assert data.tobytes() == b"two three" and offsets.tolist() == [0, 0, 9]
    assert S.flat(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(S.chunks(np.array([0, 10, 11, 30]), 12)) == [(0, 2), (2, 3)]


def test_gradients():
    rng = np.random.Generator(np.random.PCG64(1))
    p = {k: v.astype(np.float64) for k, v in A.begin(20, 8, 6, 10).items()}
    rows, stride = rng.integers(0, 20, (3, 10)), 6
    target, valid = rng.integers(0, 6, 18), rng.random(18) < 0.8

    def loss():
        e, total, kept = A.forward(p, rows, stride)
        return -np.log(e[np.arange(18), target] / total[:, 0])[valid].mean(), e, total, kept

    _, e, total, kept = loss()
    g = A.backward(p, e, total, kept, target, valid, stride)
    dense = np.zeros_like(p["e"])
    np.add.at(dense, rows.reshape(-1), g["e"].reshape(-1, 8))
    g["e"] = dense
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            if name == "e":
                at = (rows.reshape(-1)[rng.integers(0, 30)], at[1])
            old, eps = p[name][at], 3e-2
            p[name][at] = old + eps
            up = loss()[0]
            p[name][at] = old - eps
            down = loss()[0]
            p[name][at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_windows_score_each_target_once_and_causally():
    ids = np.arange(1, 200, dtype=np.int64)
    border = np.array([0, 1, 90, 199])
    classes = A.Classes(np.arange(300) % A.CLASSES, np.zeros(300), np.arange(A.CLASSES) < A.CLASSES // 2)
    p = A.begin(300)
    lp, edge = A.log_probs(p, ids, border, classes, batch=3)
    assert np.isfinite(lp).all() and (lp < 0).all() and (edge <= 1e-6).all()
    changed = ids.copy()
    changed[60:90] = 250
    other, _ = A.log_probs(p, changed, border, classes, batch=64)
    assert np.allclose(lp[:60], other[:60], atol=1e-5) and np.allclose(lp[90:], other[90:], atol=1e-5)
    assert not np.allclose(lp[61:90], other[61:90], atol=1e-3)


def test_classes_form_distributions():
    rng = np.random.Generator(np.random.PCG64(4))
    counts = rng.poisson(1.0, (500, A.CONTEXTS)) * (rng.random((500, 1)) < 0.7)
    starts = rng.random(500) < 0.4
    c = A.cluster(counts, starts, 16)
    assert np.allclose([10.0 ** c.inside[c.of == k] @ np.ones((c.of == k).sum()) for k in set(c.of)], 1)
    assert (c.word_start[c.of] == starts).all()


def test_training_learns():
    rng = np.random.Generator(np.random.PCG64(6))
    ids = np.tile(np.arange(10), 400).astype(np.int64)
    border = np.arange(0, 4001, 200)
    classes = A.cluster(np.eye(10, A.CONTEXTS, dtype=np.int64) * 5, np.arange(10) < 5, A.CLASSES)
    p = A.begin(10)
    before = A.log_probs(p, ids, border, classes)[0].mean()
    for _ in range(3):
        p, seen = A.train_stream(p, [(ids, border)], classes)
    assert seen == 4000 and A.log_probs(p, ids, border, classes)[0].mean() > before + 0.5 and rng is not None


def test_training_sees_the_windows_that_scoring_uses(monkeypatch):
    ids = np.arange(1, 200, dtype=np.int64)
    border = np.array([0, 1, 90, 199])
    classes = A.Classes(np.arange(300) % A.CLASSES, np.zeros(300), np.arange(A.CLASSES) < A.CLASSES // 2)
    seen, forward = [], A.forward
    monkeypatch.setattr(A, "forward", lambda p, rows, stride=A.STRIDE: seen.extend((stride, tuple(x)) for x in rows.tolist()) or forward(p, rows, stride))
    A.train_stream(A.begin(300), [(ids, border)], classes)
    trained, seen = sorted(seen), seen.clear() or seen
    A.log_probs(A.begin(300), ids, border, classes)
    assert trained == sorted(seen) and len(trained) == 1 + 3 + 4


def test_context_tells_ids_of_a_class_apart():
    rng = np.random.Generator(np.random.PCG64(7))
    first = rng.integers(0, 2, 4000)
    ids = np.stack([first, first + 2], 1).reshape(-1)  # 2 follows 0, 3 follows 1; both are of one class, as are 4 and 5, which never stand here
    border = np.arange(0, 8001, 40)
    half = np.log10(0.5)
    inside = np.array([half, half, np.log10(0.4), np.log10(0.4), -1, -1])
    classes = A.Classes(np.array([0, 0, 64, 64, 64, 64]), inside, np.arange(A.CLASSES) < A.CLASSES // 2, np.arange(6) < 4)
    p, _ = A.train_stream(A.begin(6), [(ids, border)] * 12, classes)
    assert A.log_probs(p, ids, border, classes)[0][1::2].mean() > np.log10(0.4) + 0.2
    # a distribution over all ids after the same inputs
    total = sum(10.0 ** A.log_probs(p, np.array([0, x]), np.array([0, 2]), classes)[0][1] for x in range(6))
    h = np.ones((1, A.DIM + 1), np.float32)
    inner = [z.sum() for *_, z, _ in A.within(p["w"], h, np.array([2]), classes)]
    assert 0.9 < total <= 1.00001 and inner == pytest.approx([1])


def test_gradients_of_the_second_level():
    rng = np.random.Generator(np.random.PCG64(8))
    classes = A.Classes(np.array([0, 0, 0, 1, 1, 2]), np.log10([0.2, 0.3, 0.5, 0.6, 0.3, 1.0]), np.array([True, False, False]), np.array([1, 1, 1, 1, 1, 0], bool))
    w, h = rng.normal(0, 1, (5, 9)), rng.normal(0, 1, (12, 9))
    h[:, -1] = 1
    ids, valid = rng.integers(0, 6, 12), rng.random(12) < 0.8

    def loss():
        return -sum(np.log(z[np.arange(len(z)), c])[valid[rows]].sum() for rows, _, _, z, c in A.within(w, h, ids, classes)) / valid.sum()

    for x, g in zip((w, h[:, :-1]), A.backward_within(w, h, ids, valid, classes)):
        for at in np.ndindex(*x.shape):
            old, eps = x[at], 1e-4
            x[at] = old + eps
            up = loss()
            x[at] = old - eps
            down = loss()
            x[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_second_level_multiplies_few_groups_and_agrees_with_single_rows():
    rng = np.random.Generator(np.random.PCG64(9))
    of = np.repeat(np.arange(12), [1, 2, 3, 4, 5, 6, 8, 12, 16, 30, 60, 120])
    inside = np.log10(1 / np.bincount(of)[of])
    classes = A.Classes(of, inside, np.arange(12) < 6)
    assert len(classes.groups) <= 5
    ids = rng.integers(0, len(of), 400)
    for scale in (0.3, 30.0):  # the second is beyond what may be exponentiated as it is
        w, h = rng.normal(0, scale, (len(of), 9)), rng.normal(0, 1, (400, 9))
        h[:, -1] = 1
        got = {int(r): x for rows, p in A.chosen(w, h, ids, classes) for r, x in zip(rows, p)}
        assert set(got) == set(np.flatnonzero(of[ids] > 0).tolist())
        for r, x in got.items():
            own = np.flatnonzero(of == of[ids[r]])
            z = w[classes.place[own]] @ h[r] + np.log(10) * inside[own]
            z = np.exp(z - z.max())
            assert x == pytest.approx(z[own == ids[r]][0] / z.sum(), rel=1e-5, abs=1e-12)


def test_steps_grow_and_take_every_window_once(monkeypatch):
    ids = np.random.Generator(np.random.PCG64(10)).integers(0, 40, A.STRIDE * 6000)
    border = np.arange(0, len(ids) + 1, A.STRIDE * 10)
    classes = A.Classes(np.arange(40) % A.CLASSES, np.zeros(40), np.arange(A.CLASSES) < A.CLASSES // 2)
    taken = []
    monkeypatch.setattr(A.Trainer, "step", lambda self, rows, target, valid: taken.append(valid.sum() // A.STRIDE))
    _, seen = A.train_stream(A.begin(40), [(ids, border), (ids, border)], classes)
    assert seen == 2 * len(ids) and sum(taken) == 12000
    assert taken[0] == 64 and max(taken) == 480 and len(taken) < 12000 / 64 / 2


def test_a_step_in_chunks_is_one_step(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(11))
    n, ids = A.CHUNK * 2 + 5, 300
    rows, target = rng.integers(0, ids + 1, (n, A.WINDOW)), rng.integers(0, ids, n * A.STRIDE)
    valid = rng.random(len(target)) < 0.9
    classes = A.Classes(np.arange(ids) % A.CLASSES, np.full(ids, np.log10(1 / 3)), np.arange(A.CLASSES) < A.CLASSES // 2)
    p = A.begin(ids) | A.begin_inside(classes)
    got = []
    for chunk in (A.CHUNK, n):
        monkeypatch.setattr(A, "CHUNK", chunk)
        own = A.Trainer(p, classes, rate=0.01)
        sums = []
        monkeypatch.setattr(A, "backward_attention", lambda *a, f=A.backward_attention, s=sums: s.append(f(*a)) or dict(s[-1]))
        own.step(rows, target, valid)
        monkeypatch.undo()
        got.append({k: np.concatenate([x[k] for x in sums]) if k == "e" else sum(x[k] for x in sums) for k in sums[0]} | {"w": own.p["w"]})
    for k in got[0]:
        assert np.allclose(got[0][k], got[1][k], atol=1e-3 * np.abs(got[1][k]).max()), k


def test_scores_beyond_float32_stay_finite():
    ids = np.arange(1, 200, dtype=np.int64)
    classes = A.Classes(np.arange(300) % A.CLASSES, np.full(300, np.log10(1 / 3)), np.arange(A.CLASSES) < A.CLASSES // 2)
    p = {k: v * 300 for k, v in (A.begin(300) | {"w": A.begin_inside(classes)["w"] + 1}).items()}
    lp, edge = A.log_probs(p, ids, np.array([0, 90, 199]), classes)
    assert np.isfinite(lp).all() and np.isfinite(edge).all()
    trained, _ = A.train_stream(p, [(ids, np.array([0, 90, 199]))], classes)
    assert all(np.isfinite(x).all() for x in trained.values())


def test_frequent_ids_stand_alone_and_rare_ones_by_frequency():
    n = np.array([10000] * 8 + [3000] * 40 + [1] * 400 + [0] * 52)
    counts = np.zeros((500, A.CONTEXTS), np.int64)
    counts[np.arange(500), np.arange(500) % A.CONTEXTS] = n
    c = A.cluster(counts, np.ones(500, bool), 32)  # 16 classes that start words: 8 alone, 7 of like contexts, 1 of rare ids
    alone = [int((c.of[:448] == c.of[i]).sum()) for i in range(8)]
    assert alone == [1] * 8 and len(set(c.of[48:448])) == 1 and not set(c.of[48:448]) & set(c.of[:48])
    assert (c.rank[:8] == -1).all() and np.allclose([10.0 ** c.inside[c.of == k] @ np.ones((c.of == k).sum()) for k in set(c.of)], 1)


def test_words_from_ids_are_those_of_the_text():
    """Also where an id reaches over words, as that of two no-break spaces apart does."""
    texts = ["", " ", "A", "a  B\t\nc ", "\xa0 \xa0", "x\xa0 \xa0 \xa0 \xa0y", "　 \xa0\n\xa0", "<|endoftext|> a<|endoftext|>b", "it's 12 THE"]
    data, offsets = lm_scoring.normalised(*S.flat(pa.array(texts, pa.string())))
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])] == ["".join(" " + w for w in re.findall(r"[^ \t-\r]+", t.lower())) for t in texts]
    ids, border = lm_scoring.word_ids(None, *bpe.encoder().encode(data, offsets))
    ids[border[1:] - 1] = lm_scoring.END
    table = lm_scoring.id_values(None)
    h, own = lm_scoring.word_hashes(data, offsets)
    assert np.array_equal(lm_scoring.words_of_ids(table, ids, np.diff(border)), h)
    assert np.add.reduceat(table[0][ids], border[:-1], dtype=np.int64).tolist() == np.diff(own).tolist()
    assert lm_scoring.id_values(None) is table
    assert all(np.array_equal(x, y) for x, y in zip(lm_scoring.distinct(h), np.unique(h, return_inverse=True)))
