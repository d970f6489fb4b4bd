"""A causal self-attention language model in numpy.

One attention layer over subword ids predicts the next id by a softmax of two
levels: its class, then the id among the ids of its class that training holds,
both from the same hidden row. Ids of a class follow alike contexts (they are
clustered by what stands before them); within it, corpus counts are the start
and what the second level learns is added. Ids that training lacks keep their
smoothed share of the class. Classes hold either word starts and the end,
or continuations, never both, so the probability that a word ends is a sum of
classes.

Documents are scored in overlapping windows: each window sees ``WINDOW`` inputs and
scores the last ``STRIDE`` targets, so every target is scored once, with at least
``WINDOW - STRIDE`` inputs before it or the document's beginning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 48
STRIDE = 36
DIM = 16
CLASSES = 128
CONTEXTS = 256
LIMIT = 87.0
CHUNK = 96
LOG2E = np.float32(np.log2(np.e))
RATE = 0.05
BEGIN = 0  # rows of the input table: 0 for what stands before a document, then id + 1


@dataclass
class Classes:
    of: np.ndarray  # class of each id
    inside: np.ndarray  # log10 of an id's share of its class
    word_start: np.ndarray  # classes that start a word or end the text
    seen: np.ndarray | None = None  # ids that training holds; all if None

    def __post_init__(self) -> None:
        ids = np.arange(len(self.of)) if self.seen is None else np.flatnonzero(self.seen)
        k = len(self.word_start)
        self.order = ids[np.argsort(self.of[ids], kind="stable")]  # seen ids by class
        self.start = np.searchsorted(self.of[self.order], np.arange(k + 1))
        self.place = np.full(len(self.of), -1, np.int64)  # of each id in ``order``
        self.place[self.order] = np.arange(len(self.order))
        self.share = (self.inside[self.order] * np.log(10)).astype(np.float32)
        kept = np.bincount(self.of[self.order], 10.0 ** self.inside[self.order], minlength=k)
        self.kept = np.log10(np.maximum(kept, 1e-30))  # log10 of what the seen ids of a class hold of it
        # classes of more than one seen id by like size: their ranks, and runs of ranks
        size = np.diff(self.start)
        step = np.ceil(np.log2(np.maximum(size, 1)) / 1.5).astype(np.int64)
        ranked = np.argsort(step, kind="stable")[np.count_nonzero(size < 2) :]
        rank = np.full(k, -1, np.int16)
        rank[ranked] = np.arange(len(ranked))
        self.sizes, self.first = size[ranked], self.start[ranked]
        self.rank = np.where(self.place >= 0, rank[self.of], np.int16(-1))  # of each id's class; -1 if it is alone there or not seen
        self.column = np.where(self.place >= 0, self.place - self.start[self.of], 0)
        border = np.flatnonzero(np.diff(step[ranked], prepend=-1, append=-1))
        self.groups = list(zip(border[:-1].tolist(), border[1:].tolist()))


def cluster(counts: np.ndarray, starts: np.ndarray, classes: int = CLASSES, rounds: int = 12, seed: int = 2) -> Classes:
    """Classes from counts ``(ids, contexts)``; ``starts`` marks ids that start a word or end the text.

    Half of the classes of a kind hold its most frequent ids, one each, which need no second level. A 16th of them
    hold, by frequency, the rare ids that make up the last 64th of its count, too few of each for contexts to tell.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    n = counts.sum(1)
    of = np.zeros(len(n), np.int64)
    seen = n > 0
    some = _starting(classes)
    first = 0
    for mark, k in ((True, some), (False, classes - some)):
        own = np.flatnonzero((starts == mark) & seen)
        ids = np.flatnonzero(starts == mark)
        if len(own) <= k:
            of[ids] = first
            of[own] = first + np.arange(len(own))
        else:
            alone = k // 2
            own = own[np.argsort(-n[own], kind="stable")]
            of[ids] = first + alone  # ids never seen share the first class of several of their kind
            of[own[:alone]] = first + np.arange(alone)
            few = k // 16
            among = k - alone - few
            own = own[alone:]
            tail = min(np.count_nonzero(np.cumsum(n[own][::-1]) < n[ids].sum() / 64), len(own) - among)
            for j, rare in enumerate(np.array_split(own[len(own) - tail :], few) if few else []):
                of[rare] = first + k - few + j
            own = own[: len(own) - tail]
            x = np.sqrt(counts[own] / n[own, None]).astype(np.float32)
            w = n[own].astype(np.float64)
            centre = x[rng.choice(min(4 * among, len(own)), among, replace=False)]
            for _ in range(rounds):
                near = np.argmax(2 * x @ centre.T - (centre**2).sum(1), 1)
                total = np.bincount(near, w, minlength=among)
                for j in range(among):
                    if total[j]:
                        centre[j] = (x[near == j] * w[near == j, None]).sum(0) / total[j]
            of[own] = first + alone + near
        first += k
    smooth = n + 0.5
    inside = np.log10(smooth / np.bincount(of, smooth, minlength=classes)[of])
    word_start = np.zeros(classes, bool)
    word_start[:some] = True
    return Classes(of, inside, word_start, seen)


def begin(ids: int, dim: int = DIM, classes: int = CLASSES, window: int = WINDOW, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    f = np.float32
    p = {name: rng.normal(0, dim**-0.5, (dim, dim)).astype(f) for name in ("q", "k", "v", "o")}
    p["e"] = rng.normal(0, 0.3, (ids + 1, dim)).astype(f)
    p["p"] = rng.normal(0, 0.1, (window, dim)).astype(f)
    p["u"] = rng.normal(0, dim**-0.5, (dim, classes)).astype(f)
    p["b"] = np.zeros(classes, f)
    return p


def begin_inside(classes: Classes, dim: int = DIM) -> dict[str, np.ndarray]:
    """The second level's parameters, a row and a bias for each seen id by class: at first the counts' shares."""
    return {"w": np.zeros((len(classes.order), dim + 1), np.float32)}


def windows(border: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First target, number of targets and document of every window over documents' targets."""
    size = np.diff(border)
    per = -(-size // stride)
    doc = np.repeat(np.arange(len(size)), per)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = border[doc] + j * stride
    return at, np.minimum(border[doc + 1] - at, stride), doc


def inputs_of(ids: np.ndarray, at: np.ndarray, low: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Input rows of windows whose first targets are at ``at``: the id before each target, ``BEGIN`` before the document."""
    where = at[:, None] + (np.arange(window) - (window - stride) - 1)
    rows = ids.take(where, mode="clip") + np.int64(1)
    early = np.flatnonzero(where[:, 0] < low)
    if len(early):
        part = rows[early]
        part[where[early] < low[early, None]] = BEGIN
        rows[early] = part
    return rows


_masks: dict[tuple[int, int], np.ndarray] = {}


def _mask(window: int, stride: int) -> np.ndarray:
    """1 where a target's input may look, else 0."""
    if (window, stride) not in _masks:
        _masks[window, stride] = np.tril(np.ones((window, window), np.float32))[window - stride :]
    return _masks[window, stride]


def _sound(total: np.ndarray) -> bool:
    """Whether sums of exponentials are well within float32's range."""
    return not total.size or bool(total.min() > 1e-20 and total.max() < 1e26)  # false for NaN


def _exp2(x: np.ndarray, limit: float | None = None) -> None:
    """Powers of 2, which numpy has faster than those of e."""
    if limit is not None:
        np.clip(x, -limit, limit, out=x)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp2(x, out=x)


def _starting(classes: int) -> int:
    return max(2, classes // 2)


@np.errstate(over="ignore", invalid="ignore")
def forward(p: dict[str, np.ndarray], rows: np.ndarray, stride: int = STRIDE) -> tuple:
    """Unnormalised class probabilities of the targets, their sums (all, and word starts), and what a gradient needs.

    Scores are exponentiated as they are, which is exact while sums stay within
    float32's range; beyond it, ``LIMIT`` bounds the scores. As the head
    is as wide as the rows, queries meet the inputs themselves, by the product of
    ``q`` and ``k``, and so do weights, whose sums pass that of ``v`` and ``o``.
    """
    n, t = rows.shape
    d = p["q"].shape[0]
    x = p["e"].take(rows, 0)
    x.reshape(n, -1)[...] += p["p"].reshape(-1)
    xt = np.ascontiguousarray(x.transpose(0, 2, 1))
    tail = x[:, t - stride :].reshape(-1, d)
    q = (tail @ (_product(p, "q", "k") * LOG2E)).reshape(n, stride, d)
    for limit in (None, LIMIT):
        a = q @ xt
        _exp2(a, limit)
        a *= _mask(t, stride)
        weight = a.reshape(-1, t) @ np.ones((t, 1), x.dtype)
        if _sound(weight):
            break
    c = (a @ x).reshape(-1, d)
    c /= weight
    h = np.ones((n * stride, d + 1), x.dtype)  # the last column carries the bias
    np.add(c @ _product(p, "v", "o"), tail, out=h[:, :d])
    out = np.vstack([p["u"], p["b"]]) * LOG2E
    sums = np.ones((out.shape[1], 2), x.dtype)
    sums[_starting(len(sums)) :, 1] = 0
    for limit in (None, LIMIT):
        e = _times(h, out)
        _exp2(e, limit)
        total = e @ sums
        if _sound(total[:, 0]):
            break
    return e, total, (x, xt, tail, q, a, weight, c, h)


def _product(p: dict[str, np.ndarray], left: str, right: str) -> np.ndarray:
    """What the head's two maps do together: ``q`` with ``k`` (scaled), ``v`` with ``o``."""
    return p[left] @ p[right] if right == "o" else p[left] @ p[right].T * np.float32(len(p[left]) ** -0.5)


BLOCK = 288  # rows of 17 or 128 numbers at a time, for which matrix products needn't be packed


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, a block of rows at a time."""
    return (x.reshape(-1, BLOCK, x.shape[1]) @ w).reshape(len(x), -1) if len(x) % BLOCK == 0 else x @ w


def _outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y``, a block of rows at a time."""
    if len(x) % BLOCK:
        return x.T @ y
    return np.matmul(x.reshape(-1, BLOCK, x.shape[1]).transpose(0, 2, 1), y.reshape(-1, BLOCK, y.shape[1])).sum(0)


def backward_classes(p: dict[str, np.ndarray], e: np.ndarray, total: np.ndarray, h: np.ndarray, target: np.ndarray, factor: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the class cross-entropy, each row's times its ``factor``: of the class parameters and of the hidden rows; ``e`` is overwritten."""
    e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + target] -= total[:, 0]
    scale = (factor / total[:, 0]).astype(e.dtype)[:, None]
    both = _outer(h * scale, e)
    dh = _times(e, np.ascontiguousarray(p["u"].T))
    dh *= scale
    return {"u": both[:-1], "b": both[-1]}, dh


def backward_attention(p: dict[str, np.ndarray], kept: tuple, dh: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the other parameters, ``e``'s for each input, from those of the hidden rows; what ``forward`` kept isn't changed."""
    x, xt, tail, q, a, weight, c, _ = kept
    n, stride, d = q.shape
    vo = _product(p, "v", "o")
    dvo = _outer(c, dh)
    out = {"v": dvo @ p["o"].T, "o": p["v"].T @ dvo}
    dc = dh @ vo.T
    dc /= weight
    along = (dc * c) @ np.full((d, 1), 1 / LOG2E, c.dtype)
    dc = dc.reshape(n, stride, d)
    da = (dc * (1 / LOG2E)) @ xt  # ``q`` holds LOG2E, which ``da`` lacks
    da -= along.reshape(n, stride, 1)
    da *= a
    dx = a.transpose(0, 2, 1) @ dc
    dx += da.transpose(0, 2, 1) @ q
    dq = (da @ x).reshape(-1, d)
    qk = _product(p, "q", "k") * LOG2E
    dqk = _outer(tail, dq) * (LOG2E * np.float32(d**-0.5))
    out |= {"q": dqk @ p["k"], "k": dqk.T @ p["q"]}
    dx[:, -stride:] += (dh + dq @ qk.T).reshape(n, stride, d)
    out["p"] = dx.sum(0)
    out["e"] = dx
    return out


def backward(p: dict[str, np.ndarray], e: np.ndarray, total: np.ndarray, kept: tuple, target: np.ndarray, valid: np.ndarray, stride: int = STRIDE, more: np.ndarray | float = 0.0) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over valid targets; ``e`` is overwritten, ``more`` is added to the hidden rows' own."""
    out, dh = backward_classes(p, e, total, kept[-1], target, valid / max(int(valid.sum()), 1))
    return out | backward_attention(p, kept, dh + more)


def _second(w: np.ndarray, h: np.ndarray, ids: np.ndarray, classes: Classes, valid: np.ndarray | None = None):
    """Second-level probabilities of valid rows whose class has more than one seen id, a group of classes of like size at a time.

    For each group: its rows, their hidden rows, all its probabilities unscaled, their
    sums, where among them each row's own id is, and the classes' parts of all this:
    rows from and to, places in ``order`` from and to, weights times ``LOG2E``, probabilities.
    """
    rank = classes.rank[ids]
    if valid is not None:
        rank[~valid] = -1
    rows = np.argsort(rank, kind="stable")
    rows = rows[np.count_nonzero(rank < 0) :]
    if not len(rows):
        return
    count = np.bincount(rank[rows], minlength=len(classes.sizes))
    upto = np.concatenate([[0], np.cumsum(count)])
    hidden = h.take(rows, 0)
    wide = w.copy()
    wide[:, -1] += classes.share  # the share joins the bias, as the hidden rows' last column is 1
    wide *= LOG2E
    across = np.ascontiguousarray(wide.T)
    ones = np.ones(int(classes.sizes.max()), h.dtype)
    column = classes.column[ids[rows]]
    for lo, hi in classes.groups:
        a, b = int(upto[lo]), int(upto[hi])
        if a == b:
            continue
        size, n = classes.sizes[lo:hi], count[lo:hi]
        begin = np.concatenate([[0], np.cumsum(size * n)])
        z, total = np.empty(begin[-1], h.dtype), np.empty(b - a, h.dtype)
        parts = []
        for j in np.flatnonzero(n).tolist():
            i, m, s, t = int(upto[lo + j]) - a, int(n[j]), int(classes.first[lo + j]), int(size[j])
            own, part = wide[s : s + t], z[begin[j] : begin[j + 1]].reshape(m, t)
            np.matmul(hidden[a + i : a + i + m], across[:, s : s + t], out=part)
            parts.append((i, i + m, s, s + t, own, part))
        _exp2(z)
        for i, j, s, t, _, part in parts:
            np.matmul(part, ones[: t - s], out=total[i:j])
        if not _sound(total):  # less each row's largest
            for i, j, s, t, _, part in parts:
                np.matmul(hidden[a + i : a + j], across[:, s:t], out=part)
                part -= part.max(1, keepdims=True)
                _exp2(part)
                part.sum(1, out=total[i:j])
        at = np.repeat(begin[:-1] - (upto[lo:hi] - a) * size, n) + np.arange(b - a) * np.repeat(size, n) + column[a:b]
        yield rows[a:b], hidden[a:b], z, total, at, parts


def within(w: np.ndarray, h: np.ndarray, ids: np.ndarray, classes: Classes):
    """Probabilities among their class's seen ids for hidden rows ``h``: rows, their hidden rows, the class's places, probabilities, columns of ``ids``."""
    for rows, hidden, _, total, _, parts in _second(w, h, ids, classes):
        for i, j, s, t, _, part in parts:
            yield rows[i:j], hidden[i:j], np.arange(s, t), part / total[i:j, None], classes.column[ids[rows[i:j]]]


def chosen(w: np.ndarray, h: np.ndarray, ids: np.ndarray, classes: Classes, valid: np.ndarray | None = None):
    """Rows and the probability of each one's id within its class."""
    for rows, _, z, total, at, _ in _second(w, h, ids, classes, valid):
        yield rows, z[at] / total


def backward_within(w: np.ndarray, h: np.ndarray, ids: np.ndarray, valid: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the second level's mean cross-entropy over valid targets: of ``w`` and of the hidden rows."""
    dw, dh = np.zeros_like(w), np.zeros((len(h), h.shape[1] - 1), h.dtype)
    factor = h.dtype.type(1 / max(int(np.count_nonzero(valid)), 1))
    for rows, hidden, z, total, at, parts in _second(w, h, ids, classes, valid):
        z[at] -= total
        scale = (factor / total)[:, None]
        scaled, back = hidden * scale, np.empty((len(hidden), dh.shape[1]), h.dtype)
        for i, j, s, t, own, part in parts:
            np.matmul(part.T, scaled[i:j], out=dw[s:t])
            np.matmul(part, own[:, :-1], out=back[i:j])
        back *= scale / LOG2E
        dh[rows] = back
    return dw, dh


def _add(total: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
    for name, x in g.items():
        total[name] = total[name] + x if name in total else x


class Trainer:
    """Adam on the dense parts, Adagrad on the rows of the input table and of the second level that a batch meets."""

    def __init__(self, p: dict[str, np.ndarray], classes: Classes, rate: float = RATE) -> None:
        self.classes = classes
        self.p = {k: v.copy() for k, v in p.items()}
        self.rate, self.t = rate, 0
        self.dense = [k for k in p if k not in ("e", "w")]
        self.flat = np.concatenate([p[k].reshape(-1) for k in self.dense])  # one array, of which the dense parts are views
        border = np.cumsum([0, *(p[k].size for k in self.dense)]).tolist()
        self.p |= {k: self.flat[a:b].reshape(p[k].shape) for k, a, b in zip(self.dense, border, border[1:])}
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.g = np.full(len(p["e"]), 1e-8, np.float32)
        self.gw = np.full(len(p["w"]), 1e-8, np.float32)
        self.number = np.zeros(len(p["e"]), np.int64)

    def step(self, rows: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """One batch of windows; the rate falls as 1 / sqrt(1 + step / 200)."""
        factor = valid / max(int(np.count_nonzero(valid)), 1)
        steps, grads, back = [], {}, []
        for lo in range(0, len(rows), CHUNK):  # as many windows at a time as a processor's own cache holds
            e, total, kept = forward(self.p, rows[lo : lo + CHUNK])
            own = slice(lo * STRIDE, (lo + CHUNK) * STRIDE)
            g, dh = backward_classes(self.p, e, total, kept[-1], self.classes.of[ids[own]], factor[own])
            steps.append((kept, dh))
            _add(grads, g)
        h = np.concatenate([kept[-1] for kept, _ in steps])
        dw, more = backward_within(self.p["w"], h, ids, valid, self.classes)
        for i, (kept, dh) in enumerate(steps):
            dh += more[i * CHUNK * STRIDE : (i + 1) * CHUNK * STRIDE]
            g = backward_attention(self.p, kept, dh)
            back.append(g.pop("e"))
            _add(grads, g)
        grads["e"] = np.concatenate(back)
        self.t += 1
        rate = self.rate / np.sqrt(1 + self.t / 200)
        g = np.concatenate([grads[k].reshape(-1) for k in self.dense])
        self.m += 0.1 * (g - self.m)
        self.s += 0.02 * (g * g - self.s)
        self.flat -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.98**self.t)) + 1e-8)
        d = self.p["e"].shape[1]
        some = np.zeros(len(self.number), bool)
        some[rows] = True
        ids = np.flatnonzero(some)
        self.number[ids] = np.arange(0, len(ids) * d, d)
        at = self.number[rows].reshape(-1, 1) + np.arange(d)
        sums = np.zeros((len(ids), d), np.float32)
        np.add.at(sums.reshape(-1), at.reshape(-1), grads["e"].reshape(-1))
        self.g[ids] += (sums * sums).mean(1)
        self.p["e"][ids] -= (8 * rate) * sums / np.sqrt(self.g[ids])[:, None]
        self.gw += np.einsum("ij,ij->i", dw, dw) / np.float32(dw.shape[1])
        dw *= (rate / np.sqrt(self.gw))[:, None]
        self.p["w"] -= dw


def train_stream(p: dict[str, np.ndarray], batches, classes: Classes, batch: int = 64, most: int = 480, rate: float = RATE) -> tuple[dict[str, np.ndarray], int]:
    """One pass over all targets of (ids, border) batches, in the windows that scoring uses; the new parameters and the targets seen.

    A step takes ``batch`` windows, later a 16th of those seen, at most ``most``.
    """
    own = Trainer(p if "w" in p else p | begin_inside(classes, p["q"].shape[0]), classes, rate)
    seen = done = 0
    span = np.arange(STRIDE)
    rng = np.random.Generator(np.random.PCG64(5))
    for ids, border in batches:
        at, size, doc = windows(border)
        order = rng.permutation(len(at))
        lo = 0
        while lo < len(order):
            w = order[lo : lo + min(most, max(batch, done // 128 * 8))]
            rows = inputs_of(ids, at[w], border[doc[w]])
            valid = (span < size[w][:, None]).reshape(-1)
            target = ids[np.minimum(at[w][:, None] + span, len(ids) - 1)].reshape(-1)
            own.step(rows, target, valid)
            lo += len(w)
            done += len(w)
        seen += len(ids)
    return own.p, seen


def log_probs(p: dict[str, np.ndarray], ids: np.ndarray, border: np.ndarray, classes: Classes, batch: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each target, and log10 of the probability there that a word starts or the text ends."""
    at, size, doc = windows(border)
    out, boundary, inside = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32), classes.inside[ids]
    span = np.arange(STRIDE)
    for first in range(0, len(at), 16 * batch):  # several batches at once: few rows of a class cost as much as many
        many, n = at[first : first + 16 * batch], size[first : first + 16 * batch]
        place = np.minimum(many[:, None] + span, len(ids) - 1).reshape(-1)
        target = ids[place]
        own_class = classes.of[target]
        p_class, p_edge, hidden = [], [], []
        for lo in range(0, len(many), batch):
            e, total, kept = forward(p, inputs_of(ids, many[lo : lo + batch], border[doc[first + lo : first + lo + batch]]))
            row = np.arange(len(e))
            p_class.append(e[row, own_class[lo * STRIDE : lo * STRIDE + len(e)]] / total[:, 0])
            p_edge.append(total[:, 1] / total[:, 0])
            hidden.append(kept[-1])
        valid = (span < n[:, None]).reshape(-1)
        real = place[valid]
        out[real] = np.concatenate(p_class)[valid]
        boundary[real] = np.concatenate(p_edge)[valid]
        if "w" in p:
            for i, own_share in chosen(p["w"], np.concatenate(hidden), target, classes, valid):
                inside[place[i]] = np.log10(np.maximum(own_share, 1e-30)) + classes.kept[own_class[i]]
    floor = np.float32(1e-30)
    return np.log10(np.maximum(out, floor)) + inside, np.log10(np.maximum(boundary, floor))
