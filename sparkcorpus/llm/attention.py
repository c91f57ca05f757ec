"""A small causal self-attention model over subword ids, in numpy.

A text is a row of blocks of BLOCK positions.  A position attends to its own block up to
itself and to the whole block before: windows of two blocks that overlap by one, so that every
token is scored once, with BLOCK to 2 * BLOCK - 1 tokens of context (fewer at the start).
Every subword has an input vector of its own.  The output is a class of subwords, and the subword's share of
its class: probabilities of all ids sum to one.  Classes of subwords that begin a word come from clustering
neighbours' counts.  Those that continue one are a class by themselves; the share of a subword in it depends
on the subword before, and is given by the caller.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

BLOCK, WIDTH = 16, 16
#: Rows of a piece of a product; bits of a nat.
ROWS, BITS = 256, np.log2(np.e)
#: Frequent subwords whose neighbours are counted; clusters; the classes of other beginnings of words, of
#: continuations, and of the end.
FREQUENT, CLUSTERS = 1024, 61
OTHER, INSIDE, END, CLASSES = CLUSTERS, CLUSTERS + 1, CLUSTERS + 2, CLUSTERS + 3


def mask() -> np.ndarray:
    """What a position may not see: later ones."""
    q, k = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
    return k > q


#: What is added to the scores of keys that are not seen.
HIDDEN = np.where(mask(), -1e9, 0).astype(np.float32)
#: How far back each key lies from each query.
BACK = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0, 2 * BLOCK - 1)


@dataclass(frozen=True)
class Vocabulary:
    """Of each subword id: its class, and log10 of its share of the class (0 for continuations of words).  The id
    after the last is the end of a text; the input vector after that is of its start."""

    group: np.ndarray
    share: np.ndarray

    @property
    def end(self) -> int:
        return len(self.group) - 1


def kmeans(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Weighted Lloyd steps from a spread start; deterministic."""
    if len(x) <= k:
        return np.arange(len(x))
    centres, distance = [int(np.argmax(weight))], None
    for _ in range(k - 1):
        d = ((x - x[centres[-1]]) ** 2).sum(1)
        distance = d if distance is None else np.minimum(distance, d)
        centres.append(int(np.argmax(distance * np.sqrt(weight))))
    c = x[centres]
    for _ in range(rounds):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        total = np.bincount(near, weights=weight, minlength=k)
        sums = np.stack([np.bincount(near, weights=weight * x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], c)
    return near


def vocabulary(counts: np.ndarray, spaced: np.ndarray, after: np.ndarray, frequent: np.ndarray) -> Vocabulary:
    """counts: of each id and the end; spaced: whether an id begins a word; frequent: ids by falling
    count; after[i, j]: how often frequent id j follows frequent id i."""
    rows = [np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1)) for m in (after + 0.0, after.T + 0.0)]
    begins = spaced[frequent]
    x = np.concatenate(rows, 1)[begins] if len(frequent) else np.zeros((0, 1))
    if len(x) > 40:
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        x = u[:, :32] * s[:32]
    group = np.where(spaced, OTHER, INSIDE).astype(np.int32)
    group[frequent[begins]] = kmeans(x, counts[frequent[begins]] + 1.0, CLUSTERS)
    group[-1] = END
    total = np.bincount(group, weights=counts + 0.5, minlength=CLASSES)
    return Vocabulary(group, np.where(group == INSIDE, 0.0, np.log10((counts + 0.5) / total[group])))


def start(vocab: Vocabulary, after: np.ndarray, totals: np.ndarray, frequent: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters that make a bigram model over classes; attention adds nothing yet.  The vectors of ids that are not
    frequent are zero, which makes the next class's share of all."""
    rng = np.random.default_rng(seed)
    follow = np.zeros((len(frequent), CLASSES))
    np.add.at(follow.T, vocab.group[frequent], (after + 0.0).T)
    prior = totals + 1.0
    prior = prior / prior.sum()
    logs = np.log((follow + 20 * prior) / (follow.sum(1, keepdims=True) + 20))
    middle = np.log(prior)
    wide = np.zeros((max(len(frequent), WIDTH), CLASSES))
    wide[: len(frequent)] = logs - middle
    u, s, v = np.linalg.svd(wide, full_matrices=False)
    root = np.sqrt(s[:WIDTH])
    embed = np.zeros((len(vocab.group) + 1, WIDTH))
    embed[frequent] = (u[:, :WIDTH] * root)[: len(frequent)]
    draw = lambda *shape: rng.normal(0, 0.25, shape)
    p = {"embed": embed, "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH), "mixed": np.zeros((WIDTH, WIDTH)), "back": -0.05 * np.arange(2.0 * BLOCK), "out": root[:, None] * v[:WIDTH], "bias": middle}
    empty = np.bincount(vocab.group, minlength=CLASSES) == 0  # a class without subwords has no probability
    p["out"][:, empty], p["bias"][empty] = 0, -1e9
    return {k: x.astype(np.float32) for k, x in p.items()}


def blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the positions of texts of so many positions, which blocks come first, and their owner."""
    many = (lengths + BLOCK - 1) // BLOCK
    begin = (np.cumsum(many) - many) * BLOCK
    place = np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    first = np.zeros(int(many.sum()), dtype=bool)
    first[(np.cumsum(many) - many)[many > 0]] = True
    return place, first, np.repeat(np.arange(len(lengths)), many)


def layout(vocab: Vocabulary, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input and target ids by block (-1: none), first blocks, and owners."""
    return laid_out(vocab, np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum([0, *map(len, ids)]))


def laid_out(vocab: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts that lie one after the other, by their offsets."""
    lengths = np.diff(off) + 1
    place, first, owner = blocks(lengths)
    inputs = np.zeros(len(first) * BLOCK, dtype=np.int32)
    targets = np.full(len(first) * BLOCK, -1, dtype=np.int64)
    begins = off[:-1] + np.arange(len(lengths))  # of each text with its end
    body = np.ones(len(place), dtype=bool)
    body[begins + lengths - 1] = False
    targets[place[body]], targets[place[~body]] = ids, vocab.end
    # an input is the target before it; blocks of a text follow one another
    inputs[1:] = targets[:-1]
    inputs[place[begins]] = vocab.end + 1
    inputs[targets < 0] = 0
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first, owner


class Space:
    """Arrays by name that are written anew by each step, so that no step waits for fresh memory."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.kept = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        if name not in self.kept or len(self.kept[name]) < shape[0]:
            self.kept[name] = np.empty(shape, self.dtype)
        return self.kept[name][: shape[0]]


def rows(z: np.ndarray) -> np.ndarray:
    """Rows in pieces of so many that the product of a piece needs no packing; one piece, if they do not come out even."""
    return z.reshape(-1, len(z) if len(z) % ROWS else ROWS, z.shape[-1])


def times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """a @ b of many rows."""
    np.matmul(rows(a), b, out=rows(out))
    return out


def gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of many rows."""
    return np.matmul(rows(a).transpose(0, 2, 1), rows(b)).sum(0)


def exps(z: np.ndarray, together: int, out: np.ndarray | None = None, exp: np.ufunc = np.exp, bias: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - m), and the sums of exp(z + bias - m) by row; m is 0, or, in a group of `together` rows with a sum that is very large or
    small, the largest of each row.  z becomes z - m, or, where the bias leaves nothing of it, less."""
    weight = exp(np.zeros(z.shape[-1], z.dtype) + bias)[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        e = exp(z, out=out)
        total = (e.reshape(-1, z.shape[-1]) @ weight).reshape(*z.shape[:-1], 1)
    near = (total > 1e-15) & (total < 1e15)
    if not near.all():
        far = np.flatnonzero(~near.reshape(-1, together).all(1))
        groups, sums, e_groups = (x.reshape(-1, together, x.shape[-1]) for x in (z, total, e))
        part = groups[far]
        part = np.minimum(part - (part + bias).max(2, keepdims=True), 60)
        groups[far], e_groups[far] = part, exp(part)
        sums[far] = e_groups[far] @ weight
    return e, total


def attend(scores: np.ndarray, back: np.ndarray, first: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """2 ** (scores + back) of blocks, and its sums by row, or of what `exps` makes of it.  back: by query and key, -1e9 for hidden ones.

    Powers of such numbers take far longer than others, so hidden keys are cleared after it.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a = np.exp2(scores, out=space("a", *scores.shape))
        a *= np.exp2(back)
        a[first, :, :BLOCK] = 0
        total = (a.reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), a.dtype)).reshape(*a.shape[:2], 1)
    if ((total > 1e-15) & (total < 1e15)).all():
        return a, total
    scores += back
    scores[first, :, :BLOCK] = -1e9
    return exps(scores, BLOCK, a, np.exp2)


def forward(p: dict, inputs: np.ndarray, first: np.ndarray, before: np.ndarray | None, space: Space) -> dict:
    """Activations of consecutive blocks, logits without their bias; `before` has the ids of the block before the first.

    A query meets a key only in their product, and a value is mixed at once, so each pair of matrices counts as one.
    Queries, scores and logits are to base 2, whose powers take half the time.
    """
    n, bits = len(inputs), p["embed"].dtype.type(BITS)
    lead = np.zeros((1, BLOCK), np.int32) if before is None else before[None]
    x = np.take(p["embed"], np.concatenate([lead, inputs]), axis=0, out=space("x", n + 1, BLOCK, WIDTH), mode="clip")
    own = x[1:].reshape(-1, WIDTH)
    meet = p["query"] @ p["key"].T * p["query"].dtype.type(WIDTH**-0.5)
    mix = p["value"] @ p["mixed"]
    # each block and the one before, without a copy: their positions follow one another; products with it turned round are faster of a copy
    both = np.lib.stride_tricks.as_strided(x, (n, 2 * BLOCK, WIDTH), x.strides, writeable=False)
    turned = space("turned", n, WIDTH, 2 * BLOCK)
    turned[:, :, :BLOCK], turned[:, :, BLOCK:] = x[:-1].transpose(0, 2, 1), x[1:].transpose(0, 2, 1)
    q = times(own, meet * bits, space("q", len(own), WIDTH)).reshape(n, BLOCK, WIDTH)
    a = np.matmul(q, turned, out=space("scores", n, BLOCK, 2 * BLOCK))
    a, total = attend(a, bits * p["back"][BACK] + HIDDEN, first, space)
    o = np.matmul(a, both, out=space("o", n, BLOCK, WIDTH))
    o /= total
    h = times(o.reshape(-1, WIDTH), mix, space("h", len(own), WIDTH))
    h += own
    logits = times(h, bits * p["out"], space("logits", len(own), CLASSES))
    return {"x": x, "both": both, "turned": turned, "meet": meet, "mix": mix, "q": q, "a": a, "total": total, "o": o, "h": h, "logits": logits}


def log10_probabilities(p: dict, vocab: Vocabulary, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, together: int = 256) -> np.ndarray:
    """Of each block, the sum over its targets."""
    out, space, bias = np.zeros(len(inputs)), Space(p["embed"].dtype), p["bias"] * p["bias"].dtype.type(BITS)
    share = vocab.share + bias[vocab.group] * np.log10(2)  # of each id: what does not depend on its place
    for i in range(0, len(inputs), together):
        part = slice(i, i + together)
        logits = forward(p, inputs[part], first[part], inputs[i - 1] if i else None, space)["logits"]
        t = targets[part].ravel()
        _, total = exps(logits, BLOCK, space("e", *logits.shape), np.exp2, bias)
        picked = logits.ravel()[np.arange(0, logits.size, CLASSES) + vocab.group[t]].astype(np.float64)
        picked -= np.log2(total[:, 0])
        picked *= np.log10(2)
        picked += share[t]
        picked[t < 0] = 0
        out[part] = picked.reshape(-1, BLOCK).sum(1)
    return out


def gradients(p: dict, vocab: Vocabulary, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, with_loss: bool = False, space: Space | None = None) -> tuple[dict, np.ndarray, float | None]:
    """Of the mean negative log-likelihood of the targets' classes.  That of `embed` has a row for each id in the
    second result."""
    space = space or Space(p["embed"].dtype)
    f = forward(p, inputs, first, None, space)
    t = targets.ravel()
    real = t >= 0
    n = max(1, int(real.sum()))
    # what d is multiplied by has the weights that biases make, so d itself need not
    d, total = exps(f["logits"], BLOCK, space("d", *f["logits"].shape), np.exp2, p["bias"] * p["bias"].dtype.type(BITS))
    weight = np.exp(p["bias"])
    cell = np.arange(0, d.size, CLASSES) + vocab.group[t]
    loss = -np.log(np.maximum(d.ravel()[cell] * weight[vocab.group[t]] / total[:, 0], 1e-30)[real]).sum() / n if with_loss else None
    d.ravel()[cell] -= total[:, 0] / weight[vocab.group[t]]  # the gradient of the logits, times the sum of the row; what it is multiplied by is narrower
    d[~real] = 0
    flat = lambda z: z.reshape(-1, z.shape[-1])
    x, both, a, o, q = f["x"], f["both"], f["a"], f["o"], f["q"]
    g = {"out": gram(np.divide(f["h"], total, out=space("narrow", *f["h"].shape)), d) * weight, "bias": ((1 / total).T @ d)[0] * weight}
    dh = times(d, np.ascontiguousarray((p["out"] * weight).T), space("dh", *f["h"].shape))
    dh /= total
    dmix = gram(flat(o), dh)
    do = times(dh, np.ascontiguousarray(f["mix"].T), space("do", *dh.shape)).reshape(o.shape)
    do /= f["total"]  # so a need not be divided
    ds = np.matmul(do, f["turned"], out=space("ds", *a.shape))
    ds -= np.einsum("ijk,ijk->ij", o, do)[:, :, None]  # the mean of the gradient under a
    ds *= a
    g["back"] = np.bincount(BACK.ravel(), weights=ds.sum(0).ravel(), minlength=2 * BLOCK)
    dq = flat(np.matmul(ds, both, out=space("dq", *o.shape)))
    q *= q.dtype.type(1 / BITS)
    dboth = np.matmul(a.transpose(0, 2, 1), do, out=space("dboth", *both.shape))
    dboth += np.matmul(ds.transpose(0, 2, 1), q, out=space("dkeys", *both.shape))
    dmeet = gram(flat(x[1:]), dq) * p["query"].dtype.type(WIDTH**-0.5)
    g["query"], g["key"] = dmeet @ p["key"], dmeet.T @ p["query"]
    g["value"], g["mixed"] = dmix @ p["mixed"].T, p["value"].T @ dmix
    dh += times(dq, np.ascontiguousarray(f["meet"].T), space("narrow", *dq.shape))
    dx = space("dx", *x.shape)
    dx[:1] = 0
    np.add(dboth[:, BLOCK:], dh.reshape(-1, BLOCK, WIDTH), out=dx[1:])
    dx[:-1] += dboth[:, :BLOCK]
    seen = np.concatenate([np.zeros((1, BLOCK), np.int32), inputs]).ravel()
    order = np.argsort(seen.astype(np.uint16) if len(p["embed"]) <= 1 << 16 else seen, kind="stable")  # short keys are sorted by digits
    seen = seen[order]
    begin = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    ids, g["embed"] = seen[begin], np.add.reduceat(np.take(flat(dx), order, axis=0, out=space("sorted", len(order), WIDTH), mode="clip"), begin, axis=0)
    return {k: (v / n).astype(dx.dtype, copy=False) for k, v in g.items()}, ids, loss


def train(p: dict, vocab: Vocabulary, groups: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = 0.01, together: int = 256) -> tuple[dict, np.ndarray, int]:
    """One pass of Adam over groups of texts (their ids and offsets), some blocks at a time; how often each input vector was seen, and
    how many targets there were.  Of the input vectors, those of a step's ids are moved."""
    embed, rest = p["embed"].copy(), pack(p)
    p = unpack(rest, p) | {"embed": embed}
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in (("embed", embed), ("rest", rest))}
    used = np.zeros(len(embed), dtype=np.int64)
    space = Space(embed.dtype)
    step = n = 0

    def moved(k: str, at: np.ndarray | slice, g: np.ndarray) -> np.ndarray:
        m, v = moments[k]
        mk, vk = m[at], v[at]  # copies, if these are rows
        mk *= 0.9
        mk += g * np.float32(0.1)
        vk *= 0.98
        g *= g
        g *= np.float32(0.02)
        vk += g
        if k == "embed":
            m[at], v[at] = mk, vk
        by = vk * np.float32(1 / (1 - 0.98**step))
        np.sqrt(by, out=by)
        by += np.float32(1e-8)
        np.divide(mk, by, out=by)
        by *= np.float32(rate / (1 - 0.9**step))
        return by

    for flat, off in groups:
        inputs, targets, first, _ = laid_out(vocab, flat, off)
        n += int((targets >= 0).sum())
        used += np.bincount(inputs[targets >= 0], minlength=len(used))
        for i in range(0, len(inputs), together):
            step += 1
            part = slice(i, i + together)
            head = first[part].copy()
            head[:1] = True
            g, ids, _ = gradients(p, vocab, inputs[part], targets[part], head, space=space)
            embed[ids] -= moved("embed", ids, g["embed"])
            rest -= moved("rest", slice(None), pack(g))
    return p, used, n


def pack(p: dict) -> np.ndarray:
    """All parameters but the input vectors."""
    return np.concatenate([p[k].ravel() for k in sorted(p) if k != "embed"])


def unpack(flat: np.ndarray, like: dict) -> dict:
    """Parts of `flat`, which they share if it holds what `like` does."""
    out, at = {}, 0
    for k in sorted(k for k in like if k != "embed"):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out
