"""Hashed subword bags and a linear softmax over their averages, trained jointly by stochastic gradient descent.

A word's vector is the mean of two: its own and the average of those of its hashed byte n-grams, which reach one
space to either side; a word without a vector of its own has the n-grams'. In training, words lose theirs at random,
so that the n-grams learn to stand for unseen spellings. A word that repeats the one before it has, besides, half the
vector of a bucket of its own that no n-gram can hit. A text's vector is the mean of its words'; with a `focus`, the
mean is weighted by each word's own evidence, so that a few words of a long text can tell. Two classes need one logit,
which is linear in the vectors, so scoring a text is a sum over its n-grams of one learned number each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)
LOWER[9:14] = PLAIN[9:14] = 32  # any white space is a space
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
#: The bucket of repeated words, behind those of n-grams and words.
REPEAT = 1 << BITS
SIZES = (3, 4, 5, 6)
#: N-grams that one step of training has in hand at a time.
SLAB = 1 << 20


def spread(body: np.ndarray, offsets: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with one space before each and at the end; where each row's space stands, and the end."""
    lengths = np.diff(offsets)
    rows = len(lengths)
    out = np.full(int(offsets[-1] - offsets[0]) + rows + 1, 32, dtype=np.uint8)
    marks = offsets - offsets[0] + np.arange(rows + 1)
    keep = np.ones(len(out), dtype=bool)
    keep[marks] = False
    out[keep] = case[body[offsets[0] : offsets[-1]]]
    return out, marks


@dataclass
class Words:
    """Words of some rows: where they start (their leading space), their hashes, and each row's first word."""

    at: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words_of(text: np.ndarray, marks: np.ndarray) -> tuple[Words, np.ndarray]:
    space = SPACE[text]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    since = np.arange(len(text))
    since -= np.maximum.accumulate(np.where(space, since, 0))
    mixed = text * POWERS[np.minimum(since, 63)]
    mixed[space] = 0
    hashes = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
    return Words(starts, hashes, np.searchsorted(starts, marks)), space


def grams(text: np.ndarray, space: np.ndarray):
    """For each size: the bucket of the n-gram from each position, and whether it lies within one word."""
    h = text.astype(np.uint32)
    inner = np.zeros(len(text), dtype=bool)
    for n in range(2, max(SIZES) + 1):
        if len(h) <= 1:
            return
        h = h[:-1] * np.uint32(0x01000193) + text[n - 1 :]
        if n > 2:
            inner = inner[: len(h)] | space[n - 2 : n - 2 + len(h)]
        if n in SIZES:
            mixed = h * np.uint32(0x85EBCA6B + 2 * n)
            yield (mixed ^ (mixed >> np.uint32(15))) >> np.uint32(32 - BITS), ~(inner[: len(h)] | (space[: len(h)] & space[1 : 1 + len(h)]))


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def word_scores(text: np.ndarray, words: Words, space: np.ndarray, weight: np.ndarray, repeats: bool) -> np.ndarray:
    """Half the weight of each word and half the mean weight of its n-grams; of an unknown word the n-grams' alone.

    A repeated word has the mean of that and the weight of repetition."""
    if not len(words.at):
        return np.zeros(0)
    total, number = np.zeros(len(text)), np.zeros(len(text))
    for bucket, valid in grams(text, space):
        n = len(bucket)
        total[:n] += np.where(valid, weight[bucket], 0)
        number[:n] += valid
    score = np.add.reduceat(total, words.at) / np.maximum(np.add.reduceat(number, words.at), 1)
    own = weight[word_buckets(words.hash)]
    score = np.where(own != 0, (score + own) / 2, score)
    if repeats:
        same = repeated(words)
        score[same] = (score[same] + weight[REPEAT]) / 2
    return score


def repeated(words: Words) -> np.ndarray:
    """Whether a word is the one before it in the same row again."""
    same = np.zeros(len(words.hash), dtype=bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.first[:-1][words.first[:-1] < len(same)]] = False
    return same


def pooled(score: np.ndarray, first: np.ndarray, focus: float | None) -> np.ndarray:
    """Each row's mean, or its mean weighted by exp(focus * score); 0 for rows without words."""
    lengths = np.diff(first)
    out = np.zeros(len(lengths))
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    if not focus:
        out[some] = np.add.reduceat(score, first[some]) / lengths[some]
        return out
    top = np.maximum.reduceat(score, first[some])
    weight = np.exp(focus * (score - np.repeat(top, lengths[some])))
    out[some] = np.add.reduceat(weight * score, first[some]) / np.add.reduceat(weight, first[some])
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    case: np.ndarray
    focus: float | None
    repeats: bool

    def logits(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, marks = spread(body, offsets, self.case)
        words, space = words_of(text, marks)
        return pooled(word_scores(text, words, space, self.weight, self.repeats), words.first, self.focus) + self.bias

    def probabilities(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(body, offsets), -40, 40)))


def fit(
    texts: list[str],
    labels: np.ndarray,
    case: np.ndarray = PLAIN,
    focus: float | None = None,
    repeats: bool = False,
    dim: int = 8,
    epochs: int = 15,
    least_rows: int = 3,
    rate: float = 0.5,
    batch: int = 256,
    reach: float = 300.0,
    word_dropout: float = 0.0,
    balance: float = 0.5,
    seed: int = 5,
) -> Model:
    """Train on whole texts. With a focus, rows are weighted means of their words after a start on plain ones.

    N-grams in fewer than `least_rows` rows keep a zero vector, so that a row isn't learned by heart.
    """
    size = (1 << BITS) + 1
    empty = Model(np.zeros(size, np.float32), 0.0, case, focus, repeats)
    labels = np.asarray(labels, dtype=float)
    if not len(texts) or labels.min() == labels.max():
        empty.bias = float(np.clip(8 * (labels.mean() - 0.5) if len(texts) else -4.0, -4, 4))
        return empty
    place: dict[int, int] = {}
    parts, lengths, docs = [], [], []
    for t in texts:
        raw = t.encode()
        text, marks = spread(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), case)
        words, space = words_of(text, marks)
        keys = words.hash.copy()
        again = repeated(words) & repeats
        keys[again] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        fresh, where, back = np.unique(keys, return_index=True, return_inverse=True)
        at = [place.setdefault(k, len(place)) for k in fresh.tolist()]
        new = [i for i, p in zip(where.tolist(), at) if p >= len(lengths)]
        if new:
            per = list(grams(text, space))
            ends = np.append(words.at, len(text))
            own = word_buckets(words.hash)
            for i in new:
                bag = [b[ends[i] : ends[i + 1]][v[ends[i] : ends[i + 1]]] for b, v in per]
                bag = np.concatenate([*bag, own[i : i + 1], *([[REPEAT]] if again[i] else [])]).astype(np.int32)
                parts.append(bag)
                lengths.append(len(bag))
            if len(parts) > 4096:
                parts = [np.concatenate(parts)]
        docs.append(np.array(at, np.int32)[back])
    del place
    flat, sizes = np.concatenate(parts), np.array(lengths, np.int32)
    del parts, lengths
    first_of = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    seen = np.zeros(size, dtype=np.int32)
    for d in docs:
        held = np.unique(d)
        n = sizes[held]
        if len(held):
            inside = np.repeat(first_of[held] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seen[np.unique(flat[inside])] += 1
    kept = seen[flat] >= least_rows
    of_word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept]
    doubled = flat[first_of[1:] - 1] == REPEAT
    kind = np.zeros(len(flat), np.int8)  # of n-grams 0, words 1, repetition 2
    kind[first_of[1:] - 1 - doubled] = 1
    kind[flat == REPEAT] = 2
    flat, kind = flat[kept], kind[kept]
    has_own = np.zeros(len(sizes), bool)
    has_own[of_word[kind == 1]] = True
    grams_of = sizes - 1 - doubled
    share_of_gram = (1 / np.maximum(grams_of, 1)).astype(np.float32)
    whole = np.where(doubled, 0.5, 1).astype(np.float32)
    del seen, kept, first_of

    slabs = [slice(i, i + SLAB) for i in range(0, len(flat), SLAB)]
    shares = lambda c, own, gram: np.where(kind[c] == 2, np.float32(0.5), np.where(kind[c] == 1, own[of_word[c]], gram[of_word[c]]))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    vectors[np.bincount(flat, minlength=size) == 0] = 0
    out = rng.normal(0, 1, dim).astype(np.float32)
    steps_v, steps_o, bias, steps_b = 1e-12, 1e-8, 0.0, 1e-8
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** balance
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        sharp = focus if focus and epoch >= epochs // 3 else 0.0
        for at in range(0, len(order), batch):
            chosen = [i for i in order[at : at + batch] if len(docs[i])]
            if not chosen:
                continue
            bare = (~has_own | (rng.random(len(sizes)) < word_dropout)) & (grams_of > 0)
            own_share = np.where(bare, 0, np.where(grams_of > 0, 0.5, 1)).astype(np.float32) * whole
            gram_share = np.where(bare, 1, 0.5).astype(np.float32) * share_of_gram * whole
            weight = vectors @ out
            scores = np.zeros(len(sizes))
            for c in slabs:
                scores += np.bincount(of_word[c], weights=weight[flat[c]] * shares(c, own_share, gram_share), minlength=len(sizes))
            used = np.concatenate([docs[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in chosen])])
            s = scores[used]
            share_of = np.zeros(len(used))
            logit = np.empty(len(chosen))
            for j, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
                w = np.exp(sharp * (s[a:b] - s[a:b].max()))
                share_of[a:b] = w / w.sum()
                logit[j] = share_of[a:b] @ s[a:b]
            p = 1 / (1 + np.exp(-np.clip(logit + bias, -40, 40)))
            wrong = (p - labels[chosen]) * cost[chosen] / len(chosen)
            per_word = np.bincount(used, weights=share_of * np.repeat(wrong, np.diff(first)), minlength=len(sizes))
            pull = np.zeros(size)
            for c in slabs:
                pull += np.bincount(flat[c], weights=per_word[of_word[c]] * shares(c, own_share, gram_share), minlength=size)
            moved = np.flatnonzero(pull)
            grad_out = pull[moved] @ vectors[moved]
            steps_v += (pull[moved] ** 2).sum() * (out @ out)
            vectors[moved] -= (rate * reach / np.sqrt(steps_v) * pull[moved])[:, None].astype(np.float32) * out
            steps_o += grad_out @ grad_out
            out = (out - rate * grad_out / np.sqrt(steps_o)).astype(np.float32)
            steps_b += wrong.sum() ** 2
            bias -= rate * wrong.sum() / np.sqrt(steps_b)
    return Model((vectors @ out).astype(np.float32), float(bias), case, focus, repeats)
