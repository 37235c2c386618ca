"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A text is its words in windows of WINDOW words that overlap by half; the score of a text is that of its
worst window. A word enters as the sum of a vector of its own and the mean of the vectors of its character
n-grams, both hashed. Two gated recurrent layers read the window forwards and backwards, attention pools
their states, and a logistic unit scores the pool. All is numpy: the fit on a bounded sample of labelled
rows, and the scores in Spark tasks over every window of every text.

A label says that some window is toxic, so the fit takes the windows of toxic texts that score highest so
far, and of other texts both the highest and some at random.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.llm.common import held
from shiftgauge.llm.labelled import held_out, labelled_sample

WINDOW, STRIDE = 16, 8
WORD_BUCKETS, CHARACTER_BUCKETS = 1 << 15, 1 << 14
GRAMS = (3, 4, 5)
INPUT, HIDDEN, ATTENTION = 8, 8, 8
#: The fit sees at most so many rows of either label, and no text longer than that.
FIT_ROWS, FIT_CHARACTERS = 2000, 50_000
EPOCHS, BATCH, RATE = 12, 256, 0.01
#: Windows of a text that the fit looks at; the share of words that it takes as unknown; doubt about rare ones.
TOXIC_WINDOWS, CLEAN_WINDOWS, UNKNOWN_WORDS, RARE = 400, 24, 0.3, 3
#: Longer runs, as in scripts without spaces, are several words of so many characters, which overlap by OVERLAP: a
#: character n-gram less one, so that none is lost.
WORD_CHARACTERS, OVERLAP = 40, max(GRAMS) - 1
TOXIC_FROM = 0.3
#: Words that a worker remembers, windows that it scores at a time, and words that it cuts at a time.
REMEMBERED, SCORED_WINDOWS, CUT_WORDS = 200_000, 2048, 500_000
#: Words of the fit whose n-grams are summed up at a time.
LEXICON_WORDS = 4096

_words = re.compile(r"\w+").findall


def text_words(text: str | None) -> list[str]:
    found = _words(text.lower()) if text else []
    if not found or max(map(len, found)) <= WORD_CHARACTERS:
        return found
    return [piece for word in found for piece in pieces(word)]


def pieces(word: str) -> list[str]:
    if len(word) <= WORD_CHARACTERS:
        return [word]
    return [word[i : i + WORD_CHARACTERS] for i in range(0, len(word) - OVERLAP, WORD_CHARACTERS - OVERLAP)]


def word_features(word: str) -> tuple[int, list[int]]:
    """The word's bucket and those of its character n-grams."""
    data = f"^{word}$"
    grams = [zlib.crc32(data[i : i + n].encode()) % CHARACTER_BUCKETS for n in GRAMS for i in range(len(data) - n + 1)]
    return zlib.crc32(word.encode()) % WORD_BUCKETS, grams or [zlib.crc32(data.encode()) % CHARACTER_BUCKETS]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE words, the last one at the end of the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), dtype=np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _tanh(x: np.ndarray) -> np.ndarray:
    """By exp, which numpy computes several values at a time."""
    return 1 - 2 / (1 + np.exp(2 * np.clip(x, -30, 30)))


class Network:
    """Weights by name. Gates are in the order reset, update, candidate."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        w = {
            "word": normal(WORD_BUCKETS, INPUT, scale=0.05),
            "character": normal(CHARACTER_BUCKETS, INPUT, scale=0.05),
            "attend": normal(2 * HIDDEN, ATTENTION, scale=0.3),
            "attend_out": normal(ATTENTION, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "out_bias": np.full(1, -2, np.float32),
        }
        for side in ("f", "b"):
            w[f"in_{side}"] = normal(INPUT, 3 * HIDDEN, scale=0.4)
            w[f"rec_{side}"] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
            w[f"bias_{side}"] = np.zeros(3 * HIDDEN, np.float32)
        self.w = w

    def _direction(self, gates_in: np.ndarray, side: str, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States of one direction. gates_in: steps x windows x 3 HIDDEN, in the order of reading."""
        rec = self.w[f"rec_{side}"]
        steps, n = gates_in.shape[:2]
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            from_state = h @ rec
            ru = _sigmoid(gates_in[t, :, : 2 * HIDDEN] + from_state[:, : 2 * HIDDEN])
            r, u = ru[:, :HIDDEN], ru[:, HIDDEN:]
            c = _tanh(gates_in[t, :, 2 * HIDDEN :] + r * from_state[:, 2 * HIDDEN :])
            new = c + u * (h - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((h, r, u, c, from_state[:, 2 * HIDDEN :]))
            states[t] = h = new
        return states

    def logits(self, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. gates: steps x windows x 3 HIDDEN in the order of the text; mask: real words."""
        w, kept_f, kept_b = self.w, [], []
        flip = None if mask is None else mask[::-1]
        forward = self._direction(gates_f, "f", mask, kept_f if keep is not None else None)
        backward = self._direction(gates_b[::-1], "b", flip, kept_b if keep is not None else None)[::-1]
        states = np.concatenate([forward, backward], axis=2)
        hidden = _tanh(states @ w["attend"])
        scores = hidden @ w["attend_out"]
        if mask is not None:
            scores = np.where(mask, scores, -1e9)
        weights = np.exp(scores - scores.max(axis=0))
        weights /= weights.sum(axis=0)
        pool = (weights[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"f": kept_f, "b": kept_b, "states": states, "hidden": hidden, "weights": weights, "pool": pool}
        return pool @ w["out"] + w["out_bias"]

    def _back_direction(self, grad: np.ndarray, kept: list, side: str, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        rec = self.w[f"rec_{side}"]
        steps = len(kept)
        gates = np.zeros((steps, grad.shape[1], 3 * HIDDEN), np.float32)
        g_rec = np.zeros_like(rec)
        carry = np.zeros_like(grad[0])
        for t in reversed(range(steps)):
            h, r, u, c, from_state = kept[t]
            m = mask[t][:, None]
            total = grad[t] + carry
            g_new = np.where(m, total, 0)
            g_c = g_new * (1 - u) * (1 - c * c)
            g_u = g_new * (h - c) * u * (1 - u)
            g_r = g_c * from_state * r * (1 - r)
            gates[t] = np.concatenate([g_r, g_u, g_c], axis=1)
            through = np.concatenate([g_r, g_u, g_c * r], axis=1)
            g_rec += h.T @ through
            carry = np.where(m, g_new * u + through @ rec.T, total)
        return gates, {f"rec_{side}": g_rec, f"bias_{side}": gates.sum(axis=(0, 1))}

    def gradients(self, inputs: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean logistic loss; those of the inputs apart. inputs: steps x windows x INPUT."""
        w, keep = self.w, {}
        gates = [inputs @ w[f"in_{s}"] + w[f"bias_{s}"] for s in ("f", "b")]
        logits = self.logits(*gates, mask, keep)
        g = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        states, hidden, weights, pool = (keep[k] for k in ("states", "hidden", "weights", "pool"))
        out = {"out": pool.T @ g, "out_bias": g.sum(keepdims=True)}
        g_pool = g[:, None] * w["out"]
        g_states = weights[:, :, None] * g_pool
        g_weights = (states * g_pool).sum(axis=2)
        g_scores = weights * (g_weights - (weights * g_weights).sum(axis=0))
        g_hidden = g_scores[:, :, None] * w["attend_out"] * (1 - hidden * hidden)
        out["attend_out"] = np.tensordot(g_scores, hidden, ((0, 1), (0, 1)))
        out["attend"] = np.tensordot(states, g_hidden, ((0, 1), (0, 1)))
        g_states = g_states + g_hidden @ w["attend"].T
        g_f, more = self._back_direction(g_states[:, :, :HIDDEN], keep["f"], "f", mask)
        out |= more
        g_b, more = self._back_direction(g_states[::-1, :, HIDDEN:], keep["b"], "b", mask[::-1])
        out |= more
        g_b = g_b[::-1]
        out["in_f"], out["in_b"] = (np.tensordot(inputs, g, ((0, 1), (0, 1))) for g in (g_f, g_b))
        return out, g_f @ w["in_f"].T + g_b @ w["in_b"].T


class Lexicon:
    """Distinct words of the fit, and their features in flat arrays."""

    def __init__(self, texts: list[str]) -> None:
        self.number: dict[str, int] = {}
        self.texts = [np.array([self.number.setdefault(w, len(self.number)) for w in text_words(t)], np.int32) for t in texts]
        bucket, counts, grams = array("i"), array("i"), array("i")
        for word in self.number:
            own, found = word_features(word)
            bucket.append(own)
            counts.append(len(found))
            grams.extend(found)
        self.bucket, self.gram_counts = np.array(bucket, np.int64), np.array(counts, np.int64)
        self.grams = np.array(grams, np.int32)

    def vectors(self, net: Network) -> np.ndarray:
        """Inputs of all words, and a row of zeros for places without a word."""
        ends = np.cumsum(self.gram_counts)
        starts = ends - self.gram_counts
        out = np.zeros((len(starts) + 1, INPUT), np.float32)
        for at in range(0, len(starts), LEXICON_WORDS):
            part = slice(at, min(at + LEXICON_WORDS, len(starts)))
            grams = net.w["character"][self.grams[starts[at] : ends[part.stop - 1]]]
            means = np.add.reduceat(grams, starts[part] - starts[at], axis=0) / self.gram_counts[part, None]
            out[part] = net.w["word"][self.bucket[part]] + means
        return out

    def start_from_odds(self, net: Network, labels: np.ndarray) -> None:
        """Let the first input of words and n-grams begin as the log odds of their texts' labels, less where seen rarely."""
        seen = [np.unique(text) for text in self.texts]
        for name, size in (("word", WORD_BUCKETS), ("character", CHARACTER_BUCKETS)):
            counts = np.zeros((2, size))
            for words, label in zip(seen, labels, strict=True):
                found = self.bucket[words] if name == "word" else grams_of(self, words)[0]
                counts[int(label), np.unique(found)] += 1
            totals = np.bincount(labels.astype(int), minlength=2)
            odds = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
            odds *= counts.sum(axis=0) / (counts.sum(axis=0) + RARE)
            net.w[name][:, 0] += (odds / 4).astype(np.float32)

    def windows(self, texts: np.ndarray, most: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Windows of some texts, at most so many of each drawn at random, and whose they are."""
        rows, owners = [], []
        absent = len(self.bucket)
        for i in texts:
            text = self.texts[i]
            starts = window_starts(len(text))
            if len(starts) > most:
                starts = np.sort(draw.choice(starts, most, replace=False))
            padded = np.append(text, np.full(WINDOW, absent, np.int32))
            rows.append(padded[starts[:, None] + np.arange(WINDOW)])
            owners.append(np.full(len(starts), i))
        return np.concatenate(rows), np.concatenate(owners)


def fit(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit on texts and labels 0 or 1. Without rows of both labels the network scores every window low."""
    net = Network(seed)
    targets = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.w["out"][:] = 0
        return net
    lexicon = Lexicon(texts)
    if not lexicon.number:
        net.w["out"][:] = 0
        return net
    lexicon.start_from_odds(net, targets)
    draw = np.random.default_rng(seed)
    absent = len(lexicon.bucket)
    toxic, owner_toxic = lexicon.windows(np.flatnonzero(targets == 1), TOXIC_WINDOWS, draw)
    first, second = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        clean, owner_clean = lexicon.windows(np.flatnonzero(targets == 0), CLEAN_WINDOWS, draw)
        windows, owner = np.concatenate([toxic, clean]), np.concatenate([owner_toxic, owner_clean])
        vectors = lexicon.vectors(net)
        if epoch == 0:
            scores = np.sort(vectors[:, 0][windows], axis=1)[:, -2:].sum(axis=1)
        else:
            scores = score_windows(
                net, vectors @ net.w["in_f"] + net.w["bias_f"], vectors @ net.w["in_b"] + net.w["bias_b"], windows, absent
            )
        order = np.lexsort((-scores, owner))
        fresh = np.where(np.diff(owner[order], prepend=-1) != 0, np.arange(len(order)), 0)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.maximum.accumulate(fresh)
        of_toxic = np.arange(len(owner)) < len(toxic)
        worst = np.flatnonzero(of_toxic & (rank < 2))
        others = np.flatnonzero(~of_toxic & ((rank < 2) | (draw.random(len(rank)) < 1 / CLEAN_WINDOWS)))
        repeats = max(1, round(len(others) / (3 * max(1, len(worst)))))
        chosen = np.concatenate([np.repeat(worst, repeats), others])
        chosen = draw.permutation(chosen)
        size = min(BATCH, max(32, len(chosen) // 30))  # small samples take smaller steps, so as many of them
        for at in range(0, len(chosen), size):
            batch = chosen[at : at + size]
            ids = windows[batch].T
            mask = ids != absent
            used, inverse = np.unique(ids, return_inverse=True)
            inverse = inverse.reshape(ids.shape)
            known = draw.random(len(used)) >= UNKNOWN_WORDS
            inputs = vectors_of(net, lexicon, used, absent, known)[inverse]
            grads, g_inputs = net.gradients(inputs, mask, targets[owner[batch]])
            _, per_word = _sums(inverse.ravel(), g_inputs.reshape(-1, INPUT))
            real = used != absent
            grads["word"], grads["character"] = spread(lexicon, used[real], per_word[real], known[real])
            step += 1
            for name, grad in grads.items():
                rows_at, value = grad if isinstance(grad, tuple) else (slice(None), grad)
                first[name][rows_at] = 0.9 * first[name][rows_at] + 0.1 * value
                second[name][rows_at] = 0.99 * second[name][rows_at] + 0.01 * value * value
                ahead = first[name][rows_at] / (1 - 0.9**step)
                net.w[name][rows_at] -= RATE * ahead / (np.sqrt(second[name][rows_at] / (1 - 0.99**step)) + 1e-6)
    return net


def calibrated(net: Network, texts: list[str], labels: list[int], weights: dict[int, float]) -> Network:
    """Scale and shift the last unit so that the scores of texts that the fit has not seen are probabilities."""
    tops = np.array([s for s in Scorer(net).logits(texts)])
    seen = np.isfinite(tops)
    x, y = tops[seen], np.array(labels, float)[seen]
    if len(set(y)) < 2:
        return net
    weight = np.array([weights[int(v)] for v in y])
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small pull towards (1, 0)
        p = _sigmoid(scale * x + shift)
        g = np.array([(weight * (p - y) * x).sum() + scale - 1, (weight * (p - y)).sum() + 0.1 * shift])
        v = weight * p * (1 - p)
        hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        scale, shift = scale - move[0], shift - move[1]
    scale = max(scale, 0.05)
    net.w["out"] *= np.float32(scale)
    net.w["out_bias"] = (scale * net.w["out_bias"] + shift).astype(np.float32)
    return net


def vectors_of(net: Network, lexicon: Lexicon, used: np.ndarray, absent: int, known: np.ndarray) -> np.ndarray:
    """Inputs of some words of the lexicon; of unknown ones only their characters."""
    out = np.zeros((len(used), INPUT), np.float32)
    real = used[used != absent]
    flat, counts = grams_of(lexicon, real)
    if len(real):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        means = np.add.reduceat(net.w["character"][flat], starts, axis=0) / counts[:, None]
        out[: len(real)] = net.w["word"][lexicon.bucket[real]] * known[: len(real), None] + means
    return out


def grams_of(lexicon: Lexicon, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = lexicon.gram_counts[words]
    starts = (np.cumsum(lexicon.gram_counts) - lexicon.gram_counts)[words]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return lexicon.grams[np.repeat(starts, counts) + within], counts


def _sums(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    distinct, starts = np.unique(rows[order], return_index=True)
    return distinct, np.add.reduceat(grads[order], starts, axis=0) if len(rows) else grads


def spread(lexicon: Lexicon, words: np.ndarray, grads: np.ndarray, known: np.ndarray) -> tuple[tuple, tuple]:
    """Gradients of words handed on to their buckets, if known, and to their n-grams."""
    word = _sums(lexicon.bucket[words[known]], grads[known])
    flat, counts = grams_of(lexicon, words)
    return word, _sums(flat, np.repeat(grads / counts[:, None], counts, axis=0))


def score_windows(net: Network, gates_f: np.ndarray, gates_b: np.ndarray, windows: np.ndarray, absent: int) -> np.ndarray:
    """Logits of windows of rows of the gate tables."""
    out = np.empty(len(windows), np.float32)
    for at in range(0, len(windows), SCORED_WINDOWS):
        ids = windows[at : at + SCORED_WINDOWS].T
        mask = None if ids[-1].max() != absent and ids.max() != absent else ids != absent
        out[at : at + SCORED_WINDOWS] = net.logits(gates_f[ids], gates_b[ids], mask)
    return out


class Scorer:
    """Scores texts with a network; remembers the gate inputs of words."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        # Row 0 stands for places without a word.
        self.number: dict[str, int] = {}
        self.gates = {s: np.zeros((1024, 3 * HIDDEN), np.float32) for s in ("f", "b")}

    def _learn(self, new: list[str]) -> None:
        features = [word_features(w) for w in new]
        counts = np.array([len(f[1]) for f in features])
        flat = np.fromiter(chain.from_iterable(f[1] for f in features), np.int64)
        w = self.net.w
        means = np.add.reduceat(w["character"][flat], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        vectors = (w["word"][[f[0] for f in features]] + means).astype(np.float32)
        first = len(self.number) + 1
        self.number |= {word: first + i for i, word in enumerate(new)}
        for s in ("f", "b"):
            table = self.gates[s]
            if first + len(new) > len(table):
                table = np.vstack([table, np.zeros((max(len(table), len(new)), 3 * HIDDEN), np.float32)])
            table[first : first + len(new)] = vectors @ w[f"in_{s}"] + w[f"bias_{s}"]
            self.gates[s] = table

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One score per text; texts without words get 0."""
        return np.round(_sigmoid(self.logits(texts)), 6)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows; minus infinity without words."""
        scores = np.full(len(texts), -np.inf)
        words, members, n_words = [], [], 0
        for i, text in enumerate(texts):
            found = text_words(text)
            if found:
                words.append(found)
                members.append(i)
                n_words += len(found)
            if words and (n_words > CUT_WORDS or i == len(texts) - 1):
                scores[members] = self._score_words(words)
                words, members, n_words = [], [], 0
        if words:
            scores[members] = self._score_words(words)
        return scores

    def _score_words(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.clear()
        new = set(chain.from_iterable(texts)).difference(self.number)
        if new:
            self._learn(sorted(new))
        lengths = np.array([len(t) for t in texts])
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, count=lengths.sum())
        firsts = np.cumsum(lengths) - lengths
        best = np.full(len(texts), -np.inf, np.float32)
        whole = lengths >= WINDOW
        starts = [window_starts(n) + f for n, f in zip(lengths[whole], firsts[whole], strict=True)]
        if starts:
            at = np.concatenate(starts)
            logits = np.empty(len(at), np.float32)
            steps = np.arange(WINDOW)
            for a in range(0, len(at), SCORED_WINDOWS):
                ids = flat[at[a : a + SCORED_WINDOWS] + steps[:, None]]
                logits[a : a + SCORED_WINDOWS] = self.net.logits(self.gates["f"].take(ids, axis=0), self.gates["b"].take(ids, axis=0), None)
            counts = np.array([len(s) for s in starts])
            best[whole] = np.maximum.reduceat(logits, np.cumsum(counts) - counts)
        short = np.flatnonzero(~whole)
        if len(short):
            ids = np.zeros((len(short), WINDOW), np.int64)
            for row, i in enumerate(short):
                ids[row, : lengths[i]] = flat[firsts[i] : firsts[i] + lengths[i]]
            best[short] = score_windows(self.net, self.gates["f"], self.gates["b"], ids, 0)
        return best.astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_characters: int = FIT_CHARACTERS) -> Network:
    """Fit on at most fit_rows rows of either label (`toxic`) that are not held out."""
    toxic = F.when(F.col("toxic").isin(0, 1), F.col("toxic"))
    sample, sizes = labelled_sample(docs, labels, toxic, fit_rows, fit_characters)
    return fit_calibrated([text for text, _ in sample], [grade for _, grade in sample], sizes)


def fit_calibrated(texts: list[str], labels: list[int], sizes: dict[int, int]) -> Network:
    """Fit on four fifths of the sample and calibrate on the rest; sizes: rows of each label behind the sample."""
    rest = np.arange(len(texts)) % 5 == 4
    part = lambda values, keep: [v for v, k in zip(values, keep, strict=True) if k]
    net = fit(part(texts, ~rest), part(labels, ~rest))
    taken = {label: max(1, labels.count(label)) for label in sizes}
    return calibrated(net, part(texts, rest), part(labels, rest), {k: sizes[k] / taken[k] for k in sizes})


def score_column(net: Network, text: Column) -> Column:
    """Scores of whole texts, 0 to 1; null and empty texts and those without a word get 0."""
    name = hashlib.sha256(b"".join(net.w[k].tobytes() for k in sorted(net.w))).hexdigest()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scorer = held(("toxicity", name), lambda: Scorer(net))  # keeps its words from task to task
        return pd.Series(scorer.score(list(texts)))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    The fit reads labels (doc_id, toxic) and texts only. Null doc_ids and repeated rows are scored like any
    other; extra columns are left out; an empty table of labels gives low scores, one of docs no rows.
    """
    net = train(docs, labels)
    scored = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), score_column(net, docs["text"].cast("string")).alias("score")
    )
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"),
    )
