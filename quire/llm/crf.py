"""A linear-chain conditional random field over hashed features, in numpy.

Training maximises the likelihood by stochastic gradient steps on padded batches (forward-backward); decoding is
Viterbi over padded batches of similar length. Both are vectorised over the sentences of a batch.
"""

from __future__ import annotations

import numpy as np


class CRF:
    """``weights`` (features x tags), ``trans`` (tag to tag), ``start`` and ``end`` scores."""

    def __init__(self, n_features: int, tags: tuple[str, ...]):
        self.tags, t = tags, len(tags)
        self.n_features = n_features
        self.weights = np.zeros((n_features + 1, t), np.float32)  # the last row is padding and stays zero
        self.trans = np.zeros((t, t), np.float32)
        self.start, self.end = np.zeros(t, np.float32), np.zeros(t, np.float32)

    def _batches(self, lengths: np.ndarray, size: int):
        order = np.argsort(lengths, kind="stable")
        for a in range(0, len(order), size):
            yield order[a : a + size]

    def _pad(self, feats: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray):
        n, longest = len(which), int(lengths[which].max())
        at = starts[which][:, None] + np.arange(longest)[None, :]
        mask = np.arange(longest)[None, :] < lengths[which][:, None]
        at = np.where(mask, at, 0)
        f = feats[at]
        f[~mask] = self.n_features
        return f, mask, at, n, longest

    def fit(self, feats: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tags: np.ndarray, epochs: int = 8, rate: float = 0.25, size: int = 16, seed: int = 3, l2: float = 1e-5, averaged: int = 1) -> CRF:
        """``feats`` (tokens x slots) holds feature numbers; sentence i is ``feats[starts[i]:starts[i]+lengths[i]]``.

        The parameters are the mean of those after each of the last ``averaged`` epochs.
        """
        kept: list[tuple] = []
        rng = np.random.default_rng(seed)
        t = len(self.tags)
        eye = np.eye(t, dtype=np.float32)
        for e in range(epochs):
            batches = list(self._batches(lengths, size))
            rng.shuffle(batches)
            for k, which in enumerate(batches):
                step = rate / (1 + 2.0 * (e + k / len(batches)) / epochs * 3)
                f, mask, at, n, longest = self._pad(feats, starts, lengths, which)
                em = self.weights[f].sum(2)
                y = tags[at]
                # forward and backward in log space
                al = np.zeros((longest, n, t), np.float32)
                be = np.zeros((longest, n, t), np.float32)
                al[0] = em[:, 0] + self.start
                for i in range(1, longest):
                    x = al[i - 1][:, :, None] + self.trans[None]
                    m = x.max(1)
                    nxt = m + np.log(np.exp(x - m[:, None]).sum(1)) + em[:, i]
                    al[i] = np.where(mask[:, i, None], nxt, al[i - 1])
                be[longest - 1] = self.end
                for i in range(longest - 2, -1, -1):
                    x = self.trans[None] + (be[i + 1] + em[:, i + 1])[:, None, :]
                    m = x.max(2)
                    prv = m + np.log(np.exp(x - m[:, :, None]).sum(2))
                    be[i] = np.where(mask[:, i + 1, None], prv, self.end)
                last = al[-1] + self.end
                m = last.max(1, keepdims=True)
                z = m + np.log(np.exp(last - m).sum(1, keepdims=True))
                p = np.exp(al + be - z[None]).transpose(1, 0, 2)
                grad = (p - eye[y]) * mask[:, :, None]
                g_tr = np.zeros((t, t), np.float32)
                for i in range(1, longest):
                    live = mask[:, i]
                    if live.any():
                        x = al[i - 1][live][:, :, None] + self.trans[None] + (em[live, i] + be[i][live])[:, None, :] - z[live][:, :, None]
                        g_tr += np.exp(x).sum(0)
                        np.add.at(g_tr, (y[live, i - 1], y[live, i]), -1)
                rows = np.repeat(grad.reshape(-1, t), f.shape[2], axis=0)
                np.add.at(self.weights, f.reshape(-1), -step * rows)
                self.weights[-1] = 0
                self.trans -= step * g_tr / 4
                self.start -= step * grad[:, 0].sum(0) / 4
                ends = (lengths[which] - 1)[:, None]
                self.end -= step * np.take_along_axis(p - eye[y], ends[:, :, None], 1)[:, 0].sum(0) / 4
            self.weights *= 1 - l2 * len(batches)
            if averaged > 1 and e >= epochs - averaged:
                kept.append(tuple(x.copy() for x in (self.weights, self.trans, self.start, self.end)))
        if kept:
            self.weights, self.trans, self.start, self.end = (np.mean(x, axis=0, dtype=np.float32) for x in zip(*kept))
        return self

    def decode(self, feats: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int = 512) -> np.ndarray:
        """Viterbi tags of all tokens, in the order of ``feats``."""
        out = np.zeros(len(feats), np.int64)
        live = np.flatnonzero(lengths > 0)
        for part in self._batches(lengths[live], size):
            which = live[part]
            if int(lengths[which].max()) * len(which) > 60_000 and len(which) > 1:  # very long sentences go in smaller lots
                for one in np.array_split(which, min(len(which), 64)):
                    self._viterbi(feats, starts, lengths, one, out)
            else:
                self._viterbi(feats, starts, lengths, which, out)
        return out

    def _viterbi(self, feats, starts, lengths, which, out) -> None:
        if not len(which):
            return
        f, mask, at, n, longest = self._pad(feats, starts, lengths, which)
        em = self.weights[f[:, :, 0]].copy()
        for s in range(1, f.shape[2]):
            em += self.weights[f[:, :, s]]
        back = np.zeros((longest, n, len(self.tags)), np.int8)
        score = em[:, 0] + self.start
        for i in range(1, longest):
            x = score[:, :, None] + self.trans[None]
            back[i] = x.argmax(1)
            score = np.where(mask[:, i, None], x.max(1) + em[:, i], score)
        tag = (score + self.end).argmax(1)
        rows = np.arange(n)
        for i in range(longest - 1, -1, -1):
            here = mask[:, i]
            out[at[here, i]] = tag[here]
            tag = np.where(here & (i > 0), back[i, rows, tag], tag)
