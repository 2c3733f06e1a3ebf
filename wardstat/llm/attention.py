"""A small causal self-attention model in numpy, over a few hundred symbols.

One head over a window of ``WINDOW`` symbols and one hidden layer.  Training is
plain backpropagation with Adam on a given array of windows; scoring runs
batches of overlapping windows and takes each symbol's probability once, from
the window in which it stands after the context (or the first window).  Logits
begin at ``prior``: log probabilities by the symbol before, counted elsewhere.  A
symbol's probability is that of its class times its own in the class, so a place
takes the logits of the classes and those of one class, and not of all symbols.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
STRIDE = 16             # symbols that a window scores; the others are context
CONTEXT = WINDOW - STRIDE
WIDTH = 24
HIDDEN = 64
BATCH = 256             # windows trained on at once
CHUNK = 64              # windows whose gradients are added at once: they stay in the cache
SCORED = 128            # windows scored at once
GROUP = 16              # symbols of a class
STEPS = 600
RATE = 4e-3
SMOOTH = 16             # occurrences that the frequencies count for after each symbol
CAUSAL = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)


class Attention:
    def __init__(self, symbols: int, frequency: np.ndarray, seed: int = 7,
                 after: np.ndarray | None = None, begins: np.ndarray | None = None):
        """``after``: how often each symbol follows each (rows: the one before);
        ``begins``: the symbols that begin a word, or end the text (None: all)."""
        self.begins = np.ones(symbols, bool) if begins is None else np.asarray(begins, bool)
        # classes of GROUP symbols, of which all or none begin a word
        self.place, self.first = np.zeros(symbols, np.int64), []
        for kind in (True, False):
            own = np.flatnonzero(self.begins == kind)
            self.place[own] = len(self.first) * GROUP + np.arange(len(own))
            self.first += [kind] * -(-len(own) // GROUP)
        self.first = np.array(self.first, bool)
        many = len(self.first)
        self.empty = np.full(many * GROUP, -1e9, np.float32)
        self.empty[self.place] = 0
        r = np.random.default_rng(seed)
        normal = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        d = WIDTH
        share = (frequency + 1) / (frequency + 1).sum()
        start, own = self._levels(share)
        self.p = {
            "embed": normal(symbols, d, s=0.3), "place": normal(WINDOW, d, s=0.1),
            "qkv": normal(d, 3 * d, s=d ** -0.5), "mixed": normal(d, d, s=d ** -0.5),
            "up": normal(d, HIDDEN, s=d ** -0.5), "up0": np.zeros(HIDDEN, np.float32),
            "down": normal(HIDDEN, d, s=HIDDEN ** -0.5),
            "out": np.zeros((many * GROUP, d), np.float32), "out0": own,
            "class0": start}
        self.p["out"][self.place] = normal(symbols, d, s=0.1)
        self.p["class"] = normal(many, d, s=0.1)
        self.prior = None
        if after is not None:   # smoothed by the frequencies
            mixed = (after + SMOOTH * share) / (after.sum(axis=1, keepdims=True) + SMOOTH)
            start, own = self._levels(mixed)
            self.prior = start, own.reshape(symbols * many, GROUP)
            self.p["class0"], self.p["out0"] = np.zeros_like(start[0]), np.zeros_like(own[0])

    def _levels(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the probabilities of the classes, and of each symbol in its class."""
        many = len(self.first)
        by_place = np.zeros((*share.shape[:-1], many * GROUP))
        by_place[..., self.place] = share
        whole = by_place.reshape(*share.shape[:-1], many, GROUP).sum(axis=-1)
        own = np.zeros_like(by_place)
        own[..., self.place] = np.log(share / whole[..., self.place // GROUP])
        return np.log(whole).astype(np.float32), own.astype(np.float32)

    def packed(self) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in sorted(self.p))

    def unpack(self, weights: bytes) -> None:
        flat, at = np.frombuffer(weights, "<f4"), 0
        for k in sorted(self.p):
            self.p[k] = flat[at:at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size

    def _tables(self) -> tuple:
        """What the weights give for each symbol and for each place before they are added
        (embedding, scaled query, key and value); the logits of the classes by the symbol
        before, and of the symbols in a class by that and the class."""
        p, d, many = self.p, WIDTH, len(self.first)
        scaled = p["qkv"].copy()
        scaled[:, :d] *= d ** -0.5
        by_symbol, by_place = (np.concatenate([p[k], p[k] @ scaled], axis=1)
                               for k in ("embed", "place"))
        starts, own = p["class0"][None], (p["out0"] + self.empty).reshape(many, GROUP)
        if self.prior is not None:
            starts = starts + self.prior[0]
            own = (own + self.prior[1].reshape(-1, many, GROUP)).reshape(-1, GROUP)
        return by_symbol, by_place, starts, own

    def _in_class(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple:
        """Positions ordered by the class of the symbol ``y``, where each class ends, and
        there the logits of the class's symbols."""
        place = self.place.take(y)
        group = (place // GROUP).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        group, h = group.take(order), h.take(order, axis=0)
        ends = np.searchsorted(group, np.arange(len(self.first) + 1))
        out = self.p["out"]
        logits = np.empty((len(h), GROUP), h.dtype)
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if a < b:
                np.matmul(h[a:b], out[k * GROUP:(k + 1) * GROUP].T, out=logits[a:b])
        if self.prior is not None:
            logits += own.take(x.take(order) * len(self.first) + group, axis=0)
        else:
            logits += own.take(group, axis=0)
        return order, ends, h, logits, place.take(order) % GROUP

    # -- training ---------------------------------------------------------
    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss of symbols ``y`` after ``x`` (windows by places), gradients."""
        p, d, tables, loss = self.p, WIDTH, self._tables(), 0.0
        g = {k: np.zeros_like(v) for k, v in p.items()}
        back = np.empty((*x.shape, 4 * d), p["embed"].dtype)    # of the rows of the tables
        for k in range(0, len(x), CHUNK):
            own = slice(k, k + CHUNK)
            loss += self._add_gradients(x[own], y[own], x.size, tables, g, back[own])
        ones = np.ones(x.size, back.dtype)
        by_place = (ones[:len(x)] @ back.reshape(len(x), -1)).reshape(WINDOW, -1)
        order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
        before, back = x.take(order), back.reshape(x.size, -1).take(order, axis=0)
        first = np.flatnonzero(np.diff(before, prepend=-1))
        by_symbol = np.zeros((len(p["embed"]), 4 * d), back.dtype)
        for row, at, end in zip(before[first].tolist(), first.tolist(),
                                [*first[1:].tolist(), len(before)]):
            np.matmul(ones[at:end], back[at:end], out=by_symbol[row])
        # from the sums by symbol and by place to the weights that made the tables
        for name, table in (("embed", by_symbol), ("place", by_place)):
            table[:, d:2 * d] *= d ** -0.5
            g[name] += table[:, :d] + table[:, d:] @ p["qkv"].T
            g["qkv"] += p[name].T @ table[:, d:]
        return loss, g

    def _add_gradients(self, x: np.ndarray, y: np.ndarray, n: int, tables: tuple, g: dict,
                       back: np.ndarray) -> float:
        """The part of some windows in the loss of ``n`` symbols; adds theirs to ``g``, and
        sets ``back`` to those of the sums of the tables' rows."""
        p, d = self.p, WIDTH
        of_symbol, of_place, starts, own0 = tables
        whole = of_symbol.take(x, axis=0)
        whole += of_place
        e, q, k, v = (whole[:, :, i * d:(i + 1) * d] for i in range(4))
        ones = np.ones(x.size, whole.dtype)
        a = k @ q.transpose(0, 2, 1)        # keys by queries
        a += CAUSAL.T
        a -= a.max(axis=1, keepdims=True)
        np.exp(a, out=a)
        a /= (ones[:WINDOW] @ a)[:, None]
        o = (a.transpose(0, 2, 1) @ v).reshape(x.size, d)
        h1 = o @ p["mixed"]
        h1.reshape(e.shape)[...] += e
        z = h1 @ p["up"]
        z += p["up0"]
        np.maximum(z, 0, out=z)
        h2 = z @ p["down"]
        h2 += h1
        before, flat, rows = x.reshape(-1), y.reshape(-1), np.arange(x.size)
        prob = h2 @ p["class"].T
        prob += starts.take(before, axis=0) if self.prior is not None else starts
        prob -= prob.max(axis=1, keepdims=True)
        np.exp(prob, out=prob)
        prob /= (prob @ ones[:prob.shape[1]])[:, None]
        order, ends, sorted_h, own, nth = self._in_class(h2, before, flat, own0)
        own -= own.max(axis=1, keepdims=True)
        np.exp(own, out=own)
        own /= (own @ ones[:GROUP])[:, None]
        at_class = rows * prob.shape[1] + self.place.take(flat) // GROUP
        at_own = rows * GROUP + nth
        loss = -(np.log(prob.take(at_class) + 1e-30) + np.log(own.take(at_own) + 1e-30)).sum() / n
        prob.reshape(-1)[at_class] -= 1
        prob /= n
        own.reshape(-1)[at_own] -= 1
        own /= n
        g["class"] += prob.T @ h2
        g["class0"] += ones @ prob
        dh2 = np.empty_like(sorted_h)
        for i, (at, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if at < end:
                mine = slice(i * GROUP, (i + 1) * GROUP)
                np.matmul(own[at:end], p["out"][mine], out=dh2[at:end])
                g["out"][mine] += own[at:end].T @ sorted_h[at:end]
                g["out0"][mine] += ones[at:end] @ own[at:end]
        place = np.empty_like(order)
        place[order] = rows
        dh = prob @ p["class"]
        dh += dh2.take(place, axis=0)
        g["down"] += z.T @ dh
        dz = dh @ p["down"].T
        dz *= z > 0
        g["up"] += h1.T @ dz
        g["up0"] += ones @ dz
        dh += dz @ p["up"].T
        g["mixed"] += o.T @ dh
        do = (dh @ p["mixed"].T).reshape(e.shape)
        ds = v @ do.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ik", ds, a)[:, None]
        ds *= a
        back[:, :, :d] = dh.reshape(e.shape)
        for i, (left, right) in enumerate(((ds.transpose(0, 2, 1), k), (ds, q), (a, do)), 1):
            np.matmul(left, right, out=back[:, :, i * d:(i + 1) * d])
        return float(loss)

    def train(self, windows: np.ndarray, steps: int = STEPS, seed: int = 7) -> float:
        """Adam on ``windows`` of WINDOW + 1 symbols; the mean loss at the end."""
        r, last, adam = np.random.default_rng(seed), [], Adam(self)
        for step in range(1, steps + 1 if len(windows) else 1):
            w = windows[r.integers(0, len(windows), BATCH)]
            last = [*last[-49:], adam.step(w, (1 - step / (steps + 1)) ** 0.7)]
        return float(np.mean(last)) if last else 0.0

    # -- scoring ----------------------------------------------------------
    def _windows(self, x: np.ndarray, y: np.ndarray, first: int, tables: tuple = ()) -> tuple:
        """Log probabilities of y[:, first:] after windows x, and of any symbol there that
        begins a word."""
        p, d = self.p, WIDTH
        of_symbol, of_place, starts, own0 = tables or self._tables()
        whole = of_symbol.take(x, axis=0)
        whole += of_place
        e, q = whole[:, first:, :d], whole[:, first:, d:2 * d]
        k, v = whole[:, :, 2 * d:3 * d], whole[:, :, 3 * d:]
        # trained weights keep scores and logits far from the range of a float
        a = k @ q.transpose(0, 2, 1)        # keys by queries
        a += CAUSAL[first:].T
        np.exp(a, out=a)
        o = a.transpose(0, 2, 1) @ v
        o /= (np.ones(WINDOW, a.dtype) @ a)[:, :, None]
        h = o.reshape(-1, d) @ p["mixed"]
        h += e.reshape(-1, d)
        z = h @ p["up"]
        z += p["up0"]
        h += np.maximum(z, 0, out=z) @ p["down"]
        target, before = y[:, first:].reshape(-1), x[:, first:].reshape(-1)
        rows, many = np.arange(len(target)), len(self.first)
        logits = h @ p["class"].T
        logits += starts.take(before, axis=0) if self.prior is not None else starts
        chosen = logits.take(rows * many + self.place.take(target) // GROUP)
        sums = np.exp(logits, out=logits) @ np.stack(
            [np.ones(many), self.first], axis=1).astype(logits.dtype)
        log_total, begun = np.log(sums).T
        order, _, _, logits, nth = self._in_class(h, before, target, own0)
        own = logits.take(rows * GROUP + nth)
        own -= np.log(np.exp(logits, out=logits) @ np.ones(GROUP, logits.dtype))
        chosen -= log_total
        chosen[order] += own
        return chosen.reshape(len(x), -1), (begun - log_total).reshape(len(x), -1)

    def score(self, y: np.ndarray, size: np.ndarray, start: int) -> tuple:
        """Natural log probability of every symbol of ``y``, which holds documents of
        ``size`` symbols one after the other, each after the symbol ``start``, and that
        of a word's beginning at its place.  Every symbol is scored once."""
        ends = np.cumsum(size)
        out, border = np.zeros(len(y)), np.zeros(len(y))
        if not len(y):
            return out, border
        y = y.astype(np.int64)
        x = np.concatenate([[start], y[:-1]])
        full = size > 0
        x[(ends - size)[full]] = start
        # one window per document, and one more for each started stride beyond
        parts = np.where(full, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = (ends - size)[owner] + nth * STRIDE
        left = ends[owner] - at
        span, tables = np.arange(WINDOW), self._tables()
        for own, first in ((nth == 0, 0), (nth > 0, CONTEXT)):
            rows = np.flatnonzero(own)
            for k in range(0, len(rows), SCORED):
                r = rows[k:k + SCORED]
                inside = span < left[r][:, None]
                place = np.where(inside, at[r][:, None] + span, 0)
                got, begun = self._windows(x.take(place), y.take(place), first, tables)
                valid = inside[:, first:]
                out[place[:, first:][valid]] = got[valid]
                border[place[:, first:][valid]] = begun[valid]
        return out, border


class Adam:
    """Steps on batches of windows, from the weights that the model has."""

    def __init__(self, net: Attention):
        self.net, self.done = net, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, w: np.ndarray, share: float = 1.0) -> float:
        """One step, at ``share`` of the full rate; the loss before it."""
        self.done += 1
        loss, g = self.net.gradients(w[:, :-1], w[:, 1:])
        rate = RATE * min(1, self.done / 20) * share
        for k, v in g.items():
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.01 * (v * v - self.s[k])
            self.net.p[k] -= (rate * (self.m[k] / (1 - 0.9 ** self.done))
                              / (np.sqrt(self.s[k] / (1 - 0.99 ** self.done)) + 1e-8)
                              ).astype(np.float32)
        return loss
