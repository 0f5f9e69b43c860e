"""Two-state linear-chain conditional random field, vectorised over chains.

State 1 of position t scores ``x_t . w``, state 0 scores 0, and a 2x2 table
scores the moves.  With two states a message is one number, the log-ratio of
its two entries, so forward and backward passes are a loop over positions with
all chains side by side.  Chains are given by their lengths, end to end.
"""

from __future__ import annotations

import numpy as np

#: Positions of a chain that are handled one after the other; longer chains go in pieces.
PIECE = 64


def cut_chains(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths after cutting longer chains every ``most`` positions (all
    positions stay; only the link across a cut is lost)."""
    parts = -(-lengths // most)
    out = np.full(int(parts.sum()), most, np.int64)
    full = lengths > 0
    ends = np.cumsum(parts)[full] - 1
    out[ends] = lengths[full] - (parts[full] - 1) * most
    return out


def distinct_chains(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains that hold the same ``codes`` (a number a position) once: their
    positions end to end, their lengths and how often each occurs."""
    starts = np.cumsum(lengths) - lengths
    at, size, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(lengths[lengths > 0]):
        begin = starts[lengths == n]
        rows = codes[begin[:, None] + np.arange(n)]
        _, first, times = np.unique(np.ascontiguousarray(rows).view(f"V{n * codes.itemsize}").ravel(), return_index=True, return_counts=True)
        at.append((begin[first][:, None] + np.arange(n)).ravel())
        size.append(np.full(len(first), n))
        count.append(times)
    return np.concatenate(at), np.concatenate(size), np.concatenate(count)


def _steps(lengths: np.ndarray):
    """Positions at step 0, 1, ... of all chains that are that long."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    for t in range(int(ordered[0]) if len(ordered) else 0):
        yield starts[: int(np.searchsorted(-ordered, -t, "left"))] + t


def _ratios(u: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-ratios over whole chains.  Long chains go in
    pieces side by side: what a piece does to a message is a 2x2 table, the
    tables are followed from piece to piece, so no link is lost."""
    add = np.logaddexp
    r, s = u.copy(), np.zeros_like(u)
    if len(lengths) and lengths.max() > PIECE:
        n_pieces, lengths = -(-lengths // PIECE), cut_chains(lengths, PIECE)
        ends = np.cumsum(lengths)
        starts, first = ends - lengths, np.zeros(len(lengths), bool)
        first[(np.cumsum(n_pieces) - n_pieces)[n_pieces > 0]] = True
        # g[i, j]: from state i before the piece to state j at its end (a chain's first piece: from nothing)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        g = np.where(first, 0, move[:, :, None])
        g[:, 1] += u[starts]
        for k, at in enumerate(_steps(lengths)):
            if k:
                q = piece[at]
                z, o = g[:, 0, q], g[:, 1, q]
                g[:, 0, q], g[:, 1, q] = add(z + move[0, 0], o + move[1, 0]), u[at] + add(z + move[0, 1], o + move[1, 1])
        out, back = add(g[0, 1], g[1, 1]) - add(g[0, 0], g[1, 0]), np.zeros(len(lengths))  # right for first pieces
        steps = list(_steps(n_pieces))
        for q in steps[1:]:
            p = out[q - 1]
            out[q] = add(g[0, 1, q], p + g[1, 1, q]) - add(g[0, 0, q], p + g[1, 0, q])
        for q in steps[:0:-1]:
            back[q - 1] = add(g[1, 0, q], g[1, 1, q] + back[q]) - add(g[0, 0, q], g[0, 1, q] + back[q])
        p = out[np.flatnonzero(~first) - 1]
        r[starts[~first]] += add(move[0, 1], p + move[1, 1]) - add(move[0, 0], p + move[1, 0])
        s[ends - 1] = back
    steps = list(_steps(lengths))
    for at in steps[1:]:
        p = r[at - 1]
        r[at] += add(move[0, 1], p + move[1, 1]) - add(move[0, 0], p + move[1, 0])
    for at in steps[:0:-1]:
        n = u[at] + s[at]
        s[at - 1] = add(move[1, 0], n + move[1, 1]) - add(move[0, 0], n + move[0, 1])
    return r, s


def marginals(u: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(state 1) at every position."""
    if not len(u):
        return np.zeros(0)
    r, s = _ratios(u, lengths, move)
    return 1 / (1 + np.exp(-np.clip(r + s, -60, 60)))


def fit(
    x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 120, l2: float = 1e-3, rate: float = 0.1,
    row: np.ndarray | None = None, times: np.ndarray | None = None,
):
    """Weights and moves by gradient ascent (Adam) on the log-likelihood;
    expected counts come from the forward-backward pass.  Position t has the
    features ``x[row[t]]`` (``x[t]`` without ``row``); a chain counts ``times``."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    c = np.ones(len(y)) if times is None else np.repeat(times.astype(float), lengths)
    n = max(min(c @ y, c @ (1 - y)), 1)  # the rarer state sets the scale, else the penalty outweighs it
    link = np.ones(len(y), bool)
    link[np.cumsum(lengths) - 1] = False  # a chain's last position has no next
    a = np.flatnonzero(link)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[a], y[a + 1]), c[a])
    theta = np.zeros(len(w) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        u = x @ w if row is None else (x @ w)[row]
        r, s = _ratios(u, lengths, move)
        p = 1 / (1 + np.exp(-np.clip(r + s, -60, 60)))
        right = u[a + 1] + s[a + 1]
        logs = np.stack([np.full(len(a), move[0, 0]), move[0, 1] + right, r[a] + move[1, 0], r[a] + move[1, 1] + right])
        logs -= logs.max(axis=0) if len(a) else 0
        e = np.exp(logs)
        both = ((e / e.sum(axis=0)) @ c[a]).reshape(2, 2) if len(a) else np.zeros((2, 2))
        left = c * (y - p) if row is None else np.bincount(row, c * (y - p), minlength=len(x))
        g = np.concatenate([x.T @ left, (seen - both).ravel()]) / n - l2 * theta
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps; the first column of ``x`` is the constant 1."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * l2
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - l2 * w), -2, 2)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
