"""Refinement of anchor vectors in plain numpy: all anchors, moments and examples in one place."""

import math

import numpy as np


def one_pass(q, y, fold, anchors, labels, run, k, temp):
    """Gradient of the summed training loss and (n, right, loss) of training and held-out examples."""
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    size = np.linalg.norm(anchors, axis=1) + 1e-10
    a = anchors / size[:, None]
    grad, tally = np.zeros_like(anchors), [0.0] * 6
    for x, label, f in zip(q, y, fold):
        sims = a @ x
        top = sorted(range(len(a)), key=lambda i: (-round(sims[i], 9), -labels[i], i))[:k]
        w = np.exp((sims[top] - sims[top[0]]) / temp)
        w /= w.sum()
        raw = float(w @ labels[top])
        score = min(max(raw, 1e-7), 1 - 1e-7)
        loss = -math.log(score + 1e-10) if label else -math.log(1 - score + 1e-10)
        at = 0 if f != run else 3
        tally[at] += 1
        tally[at + 1] += (score > 0.5) == (label == 1)
        tally[at + 2] += loss
        if f == run or not 1e-7 < raw < 1 - 1e-7:
            continue
        slope = -1 / (score + 1e-10) if label else 1 / (1 - score + 1e-10)
        for weight, i in zip(w, top):
            grad[i] += slope * weight * (labels[i] - raw) / temp * (x - sims[i] * a[i]) / size[i]
    return grad, tally


def refine(anchors, labels, q, y, fold, epochs, folds, rate, reg, temp, k, minimum, patience, pull_back):
    """The refined anchors and the number of epochs; ``pull_back`` keeps them in their cones."""
    def train(run, n_epochs):
        now, m, v = anchors.copy(), np.zeros_like(anchors), np.zeros_like(anchors)
        history = []
        for e in range(n_epochs):
            step = rate * 0.1 + rate * 0.9 * (1 + math.cos(math.pi * e / n_epochs)) / 2
            grad, tally = one_pass(q, y, fold, now, labels, run, k, temp)
            grad = grad / max(1, tally[0]) + 2 * reg * (now - anchors)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
            move = step * (m / (1 - 0.9 ** (e + 1))) / (np.sqrt(v / (1 - 0.999 ** (e + 1))) + 1e-8)
            now = pull_back(now - move, anchors, minimum)
            _, tally = one_pass(q, y, fold, now, labels, run, k, temp)
            history.append(tally[4] / max(1, tally[3]))
            best = max(range(len(history)), key=lambda i: history[i])
            if run >= 0 and (history[best] == 0 and len(history) >= patience or len(history) - 1 - best >= patience):
                break
        return now, history

    histories = [train(f, epochs)[1] for f in range(folds)]
    shortest = min(map(len, histories))
    means = [sum(h[e] for h in histories) / folds for e in range(shortest)]
    chosen = max(range(shortest), key=lambda e: means[e]) + 1
    return train(-1, chosen)[0], chosen
