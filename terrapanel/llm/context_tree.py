"""Context-tree weighting over bytes, in numpy.

A byte is eight binary decisions; the decision after the first k bits is numbered 2**k plus these bits (1 to 255). Each
decision has a tree of contexts: the last 0 to DEPTH bytes. A node holds the decision's counts a (zeros) and b
(ones), with the Krichevsky-Trofimov estimate (b + 1/2) / (a + b + 1) and its sequence probability Pe. Weighting gives
Pw = Pe at DEPTH and Pw = (Pe + product of the children's Pw) / 2 above; Pe / (2 Pw) is the weight with which
a node answers by itself instead of passing on to the child. A context that was never seen at a decision has no
estimate; the deepest seen one then answers for good.

Texts are preceded by DEPTH bytes 0xFF and closed by one, which UTF-8 doesn't use. A gram is a context with
the next byte, the oldest byte highest; a node's key is its context and then the decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DEPTH = 5
NEAR = 2  # trees are cut below the contexts of this length: each such context's subtree is built alone
CHUNK = 1_000_000
END = 0xFF


def segments(text: bytes) -> Iterator[np.ndarray]:
    """The text with its leading and closing bytes, in overlapping parts of up to CHUNK grams."""
    whole = np.frombuffer(b"\xff" * DEPTH + text + b"\xff", np.uint8)
    for start in range(0, len(whole) - DEPTH, CHUNK):
        yield whole[start : start + CHUNK + DEPTH]


def grams(parts: list[np.ndarray]) -> np.ndarray:
    """Grams of the parts, one after the other: len(part) - DEPTH of each."""
    joined = np.concatenate(parts).astype(np.uint64)
    codes = np.zeros(len(joined) - DEPTH, np.uint64)
    for place in range(DEPTH + 1):
        codes = (codes << np.uint64(8)) | joined[place : len(joined) - DEPTH + place]
    inside = np.ones(len(joined), bool)
    ends = np.cumsum([len(p) for p in parts])
    for back in range(1, DEPTH + 1):
        inside[ends - back] = False
    return codes[inside[: len(codes)]]


def near_of(codes: np.ndarray) -> np.ndarray:
    """The gram's last NEAR context bytes."""
    return (codes >> np.uint64(8)) & np.uint64(256**NEAR - 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: shifted up by eight, then Stirling's series."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, place = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(place, weights=v, minlength=len(found)) for v in values)


def decisions(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b) of the nodes at a depth, from grams and their counts."""
    codes, counts = _summed(codes & np.uint64(256 ** (depth + 1) - 1), counts)
    byte, context = codes & np.uint64(255), codes & ~np.uint64(255)
    keys, ones = [], []
    for k in range(8):
        keys.append(context | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
        ones.append(((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.float64))
    ones, counts = np.concatenate(ones), np.tile(counts, 8)
    return _summed(np.concatenate(keys), counts * (1 - ones), counts * ones)


def parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys without the oldest byte of the context, for nodes at a depth."""
    return keys & np.uint64(256**depth - 1)


@dataclass
class Level:
    """Nodes at one depth, by ascending key: the estimate of a one, and the weight of the node's own answer."""

    keys: np.ndarray
    estimate: np.ndarray
    weight: np.ndarray


def _weighted(a: np.ndarray, b: np.ndarray, log_children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, weight, log Pw)"""
    log_own = _log_estimate(a, b)
    estimate = (b + 0.5) / (a + b + 1.0)
    if log_children is None:
        return estimate, np.ones_like(estimate), log_own
    log_total = np.logaddexp(log_own, log_children) - np.log(2)
    return estimate, np.exp(log_own - np.log(2) - log_total), log_total


def subtree(codes: np.ndarray, counts: np.ndarray) -> tuple[list[Level], tuple[np.ndarray, ...]]:
    """Levels NEAR to DEPTH from all grams of some NEAR contexts, and (key, a, b, log Pw) of the first one."""
    levels, below, top = [], None, ()
    for depth in range(DEPTH, NEAR - 1, -1):
        keys, a, b = decisions(codes, counts, depth)
        children = None
        if below is not None:
            place = np.searchsorted(keys, parent(below[0], depth + 1))
            children = np.bincount(place, weights=below[1], minlength=len(keys))
        estimate, weight, log_total = _weighted(a, b, children)
        levels.append(Level(keys, estimate, weight))
        below, top = (keys, log_total), (keys, a, b, log_total)
    return levels[::-1], top


def trunk(keys: np.ndarray, a: np.ndarray, b: np.ndarray, log_children: np.ndarray) -> list[Level]:
    """Levels 0 to NEAR - 1, from sums over the children of each node at NEAR - 1."""
    order = np.argsort(keys)
    keys, a, b, log_children = keys[order], a[order], b[order], log_children[order]
    levels = []
    for depth in range(NEAR - 1, -1, -1):
        estimate, weight, log_total = _weighted(a, b, log_children)
        levels.append(Level(keys, estimate, weight))
        if depth:
            keys, a, b, log_children = _summed(parent(keys, depth), a, b, log_total)
    return levels[::-1]


@dataclass
class Path:
    """For the nodes at one depth, by key: the mixture of all nodes above and at it, and the weight left for below."""

    keys: np.ndarray
    said: np.ndarray
    left: np.ndarray


def answers(levels: list[Level], first: int = 0, above: Path | None = None) -> tuple[list[np.ndarray], Path | None]:
    """Log odds of a one by depth, from depth `first` on, each as if its node were the deepest seen: the mixture along its
    path. Single precision keeps six digits of a probability, however near to 0 or 1."""
    found = []
    for depth, level in enumerate(levels, first):
        if depth:
            place = np.searchsorted(above.keys, parent(level.keys, depth))
            said, left = above.said[place], above.left[place]
        else:
            said, left = np.zeros(len(level.keys)), np.ones(len(level.keys))
        one = said + left * level.estimate
        # the rest is summed on its own, as 1 - one would lose a small one
        zero = (1 - left - said) + left * (1 - level.estimate)
        found.append((np.log(one) - np.log(np.maximum(zero, 1e-300))).astype(np.float32))
        above = Path(level.keys, said + left * level.weight * level.estimate, left * (1 - level.weight))
    return found, above


def odds_of(codes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """For each of the eight decisions of the grams' last byte, the log odds of a one at the deepest seen node, from (keys, log odds)
    by depth; nan if none was seen. Quick for ascending grams."""
    byte = codes & np.uint64(255)
    for k in range(8):
        decision = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        odds = np.full(len(codes), np.nan)
        waiting = np.arange(len(codes))
        for depth in range(len(found) - 1, -1, -1):
            keys, values = found[depth]
            if not len(keys) or not len(waiting):
                continue
            wanted = (codes[waiting] & np.uint64(256 ** (depth + 1) - 1) & ~np.uint64(255)) | decision[waiting]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            seen = keys[place] == wanted
            odds[waiting[seen]] = values[place[seen]]
            waiting = waiting[~seen]
        yield odds


def _log_said(codes: np.ndarray, k: int, odds: np.ndarray) -> np.ndarray:
    """log of what the k-th decision got, from the log odds of a one."""
    bit = (codes >> np.uint64(7 - k)) & np.uint64(1)
    return -np.logaddexp(0, np.where(bit == 1, -odds, odds))


def log10_of(codes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of each gram's last byte given its context, from (keys, log odds) by depth."""
    total = np.zeros(len(codes))
    for k, odds in enumerate(odds_of(codes, found)):
        total += _log_said(codes, k, np.nan_to_num(odds))
    return total / np.log(10)


def log10_below(codes: np.ndarray, below: list[np.ndarray], above: Path, trunk: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of each gram's last byte, from the log odds that its subtree alone gives to the eight decisions (nan: not seen there).

    What a subtree says is mixed with what the nodes above it say, in the shares that are left at NEAR - 1: `answers` from nothing
    said and all left is a part of `answers` from any path."""
    byte, total = codes & np.uint64(255), np.zeros(len(codes))
    for k, odds in enumerate(odds_of(codes, trunk)):
        said = _log_said(codes, k, np.nan_to_num(odds))
        seen = np.flatnonzero(~np.isnan(below[k]))
        own, odds = codes[seen], below[k][seen].astype(np.float64)
        decision = np.uint64(1 << k) | (byte[seen] >> np.uint64(8 - k))
        place = np.searchsorted(above.keys, parent((own & ~np.uint64(255)) | decision, NEAR))
        first, left = above.said[place], above.left[place]
        bit = (own >> np.uint64(7 - k)) & np.uint64(1)
        one = first + left * np.exp(-np.logaddexp(0, -odds))
        zero = (1 - left - first) + left * np.exp(-np.logaddexp(0, odds))
        said[seen] = np.log(np.maximum(np.where(bit == 1, one, zero), 1e-300))
        total += said
    return total / np.log(10)
