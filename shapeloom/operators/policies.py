"""Dictionary update policies on arrays, for the online loop; ranking.py has them on tables.

Each takes the old and the new dictionary as (labels, atoms) and returns one. In the closest, dissimilar, random and top-ranked
policies all new atoms stay and old ones are added.
"""

from __future__ import annotations

import numpy as np

#: Names; those of CODED need the codes of the batch over both dictionaries.
POLICIES = ("closest_set", "closest", "dissimilar", "random", "top_ranked", "labelwise", "coefficients", "replace", "extend")
CODED = ("top_ranked", "coefficients")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _pick(parts) -> tuple[list, np.ndarray]:
    """parts: (labels, atoms, places) in order."""
    return [labels[k] for labels, _, at in parts for k in at], np.concatenate([atoms[list(at)] for _, atoms, at in parts if len(at)])


def labelwise(old_labels, old, new_labels, new) -> list[tuple[int, int]]:
    """(side, place) in order: per label, pairs by ascending distance, each atom once, both atoms of a pair, until there are as many as
    the label's old atoms."""
    out = []
    for c in sorted(set(old_labels) & set(new_labels)):
        i, j = ([k for k, v in enumerate(x) if v == c] for x in (old_labels, new_labels))
        d = distances(old[i], new[j])
        got, used = [], (set(), set())
        for at in np.argsort(d, axis=None, kind="stable"):
            a, b = divmod(int(at), len(j))
            if len(got) >= len(i):
                break
            if a not in used[0] and b not in used[1]:
                used[0].add(a), used[1].add(b)
                got += [(0, i[a]), (1, j[b])]
        out += got
    return out


def coefficients(old_labels, new_labels, a_old, a_new, y) -> list[tuple[int, int]]:
    """(side, place) in order: for each label of the batch the atoms of both dictionaries with the largest sums of codes over its series,
    as many as the old dictionary has for each of these labels. Ties: the old dictionary's name sorts above, then the higher place."""
    labels = sorted(set(y))
    k, out = len(old_labels) // len(labels), []
    for c in labels:
        sums = []
        for side, name, own, a in ((0, "old_coeff", old_labels, a_old), (1, "new_coeff", new_labels, a_new)):
            at = [j for j, v in enumerate(own) if v == c]
            sums += [(float(a[y == c][:, j].sum()), name, i, side, j) for i, j in enumerate(at)]
        out += [(side, j) for *_, side, j in sorted(sums, reverse=True)[:k]]
    return out


def combine(policy: str, old: tuple, new: tuple, a_old, a_new, y, rng, n: int | None = None) -> tuple[list, np.ndarray]:
    (lo, so), (ln, sn) = old, new
    everything = (ln, sn, range(len(ln)))
    if policy == "replace":
        return new
    if policy == "extend":  # atoms of labels that the old dictionary lacks
        return _pick([(lo, so, range(len(lo))), (ln, sn, [k for k, c in enumerate(ln) if c not in set(lo)])])
    if policy in ("labelwise", "coefficients"):
        at = labelwise(lo, so, ln, sn) if policy == "labelwise" else coefficients(lo, ln, a_old, a_new, np.asarray(y))
        return _pick([((lo, so), (ln, sn))[side] + ([k],) for side, k in at]) if at else new
    d = distances(sn, so)
    if policy == "closest_set":
        return _pick([everything, (lo, so, list(dict.fromkeys(d.argmin(axis=1).tolist())))])
    if policy in ("closest", "dissimilar"):
        low = d.min(axis=0)
        return _pick([everything, (lo, so, np.argsort(low if policy == "closest" else -low, kind="stable")[: n or 12])])
    if policy == "random":
        return _pick([(lo, so, rng.choice(len(lo), min(n or 10, len(lo)), replace=False)), everything])
    if policy == "top_ranked":
        ranks = np.argsort(np.argsort(-np.abs(a_old), axis=1, kind="stable"), axis=1).mean(axis=0)
        return _pick([(lo, so, np.argsort(ranks, kind="stable")[: n or 10]), everything])
    raise ValueError(f"unknown policy {policy!r}: use one of {sorted(POLICIES)}")
