"""Plain-Python greedy peeling, one value at a time, for small relations.

each pass picks a dimension, removes its values of mass <= theta * average
in ascending mass order, scores the density after every single removal,
and the block is what was left at the best score (strict improvement).
"""

from __future__ import annotations

import math


def _prod(cards):
    p = 1.0
    for c in cards:
        p *= float(c)
    return p


def density(measure, mass, cards, n, mass_all, prod_all):
    if callable(measure):
        return measure(mass, _prod(cards), sum(cards))
    if measure == "ari":
        s = sum(cards)
        return -1.0 if s == 0 else float(mass) / s * n
    p = _prod(cards)
    if measure == "geo":
        return -1.0 if p == 0 else float(mass) / math.pow(p, 1.0 / n)
    if p == 0 or mass == 0:
        return -1.0
    m, m0 = float(mass), float(mass_all)
    return m * (math.log(m / m0) - 1) + m0 * p / prod_all - m * math.log(p / prod_all)


def if_removed(measure, mass, cards, mode, k, s, n, mass_all, prod_all):
    if callable(measure):
        return measure(mass - s, _prod(cards) / cards[mode] * (cards[mode] - k), sum(cards) - k)
    if measure == "ari":
        tot = sum(cards) - k
        return -1.0 if tot == 0 else float(mass - s) / tot * n
    p = _prod(cards) / cards[mode] * (cards[mode] - k)
    m = mass - s
    if measure == "geo":
        return -1.0 if p == 0 else float(m) / math.pow(p, 1.0 / n)
    if p == 0 or m == 0:
        return -1.0
    return float(m) * (math.log(float(m) / mass_all) - 1) + float(mass_all) * p / prod_all - float(m) * math.log(p / prod_all)


def find_block(tuples, n, cards, measure, policy, theta):
    """Returns (members per mode as sets, search density, search mass, passes)."""
    M = sum(t[n] for t in tuples)
    mass_all, prod_all = M, _prod(cards)
    masses = [[0] * cards[m] for m in range(n)]
    for t in tuples:
        for m in range(n):
            masses[m][t[m]] += t[n]
    alive = [set(range(cards[m])) for m in range(n)]
    cur = list(cards)
    B = list(tuples)
    best = density(measure, M, cur, n, mass_all, prod_all)
    best_i, i, passes = 0, 0, 0
    log = []
    while any(alive):
        chosen, top = 0, None
        for m in range(n):
            if not alive[m]:
                continue
            if policy == "cardinality":
                score = float(len(alive[m]))
            else:
                thr = M * theta / len(alive[m])
                cand = [masses[m][x] for x in alive[m] if masses[m][x] <= thr]
                if not cand:
                    continue
                score = if_removed(measure, M, cur, m, len(cand), sum(cand), n, mass_all, prod_all)
            if top is None or score >= top:
                chosen, top = m, score
        thr = M * theta / len(alive[chosen])
        removed = set()
        for x in sorted(alive[chosen], key=lambda x: (masses[chosen][x], x)):
            if masses[chosen][x] > thr:
                break
            M -= masses[chosen][x]
            cur[chosen] -= 1
            i += 1
            d = density(measure, M, cur, n, mass_all, prod_all)
            if d > best:
                best, best_i = d, i
            log.append((chosen, x, M))
            removed.add(x)
        alive[chosen] -= removed
        B = [t for t in B if t[chosen] not in removed]
        for m in range(n):
            masses[m] = [0] * cards[m]
        for t in B:
            for m in range(n):
                masses[m][t[m]] += t[n]
        passes += 1
    members = [set() for _ in range(n)]
    for m, x, _ in log[best_i:]:
        members[m].add(x)
    search_mass = log[best_i - 1][2] if best_i > 0 else sum(t[n] for t in tuples)
    return members, best, search_mass, passes


def find_blocks(tuples, n, k, measure, policy, theta):
    """k blocks with deflation; report on the original relation."""
    cards = [max((t[m] for t in tuples), default=-1) + 1 for m in range(n)]
    mass_all = sum(t[n] for t in tuples)
    R = list(tuples)
    out = []
    for _ in range(k):
        members, sd, smass, passes = find_block(R, n, cards, measure, policy, theta)
        inside = [t for t in tuples if all(t[m] in members[m] for m in range(n))]
        mass = sum(t[n] for t in inside)
        bc = [len(s) for s in members]
        d = density(measure, mass, bc, n, mass_all, _prod(cards))
        out.append(dict(members=members, cards=bc, mass=mass, tuples=len(inside), density=d,
                        search_density=sd, search_mass=smass, passes=passes))
        R = [t for t in R if not all(t[m] in members[m] for m in range(n))]
    return out
