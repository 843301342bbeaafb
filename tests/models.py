"""Straightforward restatements of the rules, for small inputs."""

from __future__ import annotations

import math

import numpy as np


def km(a, b):
    la, lo, lb, ob = (math.radians(x) for x in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def close(a, b, limit):
    return a is None or b is None or km(a, b) <= limit


def leaders(rows, max_hamming, window_us, limit_km):
    """rows: (key, micros or None, (lat, lon) or None, hash). Returns key -> leader."""
    dated = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    undated = sorted((r for r in rows if r[1] is None), key=lambda r: r[0])
    order = dated + undated
    owner = {}
    for i, a in enumerate(order):
        if a[0] in owner:
            continue
        owner[a[0]] = a[0]
        for b in order[i + 1 :]:
            if b[0] in owner:
                continue
            both = a[1] is not None and b[1] is not None
            if both and b[1] - a[1] > window_us:
                break
            alike = bin((a[3] ^ b[3]) & (2**64 - 1)).count("1") < max_hamming
            if (alike or both) and close(a[2], b[2], limit_km):
                owner[b[0]] = a[0]
    return owner


def groups(owner):
    out = {}
    for k, lead in owner.items():
        out.setdefault(lead, set()).add(k)
    return {lead: m for lead, m in out.items() if len(m) > 1}


def events(rows, gap_us, limit_km):
    """rows: (key, micros, (lat, lon) or None) of one owner. Returns key -> event."""
    out, number, last, place = {}, 0, None, None
    for k, t, here in sorted(rows, key=lambda r: (r[1], r[0])):
        if last is not None:
            moved = place is not None and here is not None and km(place, here) > limit_km
            if t - last > gap_us or moved:
                number += 1
        out[k] = number
        last = t
        if here is not None:
            place = here
    return out


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def partition(labels, noise=()):
    """Set of frozensets of members, for comparison without label values."""
    out = {}
    for k, c in labels.items():
        if c in noise or c is None:
            continue
        out.setdefault(c, set()).add(k)
    return {frozenset(m) for m in out.values()}


def seed(m, k, cut):
    d = 1 - unit(m) @ unit(m).T
    n = len(m)
    edges = []
    for i in range(n):
        order = sorted(range(n), key=lambda j: (round(d[i, j], 12), j))[:k]
        edges += [(i, j) for j in order if j != i and d[i, j] < cut]
    return components(n, edges)


def average_linkage(m, cut):
    d = 1 - unit(m) @ unit(m).T
    parts = {i: [i] for i in range(len(m))}
    while len(parts) > 1:
        best = None
        ids = sorted(parts)
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                v = d[np.ix_(parts[a], parts[b])].mean()
                if best is None or v < best[0] - 1e-12:
                    best = (v, a, b)
        if best is None or best[0] > cut:
            break
        parts[best[1]] += parts.pop(best[2])
    return {i: c for c, members in parts.items() for i in members}


def dbscan(m, eps, min_samples):
    d = 1 - unit(m) @ unit(m).T
    n = len(m)
    near = [[j for j in range(n) if d[i, j] <= eps or i == j] for i in range(n)]
    core = [i for i in range(n) if len(near[i]) >= min_samples]
    inside = set(core)
    comp = components(n, [(i, j) for i in core for j in near[i] if j in inside])
    names = {c: k for k, c in enumerate(sorted({comp[i] for i in core}))}
    out = {}
    for i in range(n):
        if i in inside:
            out[i] = names[comp[i]]
        else:
            adj = [names[comp[j]] for j in near[i] if j in inside]
            out[i] = min(adj) if adj else -1
    return out


def density_hierarchy(m, epsilon, soft, min_size, min_samples=1, least=1e-9):
    """Cluster per row, -1 for noise: the whole distance matrix, merged from short to long."""
    n = len(m)
    d = np.round(np.maximum(1 - unit(m) @ unit(m).T, 0), 9)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    group = list(range(n))  # component of each row
    state = {i: {"rows": [i], "cluster": None} for i in range(n)}
    clusters = []  # parent, birth, rows, and sum over rows of the density where each leaves
    leaves = [None] * n
    heights = sorted({reach[i, j] for i in range(n) for j in range(i)})
    for h in heights:
        density = 1 / max(h, least)
        edges = [(group[i], group[j]) for i in range(n) for j in range(i) if reach[i, j] == h and group[i] != group[j]]
        ids = sorted({x for e in edges for x in e})
        comp = components(len(ids), [(ids.index(a), ids.index(b)) for a, b in edges])
        for c in set(comp):
            parts = [ids[k] for k in range(len(ids)) if comp[k] == c]
            rows = [r for p in parts for r in state[p]["rows"]]
            big = [state[p] for p in parts if state[p]["cluster"] is not None]
            small = [r for p in parts if state[p]["cluster"] is None for r in state[p]["rows"]]
            own = None
            if len(big) == 1:
                own = big[0]["cluster"]
            elif big or len(rows) >= min_size:
                own = len(clusters)
                clusters.append({"parent": None, "birth": None, "rows": None, "sum": 0.0})
                for b in big:
                    clusters[b["cluster"]].update(parent=own, birth=h, rows=b["rows"])
                    clusters[own]["sum"] += len(b["rows"]) * density
            if own is not None:
                for r in small:
                    leaves[r] = own
                clusters[own]["sum"] += len(small) * density
            for p in parts:
                del state[p]
            state[parts[0]] = {"rows": rows, "cluster": own}
            for r in rows:
                group[r] = parts[0]
    inner = [c for c in range(len(clusters)) if clusters[c]["parent"] is not None]
    chosen, value = set(), {}
    for c in inner:  # children come before their parents
        x = clusters[c]
        stable = x["sum"] - len(x["rows"]) / max(x["birth"], least)
        below = sum(value[k] for k in inner if clusters[k]["parent"] == c)
        value[c] = max(stable, below)
        if not below > stable:
            inside = [c]
            while inside:
                k = inside.pop()
                chosen.discard(k)
                inside += [q for q in inner if clusters[q]["parent"] == k]
            chosen.add(c)
    final = set()
    for c in chosen:
        if clusters[c]["birth"] < epsilon:
            while clusters[c]["birth"] <= epsilon and clusters[clusters[c]["parent"]]["parent"] is not None:
                c = clusters[c]["parent"]
        final.add(c)
    out = []
    for r in range(n):
        c = leaves[r]
        while c is not None and c not in final:
            c = clusters[c]["parent"]
        out.append(c)
    order = {c: k for k, c in enumerate(dict.fromkeys(c for c in out if c is not None))}
    out = [None if c is None else order[c] for c in out]
    if not order:
        return [-1] * n
    cents = unit(np.array([np.mean([m[r] for r in range(n) if out[r] == k], axis=0) for k in range(len(order))]))
    far = 1 - unit(m) @ cents.T
    return [c if c is not None else int(far[r].argmin()) if far[r].min() < soft else -1 for r, c in enumerate(out)]


def ward(m, k):
    """Cluster per row: the cheapest merge first, until k are left."""
    groups = [[i] for i in range(len(m))]
    while len(groups) > k:
        best = None
        for x in range(len(groups)):
            for y in range(x):
                a, b = m[groups[x]], m[groups[y]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = cost, x, y
        _, x, y = best
        groups[y] += groups.pop(x)
    return [next(g for g, members in enumerate(groups) if i in members) for i in range(len(m))]
