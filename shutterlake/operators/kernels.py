"""Numpy work done inside tasks on one bounded block of rows at a time.

Nothing here touches Spark: Spark partitions, ships and merges the blocks. The
module is pickled by value, so executors need not have the package installed.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa

EARTH_KM = 6371.0
CHUNK = 2_000_000  # similarity cells held at once


# ---- vectors in and out of Arrow -------------------------------------------------


def matrix(column, normalize: bool) -> np.ndarray:
    """Rows of a list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # zero chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(n, -1)
    if normalize:
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = m / np.where(size > 0, size, 1.0)
    return m


def columns(table) -> dict[str, np.ndarray]:
    return {
        c: table[c].to_numpy()
        if isinstance(table[c], pa.ChunkedArray)
        else table[c].to_numpy(zero_copy_only=False)
        for c in table.schema.names
        if c != "vec"
    }


def to_table(data: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(data[f.name], type=f.type) for f in schema}, schema=schema)


# ---- what a block of similarities is reduced to ----------------------------------


def distances(lm: np.ndarray, rm: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        sq = (lm * lm).sum(1)[:, None] + (rm * rm).sum(1)[None, :] - 2 * (lm @ rm.T)
        return np.sqrt(np.maximum(sq, 0.0))
    return 1.0 - lm @ rm.T


def within(d: np.ndarray, cut: float | None, closed: bool) -> np.ndarray:
    if cut is None:
        return np.ones(d.shape, dtype=bool)
    return d <= cut if closed else d < cut


def ward_costs(left, lm, right, rm) -> np.ndarray:
    """What joining two clusters of these means and sizes adds to the squares inside clusters."""
    n, m = left["size"][:, None].astype(float), right["size"][None, :].astype(float)
    return distances(lm, rm, "euclidean") ** 2 * (n * m / (n + m))


def nearest_k(left, lm, right, rm, opt) -> dict:
    """At most k right rows per left row, by (distance, right id)."""
    d = ward_costs(left, lm, right, rm) if opt["metric"] == "ward" else distances(lm, rm, opt["metric"])
    hit = within(d, opt["cut"], opt["closed"])
    if opt["skip_self"]:
        hit &= left["id"][:, None] != right["id"][None, :]
    k = opt["k"]
    if k < d.shape[1]:
        kth = np.partition(np.where(hit, d, np.inf), k - 1, axis=1)[:, k - 1 : k]
        hit &= d <= kth
    rows, cols = np.nonzero(hit)
    dist, rid = d[rows, cols], right["id"][cols]
    order = np.lexsort((rid, dist, rows))
    rows, dist, cols, rid = rows[order], dist[order], cols[order], rid[order]
    if len(rows):
        first = np.r_[True, rows[1:] != rows[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        keep = np.arange(len(rows)) - start < k
        rows, dist, cols, rid = rows[keep], dist[keep], cols[keep], rid[keep]
    out = {"id": left["id"][rows], "nid": rid, "distance": dist}
    for name in opt["carry"]:
        out[name] = right[name][cols]
    return out


def star_edges(left, lm, right, rm, opt) -> dict:
    """Links every row to the smallest id of its local component.

    A block never emits more links than it has rows, however many pairs match.
    """
    hit = within(distances(lm, rm, opt["metric"]), opt["cut"], opt["closed"])
    if opt["cap"] is not None:
        hit &= left["size"][:, None] + right["size"][None, :] <= opt["cap"]
    if opt["both"] is not None:
        hit &= left[opt["both"]][:, None] & right[opt["both"]][None, :]
    rows, cols = np.nonzero(hit)
    return tied(left["id"][rows], right["id"][cols])


def tied(src: np.ndarray, dst: np.ndarray) -> dict:
    """The links as one from the smallest id of each component to every other member."""
    ids, where = np.unique(np.r_[src, dst], return_inverse=True)
    label = tie(len(ids), where[: len(src)], where[len(src) :])
    moved = label != np.arange(len(ids))
    return {"src": ids[label[moved]], "dst": ids[moved]}


def run_blocks(kernel, links: bool, blocks, left: dict, lm, right: dict, rm, opt) -> dict:
    """One result of the kernel over several blocks, each given by its rows of both sides.

    Links (src, dst) of components are tied again whenever enough of them wait, so
    a task holds and returns no more of them than it has rows.
    """
    done, waiting = [], 0
    for i, j in blocks:
        part = kernel({c: v[i] for c, v in left.items()}, lm[i], {c: v[j] for c, v in right.items()}, rm[j], opt)
        done.append(part)
        waiting += len(part["src"]) if links else 0
        if waiting > CHUNK:
            done, waiting = [_joined(done, True)], 0
    return _joined(done, links) if done else {}


def _joined(parts: list[dict], links: bool) -> dict:
    out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    return tied(out["src"], out["dst"]) if links and len(parts) > 1 else out


def neighbour_counts(left, lm, right, rm, opt) -> dict:
    """How many right rows lie within the cut of each left row."""
    n = within(distances(lm, rm, opt["metric"]), opt["cut"], opt["closed"]).sum(axis=1)
    return {"id": left["id"], "n": n.astype(np.int64)}


def lowest_label(left, lm, right, rm, opt) -> dict:
    """Smallest label among the right rows within the cut."""
    hit = within(distances(lm, rm, opt["metric"]), opt["cut"], opt["closed"])
    big = np.iinfo(np.int64).max
    low = np.where(hit, right["label"][None, :], big).min(axis=1)
    ok = low != big
    return {"id": left["id"][ok], "label": low[ok]}


def identity_extremes(left, lm, right, rm, opt) -> dict:
    """Per left row: least cosine to its own identity, greatest to any other."""
    s = lm @ rm.T
    same = left["label"][:, None] == right["label"][None, :]
    own = same & (left["id"][:, None] != right["id"][None, :])
    return {
        "label": left["label"],
        "intra_min": np.where(own, s, np.inf).min(axis=1),
        "inter_max": np.where(~same, s, -np.inf).max(axis=1),
    }


def all_hits(left, lm, right, rm, opt) -> dict:
    """Every matching pair, for operators whose result is the pair list itself."""
    d = distances(lm, rm, opt["metric"])
    hit = within(d, opt["cut"], opt["closed"])
    hit &= left["id"][:, None] < right["id"][None, :]
    if opt["cap"] is not None:
        hit &= left["size"][:, None] + right["size"][None, :] <= opt["cap"]
    rows, cols = np.nonzero(hit)
    return {"src": left["id"][rows], "dst": right["id"][cols], "distance": d[rows, cols]}


def nearest_other(left, lm, right, rm, opt) -> dict:
    """Per left row the right row of another label that it reaches first, by (reach, right id).

    Reach is the distance, or the core distance of either end if that is larger.
    It is rounded, so that both ends see one value and ties are ties everywhere.
    """
    d = np.maximum(distances(lm, rm, opt["metric"]), 0.0)
    d = np.round(np.maximum(d, np.maximum(left["core"][:, None], right["core"][None, :])), DECIMALS)
    d[left["label"][:, None] == right["label"][None, :]] = np.inf
    best = d.min(axis=1)
    ok = best < np.inf if opt["cut"] is None else best <= opt["cut"]
    rid = np.where(d[ok] == best[ok][:, None], right["id"][None, :], np.iinfo(np.int64).max)
    at = rid.argmin(axis=1)
    return {
        "id": left["id"][ok],
        "label": left["label"][ok],
        "nid": right["id"][at],
        "nlabel": right["label"][at],
        "w": best[ok],
    }


def agglomerate(costs: np.ndarray, sizes: np.ndarray, bound: np.ndarray, linkage: str, cut: float) -> list[tuple]:
    """(source, target, cost) of all merges of a block that hold whatever lies outside it.

    `bound` is a cost that no cluster outside the block undercuts. Two clusters
    merge when each is the other's cheapest partner and neither bound is lower.
    A merged cluster keeps the lower bound of its parts, as merging never brings
    two clusters nearer to a third one than the nearer of them was. Rows merge
    into the one that comes first.
    """
    c, n, bound = costs.copy(), sizes.astype(float), bound.copy()
    np.fill_diagonal(c, np.inf)
    m = len(n)
    live = np.ones(m, bool)
    best = c.argmin(axis=1) if m else np.zeros(0, np.int64)
    out = []
    while True:
        i = np.flatnonzero(live)
        j = best[i]
        cost = c[i, j]
        room = np.minimum(bound[i], bound[j])
        ok = (i < j) & (best[j] == i) & (cost <= cut) & (cost <= room + 1e-9 * (1 + np.abs(cost)))
        if not ok.any():
            return out
        touched = np.zeros(m, bool)
        for a, b in zip(i[ok], j[ok]):
            na, nb, own = n[a], n[b], c[a, b]
            out.append((int(b), int(a), float(own)))
            if linkage == "ward":
                row = ((na + n) * c[a] + (nb + n) * c[b] - n * own) / (na + nb + n)
            else:
                row = (na * c[a] + nb * c[b]) / (na + nb)
            row[a] = row[b] = np.inf
            c[a], c[:, a] = row, row
            c[b], c[:, b] = np.inf, np.inf
            n[a], bound[a], live[b] = na + nb, min(bound[a], bound[b]), False
            touched[a] = touched[b] = True
        again = np.flatnonzero(live & (touched | touched[best]))
        best[again] = c[again].argmin(axis=1)


#: Decimals of distances that are compared for order.
DECIMALS = 9


# ---- which blocks a row has to meet ------------------------------------------------


def homes(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row."""
    norm = (pivots * pivots).sum(1)
    found = [
        (norm[None, :] - 2 * (m[at : at + 1024] @ pivots.T)).argmin(axis=1).astype(np.int32)
        for at in range(0, len(m), 1024)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def cell_reach(m: np.ndarray, home: np.ndarray, reach: np.ndarray, pivots: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of the cells each row may have matches in; its own (`home`) always.

    A right row of cell q is on q's side of the plane between q and any other
    pivot. A left row further than its radius beyond that plane cannot match.
    The slack covers rounding, which weighs more the nearer two pivots are.
    """
    own, at = np.unique(home, return_inverse=True)
    mine, there = pivots[own], pivots[cells]
    to_own = (mine * mine).sum(1)[at] - 2 * (m * mine[at]).sum(1)
    to_cells = (there * there).sum(1)[None, :] - 2 * (m @ there.T)
    between = np.sqrt(np.maximum(distances(mine, there, "euclidean") ** 2, 1e-300))[at]
    ahead = (to_cells - to_own[:, None]) / (2 * between)
    return (ahead <= reach[:, None] + 1e-9 + 1e-15 / between) | (home[:, None] == cells[None, :])


def tile_blocks(lm, home, reach, cell, pivots, symmetric: bool, home_only: bool, square: bool):
    """(left rows, right rows) of bounded blocks that cover all pairs in reach of one tile.

    Both sides are sorted, by home and by cell. Left rows of one home go together,
    and meet the cells that one of them can reach. Square blocks are for kernels
    whose result grows with both sides.
    """
    cells, sizes = np.unique(cell, return_counts=True)
    step = 1024 if square else max(1, min(1024, CHUNK // max(1, len(cell))))
    for at in range(0, len(lm), step):
        i = slice(at, at + step)
        if home_only:
            go = home[i][:, None] == cells[None, :]
        else:
            go = cell_reach(lm[i], home[i], reach[i], pivots, cells)
        if symmetric:
            # The pair is met from the side of the smaller cell; its own cell both rows share.
            go &= cells[None, :] >= home[i][:, None]
        seen = go.any(axis=0)
        j = None if seen.all() else np.flatnonzero(np.repeat(seen, sizes))
        width = max(1, CHUNK // len(go))
        for b in range(0, len(cell) if j is None else len(j), width):
            yield i, slice(b, b + width) if j is None else j[b : b + width]


def pair_costs(lm: np.ndarray, n: np.ndarray, rm: np.ndarray, m: np.ndarray, linkage: str) -> np.ndarray:
    """What joining costs, row by row of two tables of means and sizes."""
    if linkage == "average":
        return 1.0 - (lm * rm).sum(1)
    return ((lm - rm) ** 2).sum(1) * (n * m / (n + m))


def agglomerate_all(means: np.ndarray, sizes: np.ndarray, linkage: str, cut: float) -> list[tuple]:
    """(source, target, cost) of all merges up to the cut; as `agglomerate` with nothing outside, but without a matrix.

    Each cluster knows its cheapest partner. All pairs that are each other's merge at once, and only
    clusters that changed or whose partner did are compared with the others again.
    """
    mean, n = means.copy(), sizes.astype(float)
    live = np.ones(len(n), bool)
    best, cost = np.zeros(len(n), np.int64), np.full(len(n), np.inf)
    stale = np.arange(len(n))
    out = []
    while True:
        left = np.flatnonzero(live)
        lm, ln = mean[left], n[left]
        square = (lm * lm).sum(1)
        step = max(1, CHUNK // max(1, len(left)))
        for at in range(0, len(stale) if len(left) > 1 else 0, step):
            i = stale[at : at + step]
            c = mean[i] @ lm.T
            if linkage == "ward":
                c *= -2
                c += square
                c += (mean[i] * mean[i]).sum(1)[:, None]
                np.maximum(c, 0.0, out=c)
                c /= 1 / n[i][:, None] + 1 / ln
            else:
                np.subtract(1.0, c, out=c)
            c[np.arange(len(i)), np.searchsorted(left, i)] = np.inf
            j = c.argmin(axis=1)
            best[i], cost[i] = left[j], c[np.arange(len(i)), j]
        i = left[cost[left] <= cut]
        if not len(i) or len(left) < 2:
            return out
        a = i[(i < best[i]) & (best[best[i]] == i)]
        if not len(a):  # rounding may break a tie differently on each side; the cheapest pair is right in any case
            least = i[cost[i].argmin()]
            a = np.array([min(least, best[least])])
            best[a], cost[a] = max(least, best[least]), cost[least]
        b = best[a]
        out += zip(b.tolist(), a.tolist(), cost[a].tolist())
        size = n[a] + n[b]
        mean[a] = (mean[a] * n[a][:, None] + mean[b] * n[b][:, None]) / size[:, None]
        n[a], live[b] = size, False
        touched = np.zeros(len(n), bool)
        touched[a] = touched[b] = True
        stale = np.flatnonzero(live & (touched | touched[best]))


# ---- greedy leaders on a slice of the timeline -------------------------------------


def km_between(lat, lon, lats, lons):
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def lead(pdf, state, window_us, km):
    """Leader per row of a time-sorted slice, given the leaders open before it.

    Leaders open in order of time, so those whose window has passed are the first
    ones, and a row is compared with all open ones at once.
    """
    before = [] if state is None else list(state)
    keys, times = pdf["key"].to_numpy(), pdf["t"].to_numpy()
    lats, lons = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
    leader = np.empty(len(pdf), dtype=np.int64)
    room = len(before) + len(pdf)
    okey, ot = np.empty(room, np.int64), np.empty(room, np.int64)
    olat, olon = np.empty(room), np.empty(room)
    low, high = 0, len(before)
    for n, s in enumerate(before):
        okey[n], ot[n] = s["key"], s["t"]
        olat[n], olon[n] = (np.nan if s[c] is None else s[c] for c in ("lat", "lon"))
    placed = ~np.isnan(lats)
    i = -1
    while (i := i + 1) < len(pdf):
        t = times[i]
        while low < high and t - ot[low] > window_us:
            low += 1
        if low < high and np.isnan(olat[low]):
            # The first open leader has no place, so it takes all that its window holds.
            end = int(np.searchsorted(times, ot[low] + window_us, "right"))
            leader[i:end] = okey[low]
            i = end - 1
            continue
        found = -1
        if low < high:
            if not placed[i]:
                found = low
            else:
                la, lo = olat[low:high], olon[low:high]
                hit = np.isnan(la) | (km_between(la, lo, lats[i], lons[i]) <= km)
                first = hit.argmax()
                found = low + first if hit[first] else -1
        if found < 0:
            okey[high], ot[high], olat[high], olon[high] = keys[i], t, lats[i], lons[i]
            found, high = high, high + 1
        leader[i] = okey[found]
    open_ = [(okey[n], ot[n], olat[n], olon[n]) for n in range(low, high)]
    return leader, open_


# ---- groups of near hashes ----------------------------------------------------------


def alike(a: dict, b: dict, i: np.ndarray, j: np.ndarray, limit: int, km: float) -> np.ndarray:
    """Which rows i of a and j of b have hashes of fewer differing bits than the limit, at places that can be one.

    Two rows that are both not late are never alike: time has grouped them before.
    """
    hit = np.bitwise_count(a["phash"][i][:, None] ^ b["phash"][j][None, :]) < limit
    hit &= (a["late"][i][:, None] + b["late"][j][None, :]) > 0
    x, y = np.nonzero(hit)
    la, lo, lb, ob = a["lat"][i][x], a["lon"][i][x], b["lat"][j][y], b["lon"][j][y]
    unknown = np.isnan(la) | np.isnan(lo) | np.isnan(lb) | np.isnan(ob)
    far = ~unknown
    far[far] = ~(km_between(la[far], lo[far], lb[far], ob[far]) <= km)
    hit[x[far], y[far]] = False
    return hit


def tie(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """First place of the component of each of n places, given links a - b (and the components so far)."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def first_leaders(rows: dict, limit: int, km: float) -> np.ndarray:
    """Place of each row's leader (its own for a leader), rows visited in order."""
    n = len(rows["pos"])
    owner = np.full(n, -1)
    for i in range(n):
        if owner[i] < 0:
            rest = np.flatnonzero(owner[i:] < 0) + i
            took = rest[alike(rows, rows, np.array([i]), rest, limit, km)[0]]
            owner[took] = i
            owner[i] = i
    return owner


def nullable(x):
    return None if x is None or np.isnan(x) else float(x)


# ---- files ------------------------------------------------------------------------


def file_sha256(path: str, chunk: int) -> str:
    """Read a file in chunks through the file system that its scheme names."""
    digest = hashlib.sha256()
    if path.startswith(("file:", "/")):
        source = open(unquote(urlparse(path).path), "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path)
        source = system.open_input_stream(inside)
    with source:
        while block := source.read(chunk):
            digest.update(block)
    return digest.hexdigest()
