"""Plain Python restatements of the operators, for small inputs."""

import math
from collections import Counter, defaultdict, deque

R = 6378137.0


def metres(a, b, exact=False):
    la, lb = math.radians(a[0]), math.radians(b[0])
    u = math.sin((la - lb) / 2)
    v = math.sin((math.radians(a[1]) - math.radians(b[1])) / 2)
    d = 2 * R * math.asin(min(1.0, math.sqrt(u * u + math.cos(la) * math.cos(lb) * v * v)))
    return d if exact else float(math.floor(d * 10000 + 0.5) // 10000)


def stays(track, reach=200.0, dwell=1200, exact=False):
    """(start, stop) of the greedy stays of one track of (lat, lon, seconds) rows."""
    found, i, n = [], 0, len(track)
    while i < n - 1:
        j = i + 1
        while j < n and metres(track[i], track[j], exact) <= reach:
            j += 1
        ends = track[i][2], track[j - 1][2]
        gap = 0 if None in ends else abs(ends[1] - ends[0])
        if j - i > 1 and gap >= dwell:
            found.append((i, j))
            i = j
        else:
            closing = track[min(j, n - 1)]
            i += 1
            while i < j and metres(track[i], closing, exact) > reach:
                i += 1
    return found


def plane(lat, lon):
    x = math.pi * R + R * math.radians(lon)
    y = math.pi * R / 2 - math.pi * R / 4.6 * 1.25 * math.log(math.tan(math.pi / 4 + 0.4 * math.radians(lat)))
    return x, y


def dbscan(points, eps, min_pts):
    """(cluster_id, flag) per (lat, lon); the list order is the key order."""
    xy = [plane(*p) for p in points]
    near = [
        [j for j, b in enumerate(xy) if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= eps * eps] for a in xy
    ]
    core = [len(n) >= min_pts for n in near]
    cluster, count = [0] * len(xy), 0
    for i in range(len(xy)):
        if core[i] and not cluster[i]:
            count += 1
            cluster[i] = count
            todo = deque([i])
            while todo:
                for j in near[todo.popleft()]:
                    if core[j] and not cluster[j]:
                        cluster[j] = count
                        todo.append(j)
    result = []
    for i in range(len(xy)):
        reached = [cluster[j] for j in near[i] if core[j]]
        if core[i]:
            result.append((cluster[i], "Core"))
        elif reached:
            result.append((min(reached), "Border"))
        else:
            result.append((0, "Noise"))
    return result


def pairs(region_user, min_support):
    by_region = defaultdict(set)
    for region, uid in region_user:
        by_region[region].add(uid)
    counts = Counter(
        (a, b) for users in by_region.values() for a in users for b in users if a < b
    )
    return {p: n for p, n in counts.items() if n >= min_support}


def recommend(similar, ranked, top_n, same_count=False):
    """Literal rounds: similar {uid: [others]}, ranked {uid: [(region, visits)]}."""
    result = {}
    for uid, others in similar.items():
        mine = ranked[uid]
        picked, turn = [], 0
        while len(picked) < top_n:
            before = len(picked)
            for other in sorted(others):
                if turn < len(ranked[other]) and len(picked) < top_n:
                    region, visits = ranked[other][turn]
                    known = (region, visits) in mine if same_count else region in [r for r, _ in mine]
                    if region not in picked and not known:
                        picked.append(region)
            if len(picked) == before:
                break
            turn += 1
        result[uid] = picked
    return result
