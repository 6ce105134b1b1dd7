"""A plain sequential model of the planning rules, for small inputs.

It walks shipments one by one, the slow and obvious way, and shares no code
with the package but its fixed values.
"""

from __future__ import annotations

import math
from hashlib import md5
from itertools import combinations

from haulplan.operators.places import CITY_BOXES

CAP = 22_000_000


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))


def bearing(a, b, c, d):
    p, q, l = math.radians(a), math.radians(c), math.radians(d - b)
    return math.degrees(math.atan2(math.sin(l) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(l))) % 360


def place(lat, lng):
    if not (6 <= lat <= 38 and 68 <= lng <= 98):
        return "invalid_coord"
    for name, a, b, c, d in CITY_BOXES:
        if a <= lat <= b and c <= lng <= d:
            return name
    return f"{round(lat / 0.2) * 0.2:.1f}_{round(lng / 0.2) * 0.2:.1f}"


def merge_places(members, radius):
    """place -> cluster: one sweep over name pairs with live centroids."""
    root = {p: p for p in members}
    pts = {p: list(v) for p, v in members.items()}
    mean = lambda p: (sum(x for x, _ in pts[p]) / len(pts[p]), sum(y for _, y in pts[p]) / len(pts[p]))
    for a, b in combinations(sorted(members), 2):
        ra, rb = root[a], root[b]
        if ra != rb and hav(*mean(ra), *mean(rb)) <= radius:
            pts[ra] += pts.pop(rb)
            root = {p: (ra if r == rb else r) for p, r in root.items()}
    return {p: min(q for q in root if root[q] == root[p]) for p in root}


def window_groups(rows, overlap):
    groups = []
    for s in sorted(rows, key=lambda s: (s["e"], s["id"])):
        for g in reversed(groups):
            if min(x["l"] for x in [*g, s]) - max(x["e"] for x in [*g, s]) >= overlap:
                g.append(s)
                break
        else:
            groups.append([s])
    return groups


def first_fit(items, size, cap):
    bins = []
    for s in items:
        for b in bins:
            if sum(size(x) for x in b) + size(s) <= cap:
                b.append(s)
                break
        else:
            bins.append([s])
    return bins


def offset_detour(a, b):
    o = ((a["plat"] + b["plat"]) / 2, (a["plng"] + b["plng"]) / 2)
    da, db = hav(*o, a["dlat"], a["dlng"]), hav(*o, b["dlat"], b["dlng"])
    ab = hav(a["dlat"], a["dlng"], b["dlat"], b["dlng"])
    return 0.0 if max(da, db) <= 0 else max((min(da, db) + ab - max(da, db)) / max(da, db), 0.0)


def route_reason(a, b, sc):
    if a["dp"] == b["dp"]:
        return "exact_lane", False
    km = hav(a["dlat"], a["dlng"], b["dlat"], b["dlng"])
    if km <= sc.delivery_cluster_km:
        return "dest_cluster", km > 25
    r = offset_detour(a, b)
    return ("corridor", r > 0.10) if r <= sc.clustering_detour else (None, False)


def cluster(rows, sc, refused=frozenset()):
    """Groups (lists of shipments) and the ids that were paired as a corridor."""
    overlap = sc.min_overlap_minutes * 60
    for s in rows:
        s["pp"], s["dp"] = place(s["plat"], s["plng"]), place(s["dlat"], s["dlng"])
    by = lambda k, it: {v: [s for s in it if s[k] == v] for v in {s[k] for s in it}}
    origins = merge_places({p: [(s["plat"], s["plng"]) for s in v] for p, v in by("pp", rows).items()}, sc.pickup_radius_km)
    done, corridor, lone = [], set(), []
    for oc in sorted(set(origins.values())):
        mine = [s for s in rows if origins[s["pp"]] == oc]
        dests = merge_places({p: [(s["dlat"], s["dlng"]) for s in v] for p, v in by("dp", mine).items()}, sc.delivery_cluster_km)
        groups = []
        for dc in sorted(set(dests.values())):
            here = [s for s in mine if dests[s["dp"]] == dc]
            done += [[s] for s in here if s["l"] - s["e"] < overlap]
            for k, g in enumerate(window_groups([s for s in here if s["l"] - s["e"] >= overlap], overlap)):
                groups.append(((oc, dc, k), g))
        singles, used = [(key, g[0]) for key, g in groups if len(g) == 1], set()
        for (ka, a), (kb, b) in combinations(singles, 2):
            if a["id"] in used or b["id"] in used or a["u"] + b["u"] > CAP:
                continue
            if min(a["l"], b["l"]) - max(a["e"], b["e"]) < overlap:
                continue
            reason, review = route_reason(a, b, sc)
            if reason is None or (review and frozenset((a["id"], b["id"])) in refused):
                continue
            used |= {a["id"], b["id"]}
            corridor |= {a["id"], b["id"]}
            done.append([a, b])
        for key, g in groups:
            if g[0]["id"] in used and len(g) == 1:
                continue
            bins = [g]
            if sum(s["u"] for s in g) > CAP:
                bins = first_fit(sorted(g, key=lambda s: (-s["u"], s["e"], md5(s["id"].encode()).hexdigest()[:3], s["id"])), lambda s: s["u"], CAP)
            for b in bins:
                lone.append((key, b[0])) if len(b) == 1 else done.append(b)
    for lane in sorted({(s["pp"], s["dp"]) for _, s in lone}):
        bin_ = []
        for _, s in sorted(
            ((k, s) for k, s in lone if (s["pp"], s["dp"]) == lane), key=lambda t: (t[0], -t[1]["u"], t[1]["e"], t[1]["id"])
        ):
            both = [*bin_, s]
            fits = sum(x["u"] for x in both) <= CAP and min(x["l"] for x in both) - max(x["e"] for x in both) >= overlap
            if bin_ and not fits:
                done.append(bin_)
                bin_ = []
            bin_ = [*bin_, s]
        done.append(bin_)
    return done, corridor


def may_travel(a, b, sc):
    road = lambda s: 1.35 * hav(s["plat"], s["plng"], s["dlat"], s["dlng"])
    if road(a) < 20 and road(b) < 20:
        return True
    gap = abs(bearing(a["plat"], a["plng"], a["dlat"], a["dlng"]) - bearing(b["plat"], b["plng"], b["dlat"], b["dlng"]))
    if min(gap, 360 - gap) > sc.max_bearing_diff:
        return False
    o = ((a["plat"] + b["plat"]) / 2, (a["plng"] + b["plng"]) / 2)
    da, db = hav(*o, a["dlat"], a["dlng"]), hav(*o, b["dlat"], b["dlng"])
    ab = hav(a["dlat"], a["dlng"], b["dlat"], b["dlng"])
    return min((da + ab) / db if db > 0 else 1.0, (db + ab) / da if da > 0 else 1.0) <= sc.route_detour


def routes(groups, sc):
    out = []
    for g in groups:
        g = sorted(g, key=lambda s: (-s["u"], s["e"], s["id"]))
        bins = [g]
        if len(g) > 1 and sum(s["vol"] for s in g) > 960 * 240 * 240:
            bins = first_fit(sorted(g, key=lambda s: -s["vol"]), lambda s: s["vol"], 960 * 240 * 240)
        for b in bins:
            subs = []
            for s in sorted(b, key=g.index):
                for sub in subs:
                    if all(may_travel(s, x, sc) for x in sub):
                        sub.append(s)
                        break
                else:
                    subs.append([s])
            out += subs
    return out
