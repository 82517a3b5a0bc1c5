"""Placement and routing of tree nodes over storage tiers (COST-1, COST-3..5, AGG-8..10, TOP-3..4, SNK-9)."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.costs import BENCH, BLOCK_BYTES, GPU_ACCESS, tier_cost
from strandlake.operators.durable import checkpointed

TIERS = ("gpu", "dram", "disk", "not_stored")


def node_cost(size: int, tier: str, k: int, length: int = 1200, bench: dict = BENCH) -> float:
    """Driver-side twin of functions.costs.tier_cost, for the solver."""
    rest = max(0, k - size) * length / bench["prefill"]
    gb = size * BLOCK_BYTES / 1024**3
    if tier == "gpu":
        return GPU_ACCESS + rest
    if tier == "dram":
        return gb / bench["pcie_gbps"] + rest
    if tier == "disk":
        return gb / bench["nvme_gbps"] + gb / bench["pcie_gbps"] + rest
    return k * length / bench["prefill"]


def _total(assign, nodes, leaves, k, length):
    cost, route = 0.0, {}
    for leaf, freq, path in leaves:
        best = min((node_cost(nodes[s], assign[s], k, length), n, s) for n, s in enumerate(path))
        cost += freq * best[0]
        route[leaf] = best[2]
    return cost, route


def solve(nodes: dict[int, int], leaves: list[tuple[int, int, list[int]]], k: int, capacity: dict[str, float], length: int = 1200, steps: int = 200_000):
    """(assignment, routing, cost, status, bound). nodes: id -> size; leaves: (id, frequency, [id, *ancestors]).

    One algorithm at every size: greedy by saving per byte and local search give a plan, then branch and
    bound looks for a cheaper one, most useful nodes first, for at most ``steps`` branches. If these were
    enough the status is ``optimal`` and ``bound`` is the cost; else it is ``feasible``, and no plan can
    cost less than ``bound``: the cost if each node had the fastest tier with room for it alone.
    """
    room = {t: int(capacity[t] * 1024**3 // BLOCK_BYTES) for t in TIERS[:3]}
    plan = _improved(nodes, leaves, k, length, room)
    best, complete, bound = _branched(plan, nodes, leaves, k, length, room, steps)
    cost, route = _total(best, nodes, leaves, k, length)
    return best, route, cost, "optimal" if complete else "feasible", cost if complete else min(bound, cost)


def _branched(plan, nodes, leaves, k, length, room, steps):
    """A cheaper plan than the given one, if there is one within the steps; whether all plans were covered; the bound at the root."""
    unit = {i: {t: node_cost(nodes[i], t, k, length) for t in TIERS} for i in nodes}
    fits = {i: sorted((t for t in TIERS if t == "not_stored" or nodes[i] <= room[t]), key=unit[i].get) for i in nodes}
    below: dict[int, list[int]] = {i: [] for i in nodes}
    for n, (_, _, path) in enumerate(leaves):
        for i in set(path):
            below[i].append(n)
    #: Of a leaf, what each node of its path may still offer at best.
    offer = [{i: unit[i][fits[i][0]] for i in path} for _, _, path in leaves]
    freq = [f for _, f, _ in leaves]
    least = [min(o.values()) for o in offer]
    bound = root = sum(f * c for f, c in zip(freq, least, strict=True))
    use = {i: sum(freq[n] for n in below[i]) * (unit[i]["not_stored"] - unit[i][fits[i][0]]) for i in nodes}
    order = sorted(nodes, key=lambda i: (-use[i], i))
    best, best_cost = dict(plan), _total(plan, nodes, leaves, k, length)[0]
    left = {**room, "not_stored": float("inf")}
    now: dict[int, str] = {}
    stack: list[tuple[int, int, list]] = [(0, 0, [])]  # depth, next tier of the node there, what to undo
    while stack:
        depth, tier, undo = stack.pop()
        for n, i, was_offer, was_least in reversed(undo):
            offer[n][i], least[n] = was_offer, was_least
        if undo or tier:
            gone = order[depth]
            if gone in now:
                left[now[gone]] += nodes[gone]
                del now[gone]
            bound = sum(f * c for f, c in zip(freq, least, strict=True)) if undo else bound
        if depth == len(order):
            if bound < best_cost - 1e-12:
                best, best_cost = dict(now), bound
            continue
        i = order[depth]
        while tier < len(fits[i]) and nodes[i] > left[fits[i][tier]]:
            tier += 1
        if tier == len(fits[i]):
            continue
        if steps <= 0:
            return best, False, root
        steps -= 1
        t = fits[i][tier]
        undo = []
        for n in below[i]:
            undo.append((n, i, offer[n][i], least[n]))
            offer[n][i] = unit[i][t]
            changed = min(offer[n].values())
            bound += freq[n] * (changed - least[n])
            least[n] = changed
        now[i] = t
        left[t] -= nodes[i]
        stack.append((depth, tier + 1, undo))
        if bound < best_cost - 1e-12:
            stack.append((depth + 1, 0, []))
    return best, True, root


def prepared(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, size, parent, frequency) with what the optimiser needs (COST-1): is_leaf, bytes, path to the root."""
    from strandlake.operators.tree import ancestors

    inner = nodes.where("parent is not null").select(F.col("parent").alias("node_id"), F.lit(False).alias("is_leaf")).distinct()
    up = ancestors(nodes.select("node_id", "parent")).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "ancestor"))), lambda s: s["ancestor"]).alias("up"))
    out = nodes.join(inner, "node_id", "left").join(up, "node_id", "left")
    path = F.concat(F.array("node_id"), F.coalesce("up", F.array().cast("array<bigint>")))
    return out.select(*nodes.columns, F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"), (F.col("size").cast("long") * BLOCK_BYTES).alias("bytes"), path.alias("path"))


def candidates(nodes: DataFrame, k: int, length: int = 1200) -> DataFrame:
    """Every way to serve a leaf (JOIN-11): leaf, frequency, level, server, tier, cost.

    ``nodes`` (node_id, size, parent, frequency): a leaf is a node without children, a server the leaf or
    one of its ancestors, on any tier.
    """
    from strandlake.operators.tree import ancestors

    inner = nodes.where("parent is not null").select(F.col("parent").alias("node_id")).distinct()
    leaves = nodes.join(inner, "node_id", "left_anti").select(F.col("node_id").alias("leaf"), "frequency")
    reach = ancestors(nodes.select("node_id", "parent")).withColumnsRenamed({"node_id": "leaf", "ancestor": "server"})
    own = leaves.select("leaf", F.col("leaf").alias("server"), F.lit(0).alias("level"))
    ways = leaves.join(own.unionByName(reach.select("leaf", "server", "level")), "leaf")
    ways = ways.join(nodes.select(F.col("node_id").alias("server"), "size"), "server")
    ways = ways.withColumn("tier", F.explode(F.array(*map(F.lit, TIERS))))
    return ways.select("leaf", "frequency", "level", "server", "size", "tier", tier_cost(F.col("size"), F.col("tier"), F.lit(k), length).alias("cost"))


def plan(nodes: DataFrame, k: int, capacity: dict[str, float], length: int = 1200, steps: int = 200_000) -> tuple[DataFrame, DataFrame, dict]:
    """Placement of a node table: (assigned, routes, report).

    ``nodes`` as in :func:`candidates`. ``assigned`` (node_id, size, frequency, is_leaf, storage); ``routes``
    (leaf, server, level, frequency, size, storage, cost) serve each leaf from its cheapest node; ``report``
    has the solver's status, cost and bound. Placing is one problem over all nodes, solved on the driver:
    what it collects is a row a node and a path a leaf.
    """
    spark = nodes.sparkSession
    ways = checkpointed(candidates(nodes, k, length))
    paths = ways.where(F.col("tier") == TIERS[0]).groupBy("leaf", "frequency").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "server"))), lambda s: s["server"]).alias("path"))
    sizes = {r["node_id"]: r["size"] for r in nodes.select("node_id", "size").collect()}
    leaves = sorted((r["leaf"], r["frequency"], list(r["path"])) for r in paths.collect())
    assignment, _, cost, status, bound = solve(sizes, leaves, k, capacity, length, steps)
    tiers = spark.createDataFrame([(int(i), t) for i, t in assignment.items()], "node_id long, storage string")
    ends = paths.select(F.col("leaf").alias("node_id"), F.lit(True).alias("end"))
    assigned = nodes.join(tiers, "node_id").join(ends, "node_id", "left").select("node_id", "size", "frequency", F.coalesce("end", F.lit(False)).alias("is_leaf"), "storage")
    stored = ways.join(tiers.select(F.col("node_id").alias("server"), F.col("storage").alias("tier")), ["server", "tier"])
    cheapest = stored.groupBy("leaf", "frequency").agg(F.min(F.struct("cost", "level", "server", "size", "tier")).alias("b"))
    routes = cheapest.select("leaf", "frequency", "b.server", "b.level", "b.size", F.col("b.tier").alias("storage"), "b.cost")
    return assigned, routes, {"status": status, "cost": cost, "bound": bound}


def _improved(nodes, leaves, k, length, room):
    """Tier of each node: first by saving per byte, then by moves until none saves more.

    Moves: one node; two, one making room; a node for the least useful ones of a tier, with the room filled again.
    """
    ids = sorted(nodes)
    unit = {i: {t: node_cost(nodes[i], t, k, length) for t in TIERS} for i in ids}
    a = dict.fromkeys(ids, "not_stored")
    used = dict.fromkeys(TIERS, 0)
    room = room | {"not_stored": float("inf")}
    below = {i: [] for i in ids}
    for n, (_, _, path) in enumerate(leaves):
        for s in set(path):
            below[s].append(n)
    now = [min(unit[s]["not_stored"] for s in path) for _, _, path in leaves]

    def saving(change):
        touched = {n for i in change for n in below[i]}
        return sum(leaves[n][1] * (now[n] - min(unit[s][change.get(s, a[s])] for s in leaves[n][2])) for n in touched)

    def fits(change):
        after = dict(used)
        for i, t in change.items():
            after[a[i]] -= nodes[i]
            after[t] += nodes[i]
        return all(after[t] <= room[t] for t in change.values())

    def apply(change):
        for i, t in change.items():
            used[a[i]] -= nodes[i]
            used[t] += nodes[i]
            a[i] = t
        for n in {n for i in change for n in below[i]}:
            now[n] = min(unit[s][a[s]] for s in leaves[n][2])

    def entry(i, t):
        return (-saving({i: t}) / max(nodes[i], 1e-9), i, TIERS.index(t))

    def fill():
        heap = [entry(i, t) for i in ids if a[i] == "not_stored" for t in TIERS[:3]]
        heapq.heapify(heap)
        while heap:  # savings only shrink as others are stored, so an entry that is still first is the best
            was, i, t = heapq.heappop(heap)
            change = {i: TIERS[t]}
            if a[i] != "not_stored" or not fits(change):
                continue
            again = entry(i, TIERS[t])
            if again[0] > -1e-12:
                continue
            if again[0] > was + 1e-12:
                heapq.heappush(heap, again)
            else:
                apply(change)

    def total():
        return sum(freq * c for (_, freq, _), c in zip(leaves, now, strict=True))

    def step():
        for i in ids:
            for t in sorted(TIERS, key=unit[i].get):
                if unit[i][t] >= unit[i][a[i]] or saving({i: t}) <= 1e-9:
                    break
                if fits({i: t}):
                    return {i: t}
                for j in ids:  # a node that makes room for it, and goes elsewhere
                    if j != i and a[j] == t:
                        for u in TIERS:
                            pair = {i: t, j: u}
                            if u != t and fits(pair) and saving(pair) > 1e-9:
                                return pair
        return None

    def forced(i, t):
        """Node i on tier t, the least useful nodes there leave, and all room is filled again: kept if it saves."""
        before, cost = dict(a), total()
        for j in sorted((j for j in ids if a[j] == t), key=lambda j: (saving({j: "not_stored"}) / -max(nodes[j], 1e-9), j)):
            if fits({i: t}):
                break
            apply({j: "not_stored"})
        apply({i: t})
        fill()
        if total() < cost - 1e-9:
            return True
        apply({j: before[j] for j in ids if a[j] != before[j]})
        return False

    fill()
    while True:
        if change := step():
            apply(change)
        elif not any(forced(i, t) for i in ids for t in TIERS[:3] if nodes[i] <= room[t] and unit[i][t] < unit[i][a[i]]):
            return a


def utilization(assigned: DataFrame, capacity_gb: dict[str, float]) -> DataFrame:
    """Per tier: nodes, used bytes and share of capacity; assigned (node_id, size, storage)."""
    cap = F.create_map(*[x for t, g in capacity_gb.items() for x in (F.lit(t), F.lit(float(g)))])
    used = assigned.where("storage <> 'not_stored'").groupBy("storage").agg(F.count("*").alias("n"), (F.sum("size") * F.lit(BLOCK_BYTES)).cast("long").alias("used_bytes"))
    gb = F.col("used_bytes") / float(1024**3)
    return used.select("storage", "n", "used_bytes", F.round(100 * gb / cap[F.col("storage")], 6).alias("utilization_pct"))


def summary(assigned: DataFrame) -> DataFrame:
    """Per tier: leaves, inner nodes, mean frequency and size; empty tiers are absent."""
    return assigned.groupBy("storage").agg(
        F.sum(F.col("is_leaf").cast("long")).alias("leaves"),
        F.sum((~F.col("is_leaf")).cast("long")).alias("inner_nodes"),
        F.round(F.avg("frequency"), 6).alias("avg_frequency"),
        F.round(F.avg("size"), 6).alias("avg_size"),
    )


def top_nodes(assigned: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("storage").orderBy(F.desc("frequency"), "node_id")
    return assigned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("storage", "rank", "node_id", "frequency")


def routing(routes: DataFrame, k: int) -> DataFrame:
    """By level: frequency served there and documents computed beyond the server; routes (level, frequency, size)."""
    rest = F.greatest(F.lit(0), F.lit(k) - F.col("size"))
    return routes.groupBy("level").agg(F.sum("frequency").alias("served"), F.sum(rest * F.col("frequency")).cast("long").alias("computed"))
