"""Property graphs: path hierarchy, referential checks, degrees, communities, risk, closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_id, title_case
from tessera.operators.lineage import checkpointed

# Scores depend on exactly these.
SYMBOL_LABELS = ("Function", "Class", "Method", "Interface")
SCORED_LABELS = (*SYMBOL_LABELS, "File")
COMMUNITY_EDGES = ("CALLS", "INHERITS", "IMPLEMENTS")
RISK_EDGES = ("CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "HAS_METHOD")
RISK_WEIGHTS = {"in_degree": 0.40, "crossings": 0.30, "loc": 0.20, "out_degree": 0.10}
#: Frontiers of a closure that stay apart; then they are put together once.
ROUNDS_KEPT = 8
RISK_LEVELS = (("low", 0.25), ("medium", 0.5), ("high", 0.75))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def path_prefixes(files: DataFrame, path: str = "path") -> DataFrame:
    """(…, depth, prefix, parent, name, label): each path's folders and the file itself, from the root down."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    rows = files.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("depth", "name"))
    prefix = F.array_join(F.slice("_parts", F.lit(1), F.col("depth") + 1), "/")
    parent = F.when(F.col("depth") > 0, F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), "/"))
    label = F.when(F.col("depth") == F.size("_parts") - 1, "File").otherwise("Folder")
    return rows.select("*", prefix.alias("prefix"), parent.alias("parent"), label.alias("label")).drop("_parts")


def hierarchy_nodes(prefixes: DataFrame, order: str) -> DataFrame:
    """One node per id; the first in input order wins."""
    ided = prefixes.withColumn("id", content_id(F.col("label"), F.col("prefix")))
    fields = F.struct("label", "prefix", "name", "depth")
    return ided.groupBy("id").agg(F.min_by(fields, F.col(order)).alias("n")).select("id", "n.*")


def hierarchy_edges(prefixes: DataFrame) -> DataFrame:
    """CONTAINS edges from each folder to its child, one for every file below: a bag."""
    src = content_id(F.lit("Folder"), F.col("parent"))
    tgt = content_id(F.col("label"), F.col("prefix"))
    return prefixes.where("parent is not null").select(content_id(F.lit("CONTAINS"), src, tgt).alias("id"), F.lit("CONTAINS").alias("type"), src.alias("source_id"), tgt.alias("target_id"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*fields), F.col(order)).alias("r")).select(key, "r.*")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("r")).select(key, "r.*")


def referential(edges: DataFrame, nodes: DataFrame, node_id: str = "id", source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Edges whose ends both exist, repeats kept."""
    ids = nodes.select(F.col(node_id).alias("_id")).distinct()
    return edges.join(ids, F.col(source) == F.col("_id"), "left_semi").join(ids, F.col(target) == F.col("_id"), "left_semi")


def degrees(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(id, in_degree, out_degree), repeats counted; one pass over the edges and one shuffle of partial sums."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(source).alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(target).alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def crossings(edges: DataFrame, communities: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(id, crossings): an edge between two known, different communities counts for both ends."""
    side = lambda name: communities.select(F.col("id").alias(f"_{name}"), F.col("community").alias(f"_{name}_c"))
    known = edges.join(side("s"), F.col(source) == F.col("_s")).join(side("t"), F.col(target) == F.col("_t")).where("_s_c != _t_c")
    return known.select(F.explode(F.array(source, target)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("crossings"))


def share_of_max(value: str) -> Column:
    return F.coalesce(F.col(value), F.lit(0)) / F.coalesce(F.nullif(F.col(f"max_{value}"), F.lit(0)), F.lit(1))


def risk_level(score: Column) -> Column:
    level = None
    for name, below in RISK_LEVELS:
        level = F.when(score < below, name) if level is None else level.when(score < below, name)
    return level.otherwise("critical")


def risk_scores(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, crossings, loc, risk_score, risk_level) of ``nodes`` (id, start_line, end_line).

    ``edges`` are those of the risk types; edges to other nodes do not count. The maxima are one row, joined back.
    """
    ids = nodes.select("id")
    mine = referential(edges, nodes)
    loc = nodes.select("id", F.greatest(F.lit(0), F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(0))).alias("loc"))
    joined = ids.join(degrees(mine), "id", "left").join(crossings(mine, communities), "id", "left").join(loc, "id", "left")
    joined = joined.na.fill(0, ["in_degree", "out_degree", "crossings", "loc"])
    top = joined.agg(*[F.max(c).alias(f"max_{c}") for c in RISK_WEIGHTS])
    score = None
    for name, weight in RISK_WEIGHTS.items():
        part = share_of_max(name) * F.lit(weight)
        score = part if score is None else score + part
    scored = joined.join(F.broadcast(top)).withColumn("risk_score", F.round(score, 4))
    return scored.select("id", "in_degree", "out_degree", "crossings", "loc", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"))


def cohesion(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, cohesion) of communities of two or more; undirected edges count once."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    pair = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    one = communities.select(F.col("id").alias("a"), "community")
    two = communities.select(F.col("id").alias("b"), F.col("community").alias("_c"))
    inside = pair.join(one, "a").join(two, "b").where("community = _c").groupBy("community").agg(F.count(F.lit(1)).alias("inner"))
    possible = F.greatest(F.lit(1.0), F.col("size") * (F.col("size") - 1) / 2)
    return sizes.join(inside, "community", "left").select("community", "size", F.round(F.coalesce("inner", F.lit(0)) / possible, 3).alias("cohesion"))


def community_graph(communities: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Community nodes (id, label, size) and MEMBER_OF edges of the communities of ``least`` or more members."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    name = F.concat(F.lit("comm_"), F.col("community").cast("string"))
    nodes = sizes.select(name.alias("id"), F.lit("Community").alias("label"), "size")
    edges = communities.join(sizes.select("community"), "community").select(F.lit("MEMBER_OF").alias("type"), F.col("id").alias("source_id"), name.alias("target_id"))
    return nodes, edges


def communities_of(edges: DataFrame) -> DataFrame:
    """(id, community) read back from MEMBER_OF edges."""
    number = F.regexp_extract("target_id", "^comm_(-?[0-9]+)$", 1)
    return edges.where(F.col("type") == "MEMBER_OF").where(number != "").select(F.col("source_id").alias("id"), number.cast("long").alias("community"))


def community_labels(members: DataFrame) -> DataFrame:
    """(community, label): the most frequent first folder of the members' paths, ties by name; `Community` if none."""
    parts = F.split("path", "/")
    counts = members.select("community", F.when(F.size(parts) > 1, parts[0]).alias("seg")).groupBy("community", "seg").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("community").agg(F.min(F.when(F.col("seg").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("seg").alias("seg")))).alias("b"))
    readable = title_case(F.translate("b.seg", "_-", "  "))
    return best.select("community", F.when(F.coalesce(readable, F.lit("")) == "", "Community").otherwise(readable).alias("label"))


def closure(edges: DataFrame, max_depth: int | None = None, source: str = "source_id", target: str = "target_id", starts: DataFrame | None = None) -> DataFrame:
    """(start, node, depth): everything reachable, at its least depth, cycles included.

    ``starts`` (one column, start) limits where to begin; without it every node with an edge is one, and the result
    has a row for each pair of connected nodes. Without a bound on the depth and from everywhere, the reach doubles
    each round: pairs that are as far apart as known so far are joined with all pairs. Else a frontier moves by one
    edge a round. Rounds are checkpointed, so the plan stays short and a lost executor costs one round.
    """
    step = checkpointed(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where("_from is not null and _to is not null").distinct())
    if max_depth is None and starts is None:
        return _doubled(step)
    begin = step.select(F.col("_from").alias("start")).distinct() if starts is None else starts.distinct()
    frontier = checkpointed(begin.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    rounds, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(step, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, rounds).select("start", "node")
        frontier = checkpointed(found.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        if len(rounds) > ROUNDS_KEPT:
            rounds = [checkpointed(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds)


def _doubled(step: DataFrame) -> DataFrame:
    """All pairs, by path doubling: after a round with span n, every pair up to 2 n apart is known at its least depth."""
    own = step.select(F.col("_from").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    reach = checkpointed(own.unionByName(step.where("_from != _to").select(F.col("_from").alias("start"), F.col("_to").alias("node"), F.lit(1).alias("depth"))))
    span = 1
    while True:
        far = reach.where(F.col("depth") == span).select("start", F.col("node").alias("_mid"))
        on = reach.where("depth > 0").select(F.col("start").alias("_mid"), "node", "depth")
        longer = far.join(on, "_mid").groupBy("start", "node").agg((F.min("depth") + span).alias("depth"))
        new = checkpointed(longer.join(reach, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return reach
        reach = checkpointed(reach.unionByName(new))
        span *= 2


def first_callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, name, place, first): for each function the least place among itself and all that reach it by calls.

    ``functions`` has (id, name, place), places are unique; ``calls`` (source_id, name): a call reaches every function
    of the name. Names stand between callers and functions, so a name called and defined many times costs the sum and
    not the product of both. A round hands the least place on by one call and, as whoever has the place a function has got
    reaches it too, takes over what that one has got; it ends when nothing changes.
    """
    step = checkpointed(calls.select(F.col("source_id").alias("id"), F.col("name").alias("called")).distinct())
    labels = checkpointed(functions.select("id", "name", "place", F.col("place").alias("first")))
    while True:
        told = step.join(labels.select("id", "first"), "id").groupBy(F.col("called").alias("name")).agg(F.min("first").alias("_told"))
        near = labels.join(told, "name", "left").withColumn("_near", F.least("first", F.coalesce("_told", "first")))
        over = near.select(F.col("place").alias("_near"), F.col("_near").alias("_far"))
        far = near.join(over, "_near").select("id", "name", "place", "first", F.least("_near", "_far").alias("_new"))
        moved = checkpointed(far)
        labels = moved.select("id", "name", "place", F.col("_new").alias("first"))
        if moved.where("_new != first").isEmpty():
            return labels


def discovered(starts: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(start, node, depth, number): all that each of ``starts`` (start) reaches, in breadth-first order by (depth, number).

    Within a level functions come by the number of who finds them first, then by their place. Arguments are those of
    ``first_callers``. A level is two joins and a sum; it is checkpointed, and what is known is put together now and then.
    """
    step = checkpointed(calls.select(F.col("source_id").alias("node"), "name").distinct())
    named = functions.select("name", F.col("id").alias("node"), "place")
    frontier = checkpointed(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("number")))
    rounds, depth = [frontier], 0
    while True:
        depth += 1
        asked = frontier.join(step, "node").groupBy("start", "name").agg(F.min("number").alias("by"))
        found = asked.join(named, "name").groupBy("start", "node").agg(F.min(F.struct("by", "place")).alias("key"))
        known = reduce(DataFrame.unionByName, rounds).select("start", "node")
        number = F.row_number().over(Window.partitionBy("start").orderBy("key"))
        new = found.join(known, ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth"), number.alias("number"))
        frontier = checkpointed(new)
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(frontier)
        if len(rounds) > ROUNDS_KEPT:
            rounds = [checkpointed(reduce(DataFrame.unionByName, rounds))]


def communities_by_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): label propagation over the undirected simple graph, ties to the smaller label.

    Every node has one community; nodes without edges are their own. Nodes of even and odd hash take turns, which
    keeps two neighbours from swapping labels for ever. Louvain's exact partition is not reproduced.
    """
    simple = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a != b").distinct()
    both = checkpointed(simple.union(simple.select("b", "a")).toDF("id", "near"))
    labels = checkpointed(nodes.select("id", F.col("id").alias("community")).distinct())
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "near"), "near").groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("community").alias("c"))).alias("b")).select("id", F.col("b.c").alias("_new"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        moved = checkpointed(labels.join(best, "id", "left").select("id", F.when(turn & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("community")).alias("community"), "community", "_new").toDF("id", "community", "_old", "_new"))
        settled = moved.where("community != _old or (_new is not null and _new != community)").isEmpty()
        labels = moved.select("id", "community")
        if settled:
            break
    return labels


def communities_by_modularity(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 6) -> DataFrame:
    """(id, community): local moves that raise the modularity of the undirected simple graph, then the same over the communities.

    In a round, half of the nodes (by a hash of id and round) may each move to the neighbouring community that gains most,
    ties to the smaller one; a round that does not raise the modularity ends the level. Communities become the nodes of the
    next level, their links summed. A community is named after its smallest node; nodes without edges are their own. All
    steps are joins and sums over edges, so no community has to fit in a task. The seeded order of a
    sequential method, and so its exact partition, is not reproduced.
    """
    simple = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a != b").distinct()
    ids = nodes.select("id").distinct()
    simple = simple.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")
    links = checkpointed(simple.select("a", "b", F.lit(1.0).alias("w")))
    place = checkpointed(ids.select("id", F.col("id").alias("community")))
    for level in range(levels):
        labels = _moved(links, resolution, rounds, level)
        if labels is None:
            break
        place = checkpointed(place.join(labels.toDF("community", "_c"), "community", "left").select("id", F.coalesce("_c", "community").alias("community")))
        side = lambda name: labels.toDF(name, f"_{name}")
        joined = links.join(side("a"), "a").join(side("b"), "b")
        links = checkpointed(joined.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("w").alias("w")))
    named = place.groupBy("community").agg(F.min("id").alias("_least"))
    return place.join(named, "community").select("id", F.col("_least").alias("community"))


def _moved(links: DataFrame, resolution: float, rounds: int, level: int) -> DataFrame | None:
    """(id, community) of one level, or None if no move raises the modularity. A link to itself counts twice for its node."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "w"), F.struct(F.col("b").alias("id"), "w"))).alias("e"))
    degree = checkpointed(ends.groupBy("e.id").agg(F.sum("e.w").alias("k")))
    total = degree.agg(F.sum("k").alias("t")).first()["t"]
    if not total:
        return None
    apart = links.where("a != b")
    both = checkpointed(apart.select("a", "b", "w").union(apart.select("b", "a", "w")).toDF("id", "near", "w"))
    loops = links.where("a = b").agg(F.sum("w").alias("w")).first()["w"] or 0.0

    def assessed(labels: DataFrame) -> DataFrame:
        """``labels`` (id, community, k) with the sum of k in the community, the links into it, and where the node would go.

        Labels take their sums along to their neighbours, and all that is known of a node is put together by its id, so the
        links are shuffled twice a round."""
        sums = labels.groupBy("community").agg(F.sum("k").alias("s"))
        known = labels.join(sums, "community").select("id", "community", "k", "s")
        told = both.join(known.select(F.col("id").alias("near"), F.col("community").alias("c"), F.col("s").alias("_s")), "near").select("id", "c", "_s", "w")
        options = told.repartition("id").groupBy("id", "c").agg(F.sum("w").alias("w"), F.max("_s").alias("_s")).join(known, "id")
        own = F.col("c") == F.col("community")
        gain = lambda w, rest: F.round(w - resolution * F.col("k") * rest / total, 9)
        near = gain(F.col("w"), F.col("_s") - F.when(own, F.col("k")).otherwise(0.0))
        best = options.groupBy("id").agg(F.min(F.struct((-near).alias("g"), F.col("c").alias("c"))).alias("best"), F.max(F.when(own, near)).alias("stay"), F.sum(F.when(own, F.col("w"))).alias("own"))
        stay = F.coalesce("stay", gain(F.lit(0.0), F.col("s") - F.col("k")))
        go = F.when(-F.col("best.g") > stay, F.col("best.c")).otherwise(F.col("community"))
        return checkpointed(known.join(best, "id", "left").select("id", "community", "k", "s", F.coalesce("own", F.lit(0.0)).alias("own"), go.alias("go")))

    def quality(now: DataFrame) -> float:
        row = now.agg(F.sum("own").alias("i"), F.sum(F.col("k") * F.col("s")).alias("q")).first()
        return (row["i"] + 2 * loops) / total - resolution * row["q"] / total**2

    now = assessed(degree.select("id", F.col("id").alias("community"), "k"))
    best, idle, moved = quality(now), 0, False
    for r in range(rounds):
        turn = F.pmod(F.xxhash64("id", F.lit(level), F.lit(r // 2)), F.lit(2)) == r % 2
        tried = assessed(now.select("id", F.when(turn, F.col("go")).otherwise(F.col("community")).alias("community"), "k"))
        reached = quality(tried)
        if reached > best + 1e-9:
            now, best, idle, moved = tried, reached, 0, True
        else:
            idle += 1
            if idle == 2:  # neither half has anything to gain
                break
    return now.select("id", "community") if moved else None


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Newman's modularity of the undirected simple graph; one row comes to the driver."""
    simple = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a != b").distinct()
    ends = simple.select(F.explode(F.array("a", "b")).alias("id")).join(communities, "id").groupBy("community").agg(F.count(F.lit(1)).alias("d"))
    inner = simple.join(communities.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inner = inner.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("e"))
    total = simple.count()
    if not total:
        return 0.0
    row = ends.join(inner, "community", "left").agg(F.sum(F.coalesce("e", F.lit(0)) / total - F.pow(F.col("d") / (2.0 * total), 2)).alias("q")).first()
    return float(row["q"])


def ordered_ranks(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
