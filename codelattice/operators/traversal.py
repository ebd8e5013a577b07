"""Callers, callees, reachability and paths over edge tables.

Closures grow by rounds: the frontier is joined to the edges, what is new is kept. Every few rounds the state is written to the
shared folder (a reliable checkpoint), which keeps plans short and survives lost executors. Rounds end when nothing is new; a
depth bound holds only where the caller gives one. A round's size is checked with a count, nothing else reaches the driver. Paths
are searched from the side that has fewer ends, and made for the pairs that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.session import cut, stored


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(root, node, depth)``: what each root reaches over ``edges`` (src, dst), itself at depth 0, with the least depth."""
    e = edges.select("src", "dst").distinct()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("root", F.col("node").alias("src")).join(e, "src").select("root", F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if depth % 5 == 0:
            seen = cut(seen)
        frontier = new
    return seen


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: what the start nodes reach, themselves included."""
    e = edges.select("src", "dst").distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if depth % 5 == 0:
            seen = cut(seen)
        frontier = new
    return seen


def reachable_sql(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """The same by a recursive query; the depth bound makes it end on cycles."""
    spark = edges.sparkSession
    edges.select("src", "dst").distinct().createOrReplaceTempView("_reach_edges")
    return spark.sql(
        f"WITH RECURSIVE r(node, depth) AS (SELECT {start} AS node, 0 AS depth UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN _reach_edges e ON e.src = r.node WHERE r.depth < {int(max_depth)}) "
        "SELECT node, min(depth) AS depth FROM r GROUP BY node"
    )


def transitive_callers(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: all that reach the start nodes."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_depth)


def find_path(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(src, dst, path)``: the shortest path of each pair, of several the one that comes first by its nodes; pairs without one are left out.

    With no more destinations than sources, each destination's search goes back over the edges and keeps one next node for each
    (destination, node); the pairs then walk along. Otherwise whole paths grow from the sources.
    """
    pairs = cut(pairs.select("src", "dst"))
    ends = pairs.agg(F.countDistinct("src").alias("src"), F.countDistinct("dst").alias("dst")).first()
    if ends["dst"] > ends["src"]:
        seen = paths_from(edges, pairs.select(F.col("src").alias("root")), max_depth)
        return pairs.join(seen, (pairs["src"] == seen["root"]) & (pairs["dst"] == seen["node"])).select(pairs["src"], pairs["dst"], "path")
    walk = pairs.dropna().select("src", F.col("dst").alias("root"), F.col("src").alias("node"), F.array("src").alias("path"))
    for i, level in enumerate(reversed(steps_to(edges, pairs.select(F.col("dst").alias("root")), max_depth)), 1):
        on = F.col("next").isNotNull()
        walk = walk.join(level, ["root", "node"], "left").select("src", "root", F.coalesce("next", "node").alias("node"), F.when(on, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
        if i % 5 == 0:
            walk = cut(walk)
    return walk.where("node = root").select("src", F.col("root").alias("dst"), "path")


def steps_to(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> list[DataFrame]:
    """``(root, node, next)`` for each distance from 1: the nodes from which the root is that far, and the least next node of a shortest path there."""
    e = stored(edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).dropna().distinct(), "edges")
    front = roots.select("root").dropna().distinct().withColumn("node", F.col("root"))
    seen, levels = [(0, front)], []
    while max_depth is None or len(levels) < max_depth:
        step = front.join(e, F.col("node") == F.col("_b")).groupBy("root", F.col("_a").alias("node")).agg(F.min("_b").alias("next"))
        new = stored(step.join(_union(x for _, x in seen), ["root", "node"], "left_anti"), "steps")
        if new.isEmpty():
            break
        levels.append(new)
        front = new.select("root", "node")
        seen.append((0, front))
        while len(seen) > 5 and seen[-5][0] == seen[-1][0]:  # five of a size become one: few parts, and each row is written again only so often
            seen[-5:] = [(seen[-1][0] + 1, cut(_union(x for _, x in seen[-5:])))]
    return levels


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def paths_from(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(root, node, path)``: the shortest path from each root to each node it reaches, of several the first by its nodes."""
    e = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).distinct()
    front = roots.select("root").distinct().withColumns({"node": F.col("root"), "path": F.array("root")})
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, F.col("node") == F.col("_a")).select("root", F.col("_b").alias("node"), F.concat("path", F.array("_b")).alias("path"))
        step = step.groupBy("root", "node").agg(F.min("path").alias("path"))
        new = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if depth % 5 == 0:
            seen = cut(seen)
        front = new
    return seen


def callers(call_sites: DataFrame, edges: DataFrame, functions: DataFrame, fqn: str) -> DataFrame:
    """Known functions that call ``fqn``, each with its first call site: (caller, file, call_line, call_column)."""
    short = fqn.rpartition(".")[2]
    who = edges.where(F.col("callee") == fqn).select("caller").distinct().join(functions.select(F.col("fqn").alias("caller"), "file"), "caller")
    at = call_sites.where((F.col("target_fqn") == fqn) | (F.col("target") == short)).groupBy(F.col("caller_fqn").alias("caller")).agg(F.min(F.struct("line", "col")).alias("_at"))
    return who.join(at, "caller", "left").select("caller", "file", F.col("_at.line").alias("call_line"), F.col("_at.col").alias("call_column"))


def callees(call_sites: DataFrame, functions: DataFrame, fqn: str) -> DataFrame:
    """The call sites of a function with file and line of what they call."""
    f = functions.select(F.col("fqn").alias("target_fqn"), F.col("file").alias("target_file"), F.col("line").alias("target_line"))
    return call_sites.where(F.col("caller_fqn") == fqn).join(f, "target_fqn", "left").select("target", "target_fqn", "line", "resolved", "target_file", "target_line")


def callee_counts(call_sites: DataFrame) -> DataFrame:
    """Call sites, resolved and unresolved ones, by function."""
    r = F.coalesce(F.col("resolved"), F.lit(False))
    return call_sites.groupBy("caller_fqn").agg(F.count("*").alias("calls"), F.count_if(r).alias("resolved"), F.count_if(~r).alias("unresolved"))


def call_details(call_sites: DataFrame, caller: str, callee: str) -> DataFrame:
    """The first call site of ``caller`` whose target holds ``callee``."""
    hit = F.contains(F.col("target"), F.lit(callee)) | F.contains(F.coalesce(F.col("target_fqn"), F.lit("")), F.lit(callee))
    return call_sites.where((F.col("caller_fqn") == caller) & hit).orderBy("line", "target", "target_fqn").limit(1)


def traverse(edges: DataFrame, start: str, direction: str = "both", max_depth: int = 10) -> DataFrame:
    """``(node, depth, direction)``: what stands up- and downstream of a node in a dependency graph (src depends on dst)."""
    spark = edges.sparkSession
    root = spark.createDataFrame([(start,)], "node string")
    out = []
    if direction in ("up", "both"):
        out.append(reachable(edges, root, max_depth).where("depth > 0").withColumn("direction", F.lit("up")))
    if direction in ("down", "both"):
        out.append(transitive_callers(edges, root, max_depth).where("depth > 0").withColumn("direction", F.lit("down")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def dependency_chain(traversed: DataFrame, start: str) -> DataFrame:
    """One line: upstream nodes from the farthest, the node, downstream nodes. ``traversed`` is bounded by its depth and one node's graph."""
    order = F.when(F.col("direction") == "up", -F.col("depth")).otherwise(F.col("depth"))
    rows = traversed.select(order.alias("_o"), "node").unionByName(traversed.sparkSession.createDataFrame([(0, start)], "_o int, node string"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("_o", "node"))).alias("_all")).select(F.array_join(F.transform("_all", lambda x: x["node"]), " -> ").alias("chain"))


def dep_graph_compose(props: DataFrame) -> DataFrame:
    """``(file, src, dst)``: a service and one it depends on, from ``depends_on`` in list or map form."""
    items = props.where(F.col("prop_key") == "depends_on").withColumn("_d", F.explode("prop_items"))
    return items.select(F.col("file_path").alias("file"), F.col("service").alias("src"), F.regexp_extract("_d", r"^([^=:]+)", 1).alias("dst")).distinct()


def dep_graph_dockerfile(instructions: DataFrame) -> DataFrame:
    """``(file, src, dst)``: a stage and the stage that it copies from or builds on; stages are named by alias, else ``stage-N``."""
    from codelattice.operators.container import docker_stages

    st = docker_stages(instructions)
    name = F.when(F.coalesce("alias", F.lit("")) != "", F.col("alias")).otherwise(F.concat(F.lit("stage-"), F.col("stage_index")))
    stages = st.select("file", "stage_index", name.alias("stage"), F.col("image").alias("_image"), "start_line", "end_line")
    copies = instructions.where((F.col("instruction") == "COPY") & (F.coalesce("copy_from", F.lit("")) != "")).select("file", "line", "copy_from")
    inside = copies.join(stages, (copies["file"] == stages["file"]) & copies["line"].between(stages["start_line"], stages["end_line"])).drop(copies["file"])
    by_index = stages.select(F.col("file").alias("_f"), F.col("stage_index").cast("string").alias("_ref"), F.col("stage").alias("_to"))
    by_name = stages.select(F.col("file").alias("_f"), F.col("stage").alias("_ref"), F.col("stage").alias("_to"))
    names = by_index.unionByName(by_name).distinct()
    a = inside.join(names, (F.col("file") == F.col("_f")) & (F.col("copy_from") == F.col("_ref")), "left").select("file", F.col("stage").alias("src"), F.coalesce("_to", "copy_from").alias("dst"))
    b = stages.join(by_name, (F.col("file") == F.col("_f")) & (F.col("_image") == F.col("_ref"))).select("file", F.col("stage").alias("src"), F.col("_to").alias("dst"))
    return a.unionByName(b).where("src <> dst").distinct()
