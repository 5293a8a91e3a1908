"""Branches of skeleton graphs as relations: contraction of chains, spur pruning and shape measures.

A graph is a table of edges (keys, a, b) and one of vertices (keys, v, z, y, x); the keys name
one skeleton. Every edge is two darts, one for each direction. Beyond a vertex with two edges a
dart goes on as exactly one other dart; rounds of pointer doubling find the last dart of each
run and its distance, so a chain of n edges takes log2(n) rounds, each written to the shared
folder. No task holds a skeleton, a chain or an instance.

Defined results: repeated edges and edges from a vertex to itself count once and never; null
keys or ends drop the edge; a closed loop without a junction is a chain only where its whole
graph has no end and no junction (then the graph counts one branch); a graph without edges has
0 branches, length 0 and no tortuosity; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granula.functions.storage import stored, unsent

KEYS = ("object_id", "entity", "label")
#: Points to either side and passes of the moving mean that takes the steps of voxels out of a chain.
WINDOW, PASSES = 2, 2
#: Ends shorter than so many radii of their junction are spurs.
SPUR_FACTOR = 2.0
CHAIN = ["s", "s1", "t1", "t"]


def darts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): each edge in both directions, once."""
    kept = edges.where(F.col("a") != F.col("b")).select(*keys, "a", "b").dropna()
    return kept.union(kept.select(*keys, "b", "a")).distinct()


def degrees(both: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, degree) of all vertices with an edge."""
    return both.groupBy(*keys, F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def _ranked(both: DataFrame, degree: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, a, b, ea, eb, steps): the last dart of the run of each dart and the steps to it; darts of closed loops are left out."""
    inner = degree.where("degree = 2").select(*keys, F.col("v").alias("b"))
    through = both.join(inner, [*keys, "b"], "left_semi")
    out = both.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
    onward = through.join(out, [*keys, "b"]).where(F.col("a") != F.col("c"))
    ends = both.join(inner, [*keys, "b"], "left_anti")
    none = F.lit(0).cast("long")
    state = ends.select(*keys, "a", "b", F.col("a").alias("ea"), F.col("b").alias("eb"), none.alias("steps"), F.lit(True).alias("done"))
    state = state.union(onward.select(*keys, "a", "b", F.col("b").alias("ea"), F.col("c").alias("eb"), (none + 1).alias("steps"), F.lit(False).alias("done")))
    state = stored(state, f"{name}-runs")
    open_ = state.where("not done").count()
    while open_:
        ahead = state.select(*keys, F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("ea").alias("fa"), F.col("eb").alias("fb"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        moved = state.where("not done").join(ahead, [*keys, "ea", "eb"]).select(*keys, "a", "b", F.col("fa").alias("ea"), F.col("fb").alias("eb"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        state = stored(state.where("done").unionByName(moved), f"{name}-runs")
        left = state.where("not done").count()
        if left == open_:  # only closed loops go on
            break
        open_ = left
    return state.where("done").drop("done")


def chains(edges: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, name: str = "chains", degree: DataFrame | None = None) -> DataFrame:
    """(keys, s, s1, t1, t, n, pos, a, b): the darts of every maximal run between vertices whose degree is not 2.

    A run goes from s by s1 to t1 and t, n edges long, in the one of its two directions whose
    (s, s1) is not after (t, t1); a dart a -> b has its head at place ``pos`` from 1 to n.
    ``degree`` (keys, v, degree) gives the degrees where ``edges`` are not all of the graph's.
    """
    keys = list(keys)
    both = stored(darts(edges, keys), f"{name}-darts")
    found = _ranked(both, stored(degrees(both, keys), f"{name}-degrees") if degree is None else degree, keys, name)
    back = found.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), F.col("eb").alias("s"), F.col("ea").alias("s1"), F.col("steps").alias("before"))
    whole = found.join(back, [*keys, "a", "b"]).select(
        *keys, "s", "s1", F.col("ea").alias("t1"), F.col("eb").alias("t"), (F.col("steps") + F.col("before") + 1).alias("n"), (F.col("before") + 1).alias("pos"), "a", "b"
    )
    return whole.where(F.struct("s", "s1") <= F.struct(F.col("t"), F.col("t1")))


def _apart(p: str, q: str, axes: tuple[str, ...] = ("z", "y", "x")) -> Column:
    return F.sqrt(sum(((F.col(f"{p}{a}") - F.col(f"{q}{a}")) * (F.col(f"{p}{a}") - F.col(f"{q}{a}")) for a in axes), F.lit(0.0)))


def _at(rows: DataFrame, vertices: DataFrame, keys: list[str], vertex: str, prefix: str) -> DataFrame:
    """``rows`` with the place of the vertex in column ``vertex`` as prefix + z, y, x."""
    places = vertices.select(*keys, F.col("v").alias(vertex), *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in "zyx"])
    return rows.join(unsent(places), [*keys, vertex])


def points(runs: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, s1, t1, t, n, pos, z, y, x): the vertices of every run in order, from place 0."""
    heads = runs.select(*keys, *CHAIN, "n", "pos", F.col("b").alias("v"))
    first = runs.where("pos = 1").select(*keys, *CHAIN, "n", F.lit(0).cast("long").alias("pos"), F.col("s").alias("v"))
    return _at(heads.union(first), vertices, keys, "v", "").drop("v")


def smoothed(line: DataFrame, keys: list[str], window: int = WINDOW, passes: int = PASSES) -> DataFrame:
    """``line`` (as of points()) after moving means over ``window`` points to either side; the ends stay.

    A point is sent to the places it adds to and added up there, so a run of any length is
    dealt over all tasks.
    """
    inner = F.filter(F.sequence(F.col("pos") - window, F.col("pos") + window), lambda p: (p > 0) & (p < F.col("n")))
    own = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), F.array("pos")).otherwise(F.array().cast("array<bigint>"))
    for _ in range(passes):
        sent = line.select(*keys, *CHAIN, "n", F.explode(F.concat(inner, own)).alias("pos"), "z", "y", "x")
        line = sent.groupBy(*keys, *CHAIN, "n", "pos").agg(*[F.avg(c).alias(c) for c in "zyx"])
    return line


def shapes(runs: DataFrame, vertices: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, name: str = "shapes") -> DataFrame:
    """(keys, s, s1, t1, t, n, length_um, arc_um, chord_um): a row for each run; arc and chord are those of the smoothed line."""
    keys = list(keys)
    line = stored(points(runs, vertices, keys), f"{name}-points")
    soft = stored(smoothed(line, keys), f"{name}-smooth")

    def arcs(rows: DataFrame, value: str) -> DataFrame:
        ahead = rows.select(*keys, *CHAIN, (F.col("pos") - 1).alias("pos"), *[F.col(c).alias(f"q{c}") for c in "zyx"])
        here = rows.select(*keys, *CHAIN, "pos", *[F.col(c).alias(f"p{c}") for c in "zyx"])
        return here.join(ahead, [*keys, *CHAIN, "pos"]).groupBy(*keys, *CHAIN).agg(F.sum(_apart("p", "q")).alias(value))

    end = lambda at, p: line.where(at).select(*keys, *CHAIN, "n", *[F.col(c).alias(f"{p}{c}") for c in "zyx"])
    chord = end(F.col("pos") == 0, "p").join(end(F.col("pos") == F.col("n"), "q"), [*keys, *CHAIN, "n"]).select(*keys, *CHAIN, "n", _apart("p", "q").alias("chord_um"))
    return chord.join(unsent(arcs(line, "length_um")), [*keys, *CHAIN]).join(unsent(arcs(soft, "arc_um")), [*keys, *CHAIN]).select(*keys, *CHAIN, "n", "length_um", "arc_um", "chord_um")


def dense_shapes(edges: DataFrame, vertices: DataFrame, degree: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, name: str = "dense") -> DataFrame:
    """shapes() of graphs with far more edges than vertices; edges (keys, a, b, gap_um, degree_a, degree_b), a < b, come once and know the degrees of their ends.

    An edge between two vertices whose degree is not 2 is a run of its own, and arc and chord
    are its length. Only edges at a vertex of degree 2, at most two for each, are contracted;
    the others are neither written nor shuffled.
    """
    keys = list(keys)
    inner = (F.col("degree_a") == 2) | (F.col("degree_b") == 2)
    one = F.lit(1).cast("long").alias("n")
    short = edges.where(~inner).select(*keys, F.col("a").alias("s"), F.col("b").alias("s1"), F.col("a").alias("t1"), F.col("b").alias("t"), one, *[F.col("gap_um").alias(c) for c in ("length_um", "arc_um", "chord_um")])
    runs = stored(chains(edges.where(inner).select(*keys, "a", "b"), keys, name, degree), f"{name}-chains")
    return short.unionByName(shapes(runs, vertices, keys, name))


def dense_metrics(edges: DataFrame, vertices: DataFrame, degree: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, name: str = "dense") -> DataFrame:
    """metrics() of the graphs of dense_shapes(); edges meet their sums before any shuffle."""
    keys = list(keys)
    return _measured(dense_shapes(edges, vertices, degree, keys, name), edges.groupBy(*keys).agg(F.sum("gap_um").alias("__length")), vertices, keys)


def metrics(edges: DataFrame, vertices: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, name: str = "skeleton") -> DataFrame:
    """(keys, instance_branches, instance_length_um, instance_tortuosity) of every graph that has a vertex.

    Tortuosity is the arc-weighted mean of arc over chord; runs that end where they began have no chord.
    """
    keys = list(keys)
    edges = stored(edges.select(*keys, "a", "b"), f"{name}-edges")
    runs = stored(chains(edges, keys, name), f"{name}-chains")
    once = darts(edges, keys).where(F.col("a") < F.col("b"))
    cable = _at(_at(once, vertices, keys, "a", "p"), vertices, keys, "b", "q").groupBy(*keys).agg(F.sum(_apart("p", "q")).alias("__length"))
    return _measured(shapes(runs, vertices, keys, name), cable, vertices, keys)


def _measured(found: DataFrame, cable: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of metrics() from the shapes of all runs and the length of all edges."""
    open_ = (F.col("chord_um") > 0) & (F.col("arc_um") > 0)
    each = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__runs"), F.sum(F.when(open_, F.col("arc_um"))).alias("__arc"), F.sum(F.when(open_, F.col("arc_um") * F.col("arc_um") / F.col("chord_um"))).alias("__bent")
    )
    out = vertices.select(*keys).distinct().join(unsent(cable), keys, "left").join(unsent(each), keys, "left")
    branches = F.when(F.col("__length").isNull(), 0).otherwise(F.coalesce(F.col("__runs"), F.lit(1)))
    return out.select(
        *keys, branches.cast("int").alias("instance_branches"), F.coalesce("__length", F.lit(0.0)).alias("instance_length_um"), (F.col("__bent") / F.col("__arc")).alias("instance_tortuosity")
    )


def _spurs(runs: DataFrame, degree: DataFrame, vertices: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, s, s1, t1, t): those of ``runs`` that a round of pruned() cuts."""
    radius = vertices.select(*keys, F.col("v").alias("t"), F.col("radius").cast("double").alias("radius"))
    # both ends of a run can be its free end, so each run is read from the end that is one
    far = degree.select(*keys, F.col("v").alias("t"), F.col("degree").alias("arms"))
    near = degree.where("degree = 1").select(*keys, F.col("v").alias("s"))
    sized = _at(_at(runs, vertices, keys, "a", "p"), vertices, keys, "b", "q").groupBy(*keys, *CHAIN).agg(F.sum(_apart("p", "q")).alias("length"))
    turned = sized.select(*keys, F.col("t").alias("s"), F.col("t1").alias("s1"), F.col("s1").alias("t1"), F.col("s").alias("t"), "length", F.lit(True).alias("turned"))
    ways = sized.select(*keys, *CHAIN, "length", F.lit(False).alias("turned")).unionByName(turned)
    spurs = ways.join(near, [*keys, "s"], "left_semi").join(far.where("arms > 2"), [*keys, "t"]).join(unsent(radius), [*keys, "t"]).where(F.col("length") < F.lit(float(factor)) * F.col("radius"))
    order = W.partitionBy(*keys, "t").orderBy("length", "s")
    cut = spurs.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= F.col("arms") - 2)
    as_run = lambda c, d: F.when(F.col("turned"), F.col(d)).otherwise(F.col(c)).alias(c)
    return cut.select(*keys, as_run("s", "t"), as_run("s1", "t1"), as_run("t1", "s1"), as_run("t", "s"))


def pruned(edges: DataFrame, vertices: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, factor: float = SPUR_FACTOR, name: str = "pruned") -> DataFrame:
    """(keys, a, b), a < b: ``edges`` without spurs; ``vertices`` have a ``radius``, too.

    A spur is a run from an end to a junction, shorter than ``factor`` radii at the junction. In
    a round each junction cuts its shortest spurs (ties by the end) and keeps two arms; spurs
    of different junctions share no edge, so all are cut at once. What is left is contracted
    again, in the graphs that a round changed, until no spur is left. A factor of 0 keeps all.
    """
    keys = list(keys)
    live = stored(darts(edges, keys).where(F.col("a") < F.col("b")), f"{name}-live")
    settled: DataFrame | None = None
    if factor > 0:  # only graphs with a junction have spurs
        forked = stored(degrees(darts(live, keys), keys).where("degree > 2").select(*keys).distinct(), f"{name}-forked")
        settled, live = live.join(forked, keys, "left_anti"), stored(live.join(forked, keys, "left_semi"), f"{name}-live")
    while factor > 0:
        both = darts(live, keys)
        degree = stored(degrees(both, keys), f"{name}-degree")
        runs = stored(chains(live, keys, name), f"{name}-chains")
        cut = stored(_spurs(runs, degree, vertices, keys, factor), f"{name}-cut")
        if cut.isEmpty():
            break
        gone = runs.join(cut, [*keys, *CHAIN], "left_semi").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        changed = cut.select(*keys).distinct()
        still = live.join(changed, keys, "left_anti")
        settled = still if settled is None else settled.union(still)
        live = stored(live.join(changed, keys, "left_semi").join(gone, [*keys, "a", "b"], "left_anti"), f"{name}-live")
    return live if settled is None else settled.union(live)


def dense_spurs(edges_at: Callable[[DataFrame], DataFrame], vertices: DataFrame, degree: DataFrame, keys: list[str] | tuple[str, ...] = KEYS, factor: float = SPUR_FACTOR, name: str = "spurs") -> DataFrame | None:
    """(keys, v): the vertices that pruned() leaves without an edge, in graphs with far more edges than vertices; None without any.

    Every edge of a spur has an end that the cut leaves bare, and a junction keeps two arms, so
    the edges that stay are those between all other vertices. A spur runs over vertices of
    degree 1 and 2 only: ``edges_at`` finds the edges (keys, a, b) at given vertices (keys, v)
    and is asked for those of at most two edges, and later for junctions that a round left with
    two. No other edge is written or shuffled.
    """
    keys = list(keys)
    light = degree.where("degree <= 2").select(*keys, "v")
    live = stored(edges_at(light).select(*keys, "a", "b").distinct(), f"{name}-live")
    bare: DataFrame | None = None
    while factor > 0:
        runs = stored(chains(live, keys, name, degree), f"{name}-chains")
        cut = stored(_spurs(runs, degree, vertices, keys, factor), f"{name}-cut")
        if cut.isEmpty():
            break
        gone = runs.join(cut, [*keys, *CHAIN], "left_semi").select(*keys, F.explode(F.array("a", "b")).alias("v"))
        lost = gone.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("lost"))
        left = stored(degree.join(unsent(lost), [*keys, "v"], "left").withColumn("left", F.col("degree") - F.coalesce("lost", F.lit(0))), f"{name}-left")
        out = left.where("lost is not null and degree <= 2").select(*keys, "v")
        bare = out if bare is None else bare.union(out)
        more = edges_at(left.where("degree > 2 and left <= 2").select(*keys, "v")).select(*keys, "a", "b")
        live = live.union(more).distinct()
        for end in "ab":
            live = live.join(unsent(bare.withColumnRenamed("v", end)), [*keys, end], "left_anti")
        live = stored(live.select(*keys, "a", "b"), f"{name}-live")
        degree = left.where("left > 0").select(*keys, "v", F.col("left").alias("degree"))
    return bare
