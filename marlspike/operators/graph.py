"""Import graphs: resolution, roll-ups, folder edges, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.operators.iterate import cut

#: What may follow a specifier to make a file, in order of preference.
CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


#: Steps that marks take between two looks at whether any still moves.
STEPS = 3


def package(specifier: Column) -> Column:
    """The package of an import: two parts if scoped, else one."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def safe_id(name: Column) -> Column:
    """A name as part of an identifier, in lower case: what lies between runs of letters, digits and underscores becomes one minus."""
    return F.lower(F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9_]+", "-"), F.lit("-")))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``source, target, is_external`` of ``imports(source, specifier)`` among ``files(path)``.

    Relative specifiers meet the files under each candidate ending, the first
    that exists wins, and those that fit none are dropped. An alias replaces the
    start of a specifier; anything else is an external package. Endings are taken off
    the files, of which few fit a path, not tried on every import.
    """
    spec = F.col("specifier")
    for start, place in (aliases or {}).items():
        spec = F.when(F.col("specifier").startswith(start), F.concat(F.lit(place), F.substr(F.col("specifier"), F.lit(len(start) + 1)))).otherwise(spec)
    d = imports.withColumn("spec", spec)
    relative = F.col("spec").startswith(".")
    joined = F.when(relative, F.concat_ws("/", folder(F.col("source")), "spec")).otherwise(F.col("spec"))
    clean = F.regexp_replace(F.regexp_replace(F.col("path0"), r"/\./", "/"), r"^\./", "")
    # each of eight steps takes out one pair of a folder and what leaves it
    step = lambda x, _: F.when(F.contains(x, F.lit("../")), F.regexp_replace(x, r"[^/]+/\.\./", "")).otherwise(x)
    clean = F.aggregate(F.sequence(F.lit(1), F.lit(8)), clean, step)
    aliased = F.col("spec") != F.col("specifier")
    d = d.withColumn("path0", joined).withColumn("inside", relative | aliased)
    met = d.filter("inside").select("source", F.when(F.contains("path0", F.lit("./")), clean).otherwise(F.col("path0")).alias("path0"))
    ends = [F.when(F.col("path").endswith(e), F.struct(F.substring("path", F.lit(1), F.length("path") - len(e)).alias("path0"), F.lit(i).alias("priority"))) for i, e in enumerate(CANDIDATES)]
    tried = files.select("path", F.inline(F.filter(F.array(*ends), lambda x: x.isNotNull())))
    best = tried.groupBy("path0").agg(F.min_by("path", "priority").alias("target"))
    found = met.join(best, "path0")
    outside = d.filter("not inside").select("source", package(F.col("specifier")).alias("target"), F.lit(True).alias("is_external"))
    return found.select("source", "target", F.lit(False).alias("is_external")).unionByName(outside).distinct()


def folder_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between the folders of files that import each other."""
    d = edges.filter("not is_external").select(folder(F.col("source")).alias("source_dir"), folder(F.col("target")).alias("target_dir"))
    return d.filter("source_dir <> target_dir").distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node that reaches itself; component is one node of its strong component.

    Nodes without an edge in or out cannot be on a cycle and are trimmed, round
    by round. The rest is coloured: each node takes the greatest node that
    reaches it, and the nodes of a colour that reach that node are one strong
    component; what is left is trimmed and coloured again. Rows stay in
    proportion to the edges: no pairs of nodes that reach each other are made.
    """
    every = cut(edges.select("source", "target").distinct())
    core = cut(every.filter("source <> target"))
    found = cut(every.limit(0).select(F.col("source").alias("node"), F.col("source").alias("component")))
    while not (core := _trimmed(core)).isEmpty():
        nodes = core.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = _settled(nodes.withColumn("mark", F.col("node")), core)
        inside = cut(_within(core, colour))
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        # from each root, which has the colour's own name, against the edges
        reached = cut(_settled(colour.withColumn("mark", F.when(F.col("node") == F.col("mark"), F.col("mark"))), back).filter("mark is not null"))
        cyclic = reached.join(inside.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
        found = cut(found.unionByName(cyclic.select("node", F.col("mark").alias("component"))))
        gone = reached.select("node")
        core = cut(core.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
    loops = every.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    return found.unionByName(loops.join(found, "node", "left_anti"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """``node`` for every node that reaches itself."""
    return strong_components(edges).select("node")


def circular(edges: DataFrame) -> DataFrame:
    """``source, target, circular``: whether a way leads back, that is, whether both ends are in one strong component."""
    of = strong_components(edges)
    d = edges.select("source", "target").distinct().join(of.select(F.col("node").alias("source"), F.col("component").alias("c1")), "source", "left")
    d = d.join(of.select(F.col("node").alias("target"), F.col("component").alias("c2")), "target", "left")
    return d.select("source", "target", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)).alias("circular"))


def short_cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """``path, size`` of every closed path of two to ``longest`` different nodes, once, from its least node.

    Paths grow only over greater nodes than their first, a step at a time.
    """
    inside = cut(edges.select("source", "target").filter("source <> target").distinct())
    paths = cut(inside.filter("source < target").select(F.array(F.col("source").cast("string"), F.col("target").cast("string")).alias("p"), F.col("source").alias("first"), F.col("target").alias("last")))
    out, step = None, inside.select(F.col("source").alias("last"), F.col("target").alias("next"))
    for size in range(2, longest + 1):
        grown = paths.join(step, "last")
        closed = grown.filter("next = first").select(F.concat_ws(" > ", "p", F.col("next").cast("string")).alias("path"), F.lit(size).cast("bigint").alias("size"))
        out = closed if out is None else out.unionByName(closed)
        if size < longest:
            more = grown.withColumn("name", F.col("next").cast("string")).filter((F.col("next") > F.col("first")) & ~F.array_contains("p", F.col("name")))
            paths = cut(more.select(F.concat("p", F.array("name")).alias("p"), "first", F.col("next").alias("last")))
    return out


def cycle_cover(edges: DataFrame) -> DataFrame:
    """``source, target, path``: for every edge that lies on a cycle a closed path over it, of any length, without a node twice.

    In each strong component a tree of shortest ways leads from its root to all nodes
    and another from all nodes to it, grown level by level. An edge (u, v) is
    closed by the way from v toward the root up to the first node that is on the way from the
    root to u. Paths are as long as the trees are deep. The path begins with its
    least node; a loop is a path of one node.
    """
    every = edges.select("source", "target").distinct()
    of = cut(strong_components(every))
    d = every.join(of.select(F.col("node").alias("source"), F.col("component").alias("c1")), "source")
    d = d.join(of.select(F.col("node").alias("target"), F.col("component").alias("c2")), "target")
    inside = cut(d.filter((F.col("c1") == F.col("c2")) & (F.col("source") != F.col("target"))).select("source", "target"))
    ahead = _ways(of, inside.select("source", "target"))
    back = _ways(of, inside.select(F.col("target").alias("source"), F.col("source").alias("target")))
    met = inside.join(ahead.select(F.col("node").alias("source"), F.col("way").alias("down")), "source").join(back.select(F.col("node").alias("target"), F.reverse("way").alias("up")), "target")
    first = F.array_position("up", F.get(F.filter("up", lambda x: F.array_contains("down", x)), F.lit(0)))
    met = met.withColumn("tail", F.slice("up", F.lit(1), first.cast("int")))  # from v to where it meets the way to u
    met = met.withColumn("head", F.slice("down", F.array_position("down", F.element_at("tail", -1)).cast("int") + 1, F.size("down")))
    ring = F.concat("tail", "head")  # v ... meeting node ... u, and back to v
    least = F.array_position(ring, F.array_min(ring)).cast("int")
    turned = F.concat(F.slice(ring, least, F.size(ring)), F.slice(ring, F.lit(1), least - 1))
    loops = every.filter("source = target").select("source", "target", F.array("source").alias("path"))
    return met.select("source", "target", turned.alias("path")).unionByName(loops)


def _ways(of: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, way``: a shortest way from the root of each strong component, which its name is, to each of its nodes; of equally short ones the least."""
    roots = of.filter("node = component").select("node", F.array("node").alias("way"))
    seen = cut(roots)
    frontier = seen
    while not frontier.isEmpty():
        grown = frontier.join(edges.withColumnRenamed("source", "node"), "node").groupBy("target").agg(F.min("way").alias("way"))
        new = grown.join(seen.select(F.col("node").alias("target")), "target", "left_anti")
        frontier = cut(new.select(F.col("target").alias("node"), F.concat("way", F.array("target")).alias("way")))
        seen = seen.unionByName(frontier)
    return seen


def _trimmed(core: DataFrame) -> DataFrame:
    n = core.count()
    while n:
        kept = core.join(core.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = kept.join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        core = cut(kept.select("source", "target"))
        if (m := core.count()) == n:
            break
        n = m
    return core


def _within(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges between nodes of one colour."""
    d = edges.join(colour.select(F.col("node").alias("source"), F.col("mark").alias("c1")), "source")
    return d.join(colour.select(F.col("node").alias("target"), F.col("mark").alias("c2")), "target").filter("c1 = c2").select("source", "target")


def _settled(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, mark`` when each node's mark is the greatest of its own and of those that reach it along the edges."""
    now = cut(marks.select("node", "mark"))
    while True:
        following = now.withColumn("was", F.col("mark"))
        for _ in range(STEPS):
            sent = edges.join(following.filter("mark is not null").select(F.col("node").alias("source"), "mark"), "source").groupBy(F.col("target").alias("node")).agg(F.max("mark").alias("got"))
            following = following.join(sent, "node", "left").select("node", F.greatest("mark", "got").alias("mark"), "was")
        following = cut(following)
        if following.filter("not (mark <=> was)").isEmpty():
            return now
        now = following.drop("was")
