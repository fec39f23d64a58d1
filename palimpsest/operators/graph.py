"""The association graph: breadth-first exploration from any number of roots at once, and reinforcement of what was visited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schema import DIRECTIONS
from ..sinks.scratch import saved
from .numbering import numbered


FIELDS = ("kind", "content", "importance", "associations")
WAY = "array<struct<dir:int,pos:bigint>>"

#: Links from which on a node's list is shared by the roots that come to it, ids that a root may have met before that, ids
#: in a row of such a list, and pairs of a task.  None of them leaves anything out.
HEAVY, FEW, BLOCK, TASK_PAIRS = 64, 256, 1024, 4_000_000


def nodes(events: DataFrame, knowledge: DataFrame | None = None, order: str = "ord", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(id, *fields, ord)``: events by ids ``evt_``, entries by ids ``ke_``; of equal ids the first.

    fields: those of FIELDS that are wanted; contents that nobody asks for are neither read nor shuffled.
    """

    def shape(df: DataFrame, kind: str, prefix: str) -> DataFrame:
        of = {"kind": F.lit(kind), "content": F.col("content"), "importance": F.col("importance").cast("double"), "associations": F.coalesce("associations", F.array().cast("array<string>"))}
        return df.where(F.col("id").startswith(prefix)).select("id", *(of[f].alias(f) for f in fields), F.col(order).alias("ord"))

    every = shape(events, "event", "evt_")
    if knowledge is not None:
        every = every.unionByName(shape(knowledge, "knowledge", "ke_"))
    if not fields:
        return every.groupBy("id").agg(F.min("ord").alias("ord"))
    first = every.groupBy("id").agg(F.min_by(F.struct(*fields), "ord").alias("x"), F.min("ord").alias("ord"))
    return first.select("id", *(f"x.{c}" for c in fields), "ord")


def edges(events: DataFrame, knowledge: DataFrame | None = None, direction: str = "both", order: str = "ord") -> DataFrame:
    """``(src, dst, dir, pos)``: links out of events and entries (dir 0, in list order), and into events (dir 1, in event order).

    Only ``forward`` leaves out the latter: ``backward`` follows links both ways, as ``both`` does.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    given = nodes(events, knowledge, order, ("associations",))
    out = given.select(F.col("id").alias("src"), F.posexplode("associations").alias("pos", "dst")).select("src", "dst", F.lit(0).alias("dir"), F.col("pos").cast("long").alias("pos"))
    if direction == "forward":
        return out
    # Every event counts, also a later one of an id that was there before.
    back = events.where(F.col("associations").isNotNull()).select(F.col("id").alias("dst"), F.explode("associations").alias("src"), F.col(order).cast("long").alias("pos"))
    return out.unionByName(back.select("src", "dst", F.lit(1).alias("dir"), "pos"))


def _hop(step: DataFrame, links: DataFrame, before: list[DataFrame], ways: bool) -> DataFrame:
    """``(root, id, known)``, with ways ``at``: where the links of ``step`` ``(root, src)`` lead to first, without what was met before.

    What was met before goes through the same exchange as what is met now, so that an aggregation tells them apart.
    """
    way = [F.concat("at", F.array(F.struct(F.col("dir").cast("int").alias("dir"), F.col("pos").cast("long").alias("pos")))).alias("at")] if ways else []
    now = step.join(links, "src").select("root", F.col("dst").alias("id"), "known", *way, F.lit(False).alias("old"))
    none = [F.lit(None).cast(WAY).alias("at")] if ways else []
    every = reduce(DataFrame.unionByName, (b.select("root", "id", "known", *none, F.lit(True).alias("old")) for b in before), now)
    met = every.groupBy("root", "id").agg(F.bool_or("known").alias("known"), *([F.min("at").alias("at")] if ways else []), F.bool_or("old").alias("old"))
    return met.where("not old").drop("old")


def _walk(roots: DataFrame, node_table: DataFrame, edge_table: DataFrame, depth: int, ways: bool) -> tuple[list[DataFrame], DataFrame]:
    """All hops before the last, each written once, and the links, which know whether a node has the id that they lead to.

    roots: ``(root, id)``.
    """
    ids = node_table.select("id", F.lit(True).alias("__known"))
    known = F.coalesce("__known", F.lit(False)).alias("known")
    links = edge_table.join(ids.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", *(["dir", "pos"] if ways else []), known)
    links = saved(links, "links")
    start = [F.array().cast(WAY).alias("at")] if ways else []
    hops = [saved(roots.select("root", "id").distinct().join(ids, "id", "left").select("root", "id", known, *start), "hop0")]
    for hop in range(1, depth):
        hops.append(saved(_hop(_frontier(hops), links, hops, ways), f"hop{hop}"))
    return hops, links


def _frontier(hops: list[DataFrame]) -> DataFrame:
    return hops[-1].where("known").withColumnRenamed("id", "src").drop("known")


def explore_all(roots: DataFrame, node_table: DataFrame, edge_table: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two tables ``(root, id, depth, at)`` of what lies within ``depth`` links of each root: nodes, and ids that no node has.

    roots: ``(root)``.  A node counts once for each root, where it is met first.  An id that no node has is visited but not
    followed.  ``at`` is the way there, a ``(dir, pos)`` for each link: among nodes of one depth it sorts as a queue would meet
    them, so that nothing has to be numbered on the way.  All roots go through a hop together, by joins on the node id; each hop
    is written once, and the next reads the hops before it instead of planning them again.
    """
    hops, links = _walk(roots.select("root", F.col("root").alias("id")), node_table, edge_table, depth + 1, True)
    every = reduce(DataFrame.unionByName, (h.withColumn("depth", F.lit(k)) for k, h in enumerate(hops))).select("root", "id", "depth", "at", "known")
    return every.where("known").drop("known"), every.where("not known").drop("known")


def reached(sources: DataFrame, node_table: DataFrame, edge_table: DataFrame, depth: int = 2) -> DataFrame:
    """``(id)``: what lies within ``depth`` links of any of the sources ``(id)``, each once, whether a node has it or not.

    The sources go together as one, so that an id is met once and not for each source.
    """
    hops, _ = _walk(sources.select(F.lit("").alias("root"), "id"), node_table, edge_table, depth + 1, False)
    return reduce(DataFrame.unionByName, hops).select("id")


class _Last:
    """The last hop of :func:`explore`, of which pairs that go by a long list of links aren't made before they are wanted.

    Where many roots meet a node of many links, their pairs grow as roots times links, while what differs between roots is little:
    which ids of that list a root has met otherwise.  So these lists are numbered once (``members``), and a root has a row for each
    list that it comes to (``runs``), with the places that it skips.  All else is ``near``, found pair by pair.

    A root that comes to several lists takes of each what those before it, by ``at``, don't have: that is a list of its own, made
    once for all roots that come to the same.  Roots that have met more than FEW ids already are near as a whole.
    """

    def __init__(self, hops: list[DataFrame], links: DataFrame, ways: bool, known: bool, heavy: int | None):
        self.hops = [h.where(F.col("known") == known) for h in hops]
        front, self.runs = _frontier(hops), None
        to = links.where(F.col("known") == known)
        near = lambda step: _hop(step, to, self.hops, ways).drop("known")
        lists = saved(links.groupBy("src").count().where(F.col("count") > heavy).select("src"), "heavy") if heavy is not None and len(hops) > 1 else None
        if lists is None or lists.isEmpty():
            self.near = near(front)
            return
        full = reduce(DataFrame.unionByName, hops).groupBy("root").count().where(F.col("count") > FEW)
        order = Window.partitionBy("root").orderBy("at" if ways else "src").rowsBetween(Window.unboundedPreceding, -1)
        wide = front.join(lists, "src", "left_semi").join(full, "root", "left_anti")
        wide = saved(wide.withColumn("earlier", F.array_sort(F.collect_list("src").over(order))), "wide")
        lists = saved(wide.select("src", "earlier").distinct().withColumn("list", F.monotonically_increasing_id()), "lists")
        step = F.struct("dir", "pos") if ways else F.struct(F.lit(0).alias("dir"), F.lit(0).alias("pos"))
        own = lists.join(to, "src").groupBy("list", F.col("dst").alias("id")).agg(F.min(step).alias("step")).select("list", "id", "step.dir", "step.pos")
        gone = lists.select("list", F.explode("earlier").alias("src")).join(to, "src").select("list", F.col("dst").alias("id"))
        self.members = saved(numbered(own.join(gone, ["list", "id"], "left_anti"), ("list",), ("dir", "pos", "id")), "members")
        mine = saved(wide.join(lists, ["src", "earlier"]).drop("earlier"), "mine")
        found = saved(near(front.join(mine.select("root", "src"), ["root", "src"], "left_anti")), "near")
        # What a root has met otherwise and meets on a list too: the first of both ways counts.
        at = F.col("at").alias("__at") if ways else F.lit(None).alias("__at")
        other = reduce(DataFrame.unionByName, (h.select("root", "id", F.lit(None).alias("__at")) for h in self.hops), found.select("root", "id", at))
        here = F.concat("at", F.array(F.struct(F.col("dir").cast("int").alias("dir"), F.col("pos").cast("long").alias("pos")))) if ways else None
        late = F.coalesce(F.col("__at") > here, F.lit(False)) if ways else F.lit(False)
        both = saved(mine.join(other, "root").join(self.members, ["list", "id"]).select("root", "list", "id", "seq", late.alias("late")), "both")
        self.near = found.join(both.where("late").select("root", "id"), ["root", "id"], "left_anti")
        skips = both.where("not late").groupBy("root", "list").agg(F.array_sort(F.collect_list("seq")).alias("skips"))
        sizes = self.members.groupBy("list").agg(F.count("*").alias("size"))
        runs = mine.join(sizes, "list").join(skips, ["root", "list"], "left").withColumn("skips", F.coalesce("skips", F.array().cast("array<bigint>")))
        self.runs = saved(runs.withColumn("n", F.col("size") - F.size("skips")), "runs")

    def placed(self) -> None:
        """Give ``near`` the column ``ord``, the place in the level, and ``runs`` the column ``before``: how many of it come before."""
        if self.runs is None:
            self.near = numbered(self.near, ("root",), ("at",), "ord")
            return
        runs, near = self.runs.select("root", "at", "n", "list", "size", "skips"), self.near.join(self.runs, "root", "left_semi")
        rest = numbered(self.near.join(self.runs, "root", "left_anti"), ("root",), ("at",), "ord")
        items = near.select("root", "at", "id", F.lit(1).cast("long").alias("n")).unionByName(runs, allowMissingColumns=True)
        order = Window.partitionBy("root").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # FEW lists, and links of nodes that are none
        items = saved(items.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "items")
        self.runs = items.where("list is not null").drop("id")
        self.near = rest.unionByName(items.where("list is null").select("root", "id", "at", (F.col("before") + 1).alias("ord")), allowMissingColumns=True)

    def pairs(self, ways: bool, places: bool, about: DataFrame | None) -> DataFrame:
        """``(root, id)`` of the runs, with ``at``, ``ord`` and the columns of about: lists in blocks, of which a root takes slices."""
        fields = [c for c in about.columns if c != "id"] if about is not None else []
        members = self.members.join(about, "id") if about is not None else self.members
        block = F.floor((F.col("seq") - 1) / BLOCK).alias("block")
        item = F.struct("seq", "id", *(["dir", "pos"] if ways else []), *fields)
        blocks = saved(members.groupBy("list", block).agg(F.array_sort(F.collect_list(item)).alias("items")), "blocks")
        total = self.runs.agg(F.sum("n")).first()[0] or 0
        parts = min(20_000, max(int(self.runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_PAIRS))
        ends = F.concat(F.array(F.lit(0).cast("long")), "skips", F.array(F.col("size") + 1))
        gap = lambda i: F.struct((F.get(ends, i) + 1).alias("lo"), (F.get(ends, i + 1) - 1).alias("hi"), i.alias("skipped"))
        kept = (["at"] if ways else []) + (["before"] if places else [])
        part = self.runs.select("root", "list", *kept, F.explode(F.transform(F.sequence(F.lit(0), F.size("skips")), gap)).alias("gap")).where("gap.lo <= gap.hi")
        at = lambda seq: F.floor((seq - 1) / BLOCK)
        part = part.select("root", "list", *kept, "gap.*", F.explode(F.sequence(at(F.col("gap.lo")), at(F.col("gap.hi")))).alias("block"))
        first = F.col("block") * BLOCK
        lo, hi = F.greatest("lo", first + 1), F.least("hi", first + BLOCK)
        part = part.select("root", "list", "block", *kept, "skipped", (lo - first).cast("int").alias("lo"), (hi - lo + 1).cast("int").alias("len"))
        part, blocks = part.repartition(parts, "list", "block"), blocks.repartition(parts, "list", "block")
        every = part.join(blocks, ["list", "block"]).select("root", *kept, "skipped", F.explode(F.slice("items", F.col("lo"), F.col("len"))).alias("x"))
        way = [F.concat("at", F.array(F.struct(F.col("x.dir").cast("int").alias("dir"), F.col("x.pos").cast("long").alias("pos")))).alias("at")] if ways else []
        place = [(F.col("before") + F.col("x.seq") - F.col("skipped")).alias("ord")] if places else []
        return every.select("root", "x.id", *way, *place, *(f"x.{c}" for c in fields))


def explore(
    roots: DataFrame, node_table: DataFrame, edge_table: DataFrame, depth: int = 2, emit_dangling: bool = False, ways: bool = True, places: bool = False, about: DataFrame | None = None, heavy: int | None = HEAVY
) -> DataFrame:
    """The nodes of :func:`explore_all`, or with ``emit_dangling`` the ids that no node has.

    The last hop isn't written, and pairs by lists of more than ``heavy`` links (None: none are) come one by one as they are read.
    ways: with ``at``, which costs an array for each pair.  places: with ``ord``, as :func:`ordered` gives it.  about: a table by
    ``id``, whose columns come with each node; ids that it hasn't go.
    """
    known, at = not emit_dangling, ways or places
    hops, links = _walk(roots.select("root", F.col("root").alias("id")), node_table, edge_table, depth, at)
    if not depth:
        last = None
    else:
        last = _Last(hops, links, at, known, heavy)
        if places:
            last.placed()
    single = [h.where(F.col("known") == known).drop("known") for h in hops]
    if places:
        single = [numbered(h, ("root",), ("at",), "ord") for h in single]
    kept = ["root", "id", "depth", *(["at"] if ways else []), *(["ord"] if places else [])]
    every = [h.withColumn("depth", F.lit(k)).select(*kept) for k, h in enumerate([*single, *([last.near] if last else [])])]
    out = reduce(DataFrame.unionByName, every)
    if about is not None:
        out = out.join(about, "id")
    if last and last.runs is not None:
        out = out.unionByName(last.pairs(ways, places, about).withColumn("depth", F.lit(depth)).select(*kept, *(c for c in about.columns if c != "id") if about is not None else ()))
    return out


def visited(roots: DataFrame, node_table: DataFrame, edge_table: DataFrame, depth: int = 2, heavy: int | None = HEAVY) -> DataFrame:
    """``(root, n_visited)``: how many nodes :func:`explore` finds, of which those on long lists aren't made but counted."""
    hops, links = _walk(roots.select("root", F.col("root").alias("id")), node_table, edge_table, depth, False)
    parts = [h.where("known") for h in hops]
    if depth:
        last = _Last(hops, links, False, True, heavy)
        parts.append(last.near)
        if last.runs is not None:
            parts.append(last.runs)
    ones = [p.select("root", (F.col("n") if "n" in p.columns else F.lit(1)).cast("long").alias("n")) for p in parts]
    return reduce(DataFrame.unionByName, ones).groupBy("root").agg(F.sum("n").alias("n_visited"))


def ordered(found: DataFrame) -> DataFrame:
    """With ``ord``: the place of each node in its level, from 1 for each (root, depth)."""
    return numbered(found, ("root", "depth"), ("at",), "ord")


def described(found: DataFrame, node_table: DataFrame, search: float = X.DEFAULT_SEARCH) -> DataFrame:
    """``(root, id, depth, at, kind, content, importance, associations, score)``: contents cut at 300 characters, scored."""
    return found.join(about(node_table, search), "id").select("root", "id", "depth", "at", "kind", "content", "importance", "associations", "score")


def about(node_table: DataFrame, search: float = X.DEFAULT_SEARCH) -> DataFrame:
    """``(id, kind, content, importance, associations, score)``: what an exploration says of a node, whichever the root."""
    return node_table.select("id", "kind", X.shortened("content").alias("content"), "importance", "associations", X.compute_score("importance", F.size("associations"), search).alias("score"))


def ranked(scored: DataFrame, *tie: str, score: str = "score") -> DataFrame:
    """By falling score; equal ones keep their given order."""
    return scored.orderBy(F.desc(score), *tie)


def reinforce(events: DataFrame, visited: DataFrame) -> DataFrame:
    """The events with a score of 1 where they were visited and had less, and ``reinforced`` telling which."""
    met = visited.select(F.col("id").alias("__id")).distinct().withColumn("__met", F.lit(True))
    hit = F.coalesce(F.col("__met"), F.lit(False)) & F.coalesce(F.col("decay_score") < 1.0, F.lit(False))
    df = events.join(met, F.col("id") == F.col("__id"), "left").withColumn("reinforced", hit)
    return df.withColumn("decay_score", F.when(F.col("reinforced"), F.lit(1.0)).otherwise(F.col("decay_score"))).drop("__id", "__met")


#: The lines of a graph as text.
GRAPH_NONE = "No entry found for ID: {}"
GRAPH_HEAD = "Association graph from {} (depth: {}, direction: {}):"
GRAPH_NODE, GRAPH_LINKS = "[{0.kind}] {0.id} (imp: {0.importance:g}, score: {0.score:g})", " → [{}]"
GRAPH_FOOT = "Nodes visited: {} | Decay scores reinforced"


def render(rows: list, root: str, depth: int, direction: str) -> str:
    """The graph as indented text; ``rows`` are those of :func:`described` for one root, in order."""
    if not rows:
        return GRAPH_NONE.format(root)
    blocks = [GRAPH_HEAD.format(root, depth, direction)]
    for r in rows:
        pad = "  " * r.depth
        links = GRAPH_LINKS.format(", ".join(r.associations)) if r.associations else ""
        blocks.append(f"{pad}{GRAPH_NODE.format(r)}{links}\n{pad}  {r.content}")
    return "\n\n".join([*blocks, GRAPH_FOOT.format(len(rows))])
