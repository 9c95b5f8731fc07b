"""Splits that keep related records together.

Records are joined into components by shared entities and by links between entities. The components live in a
persisted table (`write`, `read`) that each batch extends, with the number of records that each node has had so far: links are contracted to components, merged by hooking each component to
the least one it is linked with, and pointers are doubled until every component points at its root, so that a chain of
n links takes about log n rounds. Existing components keep their split, a merge of components with different splits
is quarantined, and new components fill what the splits lack of the records of all batches together.

Defined results: records without entity are components of their own; repeated records and links count once; links
from or to null, and from an entity to itself, say nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

COMPONENT_SCHEMA = "node string, component string, split string, quarantined boolean, n long"
BUCKETS = 4096  # of the running sum over new components; what the driver sees is bounded by it


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): the least node of each connected component, for every node of a real link."""
    e = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = cut(e)
    parent = cut(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root")))
    while True:
        # pointers are doubled until each node points at a root
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parent = cut(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")))
            moved = parent.where("moved").limit(1).count()
            parent = parent.select("node", "root")
            if not moved:
                break
        # links within a component are done with; the others hook the greater root to the least root beside it
        e = (
            e.join(parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(parent.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        e = cut(e)
        if not e.limit(1).count():
            return parent
        hooks = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least"))
        parent = cut(parent.join(hooks, "node", "left").select("node", F.coalesce("least", "root").alias("root")))


def extend(known: DataFrame | None, records: DataFrame, links: DataFrame, shares: DataFrame) -> DataFrame:
    """The component table after a batch.

    known: the persisted table so far (node, component, split, quarantined, n) or None. records(node, n): entities of the
    batch with the records it brings, those of earlier batches left out. links(a, b). shares(split_name, share).
    Gives (node, component, split, quarantined, n, is_new): n counts the records of all batches, is_new marks components that
    no earlier batch held. A quarantined component keeps its nodes together, has no split, and stays quarantined.
    """
    spark = records.sparkSession
    known = known if known is not None else spark.createDataFrame([], COMPONENT_SCHEMA)
    known = known.select("node", "component", "split", "quarantined", F.col("n").alias("held"))
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    here = records.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    nodes = here.join(ends, "node", "full").join(known, "node", "full")
    # every node with its present component; a node not seen before is its own
    nodes = cut(nodes.select("node", F.coalesce("component", "node").alias("old"), "split", F.coalesce("quarantined", F.lit(False)).alias("quarantined"), (F.coalesce("n", F.lit(0)) + F.coalesce("held", F.lit(0))).alias("n"), F.col("component").isNull().alias("unseen")))
    of = nodes.select("node", "old")
    contracted = links.join(of.select(F.col("node").alias("a"), F.col("old").alias("oa")), "a").join(of.select(F.col("node").alias("b"), F.col("old").alias("ob")), "b").select(F.col("oa").alias("a"), F.col("ob").alias("b"))
    roots = components(contracted)
    whole = nodes.join(roots.select(F.col("node").alias("old"), "root"), "old", "left").withColumn("component", F.coalesce("root", "old")).drop("root")
    state = whole.groupBy("component").agg(
        F.sum("n").alias("size"), F.min("split").alias("lo"), F.max("split").alias("hi"), F.bool_or("quarantined").alias("was"), F.bool_and("unseen").alias("fresh")
    )
    state = cut(state.select("component", "size", F.when((F.col("lo") == F.col("hi")) & ~F.col("was"), F.col("lo")).alias("split"), (F.col("was") | (F.col("lo") != F.col("hi"))).alias("quarantined"), "fresh").withColumn("quarantined", F.coalesce("quarantined", F.lit(False))))
    placed = _fill(state, nodes, shares)
    out = whole.select("node", "component", "n").join(placed, "component")
    return out.select("node", "component", "split", "quarantined", "n", F.col("fresh").alias("is_new"))


def write(table: DataFrame, path: str) -> None:
    """Persists a component table at a path, for the next batch."""
    table.select("node", "component", "split", "quarantined", "n").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPONENT_SCHEMA).parquet(path)


def _fill(state: DataFrame, nodes: DataFrame, shares: DataFrame) -> DataFrame:
    """Splits for the components without one, so that the records of all batches come close to the shares.

    Components of at least a 1/BUCKETS of the records are placed one by one where most is lacking (there are at most
    BUCKETS of them). The rest are put in order of a hash; the running sum of their records, taken in two levels,
    is cut at the remaining deficits.
    """
    spark = state.sparkSession
    goal = {r["split_name"]: max(0.0, float(r["share"] or 0)) for r in shares.where("split_name is not null").dropDuplicates(["split_name"]).collect()}
    scale = sum(goal.values()) or 1.0
    have = {r["split"]: r["n"] for r in state.where("split is not null").groupBy("split").agg(F.sum("size").alias("n")).collect()}
    new = state.where("split is null and not quarantined")
    total_new = new.agg(F.sum("size").alias("n")).first()["n"] or 0
    total = sum(have.values()) + total_new
    lack = {k: v / scale * total - have.get(k, 0) for k, v in sorted(goal.items())}
    least = max(2, -(-max(total_new, 1) // BUCKETS))
    large = new.where(F.col("size") >= least).orderBy(F.desc("size"), "component").select("component", "size").limit(BUCKETS).collect()
    at = []
    for r in large:
        k = max(lack, key=lambda x: (lack[x], x)) if lack else None
        at.append((r["component"], k))
        if k is not None:
            lack[k] -= r["size"]
    placed_large = spark.createDataFrame(at, "component string, chosen string")
    rest = new.where(F.col("size") < least).select("component", "size", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).alias("bucket"), F.xxhash64(F.lit(1), "component").alias("h"))
    sums = {r["bucket"]: r["n"] for r in rest.groupBy("bucket").agg(F.sum("size").alias("n")).collect()}
    before, run = [], 0
    for b in sorted(sums):
        before.append((b, run))
        run += sums[b]
    free = {k: max(0.0, v) for k, v in lack.items()}
    room = sum(free.values()) or 1.0
    cuts, edge = [], 0.0
    for k, v in free.items():
        edge += v / room * run
        cuts.append((edge, k))
    offset = F.broadcast(spark.createDataFrame(before, "bucket long, before long"))  # BUCKETS rows at most
    w = W.partitionBy("bucket").orderBy("h", "component").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(w) - F.col("size") / 2
    choice = F.lit(cuts[-1][1]) if cuts else F.lit(None).cast("string")
    for edge, k in reversed(cuts[:-1]):
        choice = F.when(F.col("middle") < edge, F.lit(k)).otherwise(choice)
    placed_rest = rest.join(offset, "bucket").withColumn("middle", middle).select("component", choice.alias("chosen"))
    chosen = placed_large.unionByName(placed_rest)
    return state.join(chosen, "component", "left").select("component", F.coalesce("split", "chosen").alias("split"), "quarantined", "fresh")
