"""Mixing sources to target weights by a min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources that hold them) and the
   sources' targets are found by water-filling: sources share the corpus by weight, none gets more
   than CAP times its own size, and what is cut off is shared among the others by weight.
2. A flow network runs from patterns to sources. A pattern offers its words once for each
   repetition, at convex costs 0, 1, 2, ...: an arc of one copy's words at each cost. A source
   takes up to its target. The cheapest largest flow says how often each pattern is repeated for
   each source. It is solved on the driver over patterns and sources, never over documents.
3. Whole repetitions take every document of the pattern. A partial one takes documents in the
   order of a seeded hash: documents are dealt to hash ranges whose sums fix where the quota falls,
   and only that range is cumulated, so no source is ever gathered in one task. One more document,
   the one whose size is closest to what is still missing, ends the selection.

Defined cases: a null text has size 0, so it is taken once at most; a null source is a source of
its own and sorts last; sources of size 0 get target 0; repeated rows share one fate, since the
seed hashes the id and the text's hash; null or empty members are the null source; an empty table gives
an empty result. Very long texts are only counted. Other columns are carried only where the caller
asks, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.llm.common import hash_long, materialize

CAP = 3
WEIGHTS = (1, 2, 3)
RANGES = 512
#: Patterns and sources the flow may have; more raise an error rather than lose any.
MAX_NODES = 200_000
SPACE_RUN = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], total: int | None = None) -> dict[str | None, float]:
    """The target of each source: WEIGHTS repeating in code-point order, null last, water-filled below CAP sizes.

    total is what they share: the sizes of all documents, each once; by default the sum of sizes.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = float(sum(size.values()) if total is None else total), [s for s, _ in order], {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > CAP * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(CAP * size[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(supply: list[int], demand: list[int], arcs: list[tuple[int, int]], copies: int = CAP) -> dict[tuple[int, int, int], int]:
    """Words that pattern i sends to source j in its repetition k: {(i, j, k): words}, as a largest flow of least cost.

    supply[i] words are offered `copies` times at costs 0, 1, ..., copies - 1; source j takes demand[j].
    Successive shortest paths with potentials over the residual network.
    """
    n = 2 + len(supply) * (copies + 1) + len(demand)
    graph: list[list[list]] = [[] for _ in range(n)]

    def arc(a: int, b: int, cap: int, cost: int) -> list:
        e, back = [b, cap, cost, None], [a, 0, -cost, None]
        e[3], back[3] = back, e
        graph[a].append(e)
        graph[b].append(back)
        return e

    tier = lambda i, k: 2 + i * (copies + 1) + k
    sink = lambda j: 2 + len(supply) * (copies + 1) + j
    for i, s in enumerate(supply):
        for k in range(copies):
            arc(0, tier(i, k), s, k)
    used = {(i, j, k): arc(tier(i, k), sink(j), supply[i], 0) for i, j in arcs for k in range(copies)}
    for j, d in enumerate(demand):
        arc(sink(j), 1, d, 0)
    height = [0] * n
    while True:
        dist, via = [float("inf")] * n, [None] * n
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in graph[a]:
                if e[1] > 0 and (to := d + e[2] + height[a] - height[e[0]]) < dist[e[0]]:
                    dist[e[0]], via[e[0]] = to, e
                    heapq.heappush(heap, (to, e[0]))
        if via[1] is None:
            return {key: e[3][1] for key, e in used.items() if e[3][1]}
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, dist, strict=True)]
        path, at = [], 1
        while at:
            path.append(via[at])
            at = via[at][3][0]
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            e[3][1] += room


def _members(found: Column) -> Column:
    """The distinct sources in order, null last; of none the null source."""
    found = F.array_distinct(F.coalesce(found, F.array().cast("array<string>")).cast("array<string>"))
    return F.when(F.size(found) > 0, F.sort_array(found)).otherwise(F.array(F.lit(None).cast("string")))


def mix(docs: DataFrame, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, seed: str = "mix") -> DataFrame:
    """One row per row: id, row_ (a struct of the carried columns), size, source_size, target, taken, copies.

    members: an array column of the sources that hold the document; by default its one source. Null or
    empty members are the null source. source_size and target are those of the row's own source, null
    if no document is a member of it.
    """
    spark = docs.sparkSession
    keep = ["row_"] if carry else []
    row = [F.struct(*carry).alias("row_")] if carry else []
    ties = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    whole = docs.select(
        F.col(id_col), *row, n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("src_"), _members(F.array(source_col) if members is None else members).alias("mem_"),
        hash_long(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")), ties).alias("h_"),
    ).withColumn("pat_", F.to_json(F.struct(F.col("mem_").alias("m")))).withColumn("range_", F.floor(F.col("h_") / (2**60 // RANGES)))
    # The narrow columns are read several times, so they are kept; texts are read once more at most.
    rows = materialize(whole.drop(*keep), "mix")
    patterns = rows.groupBy("pat_").agg(F.first("mem_").alias("mem"), F.sum("size").alias("n")).limit(MAX_NODES + 1).collect()
    sources = rows.select(F.explode_outer("mem_").alias("src"), "size").groupBy("src").agg(F.sum("size").alias("n")).limit(MAX_NODES + 1).collect()
    if max(len(patterns), len(sources)) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns or sources")
    patterns = sorted(patterns, key=lambda r: r["pat_"])
    sizes = [(r["src"], int(r["n"] or 0)) for r in sources]
    target = targets(sizes, sum(int(p["n"] or 0) for p in patterns))
    names = [s for s, _ in sizes]
    index = {s: j for j, s in enumerate(names)}
    arcs = [(i, index[s]) for i, p in enumerate(patterns) for s in p["mem"]]
    flow = min_cost_flow([int(p["n"] or 0) for p in patterns], [round(target[s]) for s in names], arcs)
    quota = [0] * len(patterns)
    for (i, _, _), words in flow.items():
        quota[i] += words
    plan = [(p["pat_"], *divmod(q, int(p["n"]))) if p["n"] else (p["pat_"], 0, 0) for p, q in zip(patterns, quota, strict=True)]
    plan = spark.createDataFrame(plan, "pat_ string, whole_ long, part_ long")
    table = spark.createDataFrame([(s, n, float(target[s])) for s, n in sizes], "of_ string, source_size long, target double")
    # Where the quota of the partial repetition falls: first in the sums of hash ranges, then in one range.
    sums = rows.join(F.broadcast(plan.where("part_ > 0")), "pat_").groupBy("pat_", "range_", "part_").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pat_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before_", F.coalesce(before, F.lit(0))).where("before_ <= part_ and before_ + n > part_")
    ends = sums.select("pat_", F.col("range_").alias("cut_"), "before_", "part_")  # one row a pattern
    within = rows.join(F.broadcast(ends), "pat_").where("range_ = cut_").groupBy("pat_", "cut_", "h_", "before_", "part_").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pat_", "cut_").orderBy("h_")) + F.col("before_")
    last = within.withColumn("upto", upto).where("upto <= part_").groupBy("pat_").agg(F.max("h_").alias("last_"), F.max("upto").alias("got_"))
    ends = ends.join(last, "pat_", "left").select("pat_", "cut_", F.coalesce("last_", F.lit(-1)).alias("last_"), F.coalesce("got_", "before_").alias("got_"))
    ends = materialize(ends, "cuts")

    def chosen(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(plan), "pat_").join(F.broadcast(ends), "pat_", "left")
        taken = (F.col("range_") < F.col("cut_")) | ((F.col("range_") == F.col("cut_")) & (F.col("h_") <= F.col("last_")))
        return df.withColumn("chosen_", F.coalesce(taken, F.lit(False)))

    lack = F.col("part_") - F.col("got_")
    extra = chosen(rows).where("part_ > 0 and not chosen_ and size > 0").where(F.abs(F.col("size") - lack) < lack)
    extra = extra.groupBy("pat_").agg(F.min_by("h_", F.struct(F.abs(F.col("size") - lack), "h_")).alias("extra_"))
    rows = chosen(whole if keep else rows).join(F.broadcast(extra), "pat_", "left")
    copies = F.col("whole_") + F.when(F.col("chosen_") | F.coalesce(F.col("h_") == F.col("extra_"), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("copies_", F.when(F.col("size") > 0, F.least(copies, F.lit(CAP))).otherwise(F.least(copies, F.lit(1)))).join(F.broadcast(table), F.col("src_").eqNullSafe(F.col("of_")), "left")
    return rows.select(id_col, *keep, "size", "source_size", "target", (F.col("copies_") * F.col("size")).cast("long").alias("taken"), F.col("copies_").cast("int").alias("copies"))
