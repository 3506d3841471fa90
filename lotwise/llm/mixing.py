"""P9: combining overlapping sources to target shares of tokens.

Records (distinct texts) are aggregated by the set of sources that hold a copy; a
min-cost flow routes the token capacity of these patterns to the sources' quotas,
repetitions costing more the further they go; seeded records fill each flow.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import cut

DEFAULT_TOKENIZER = os.environ.get("LOTWISE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the published splitting pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``df`` plus the number of tokens of ``text`` (0 for NULL and empty) in place of the text: a narrow Arrow map. The vocabulary file (about a megabyte) is read by the driver and sent along."""
    keep = [c for c in df.columns if c not in (text, out)]
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, out])

    schema = df.select(*keep).schema.add(out, "long")
    return df.select(*keep, text).mapInArrow(run, schema)


class MinCostFlow:
    """Successive shortest paths with potentials; integer capacities and costs."""

    def __init__(self, n: int):
        self.graph: list[list[list[int]]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> tuple[int, int]:
        self.graph[a].append([b, capacity, cost, len(self.graph[b])])
        self.graph[b].append([a, 0, -cost, len(self.graph[a]) - 1])
        return a, len(self.graph[a]) - 1

    def used(self, arc: tuple[int, int]) -> int:
        b, _, _, back = self.graph[arc[0]][arc[1]]
        return self.graph[b][back][1]

    def run(self, s: int, t: int) -> tuple[int, int]:
        """(flow, cost) of the maximum flow of least cost."""
        n, flow, total = len(self.graph), 0, 0
        potential = [0] * n
        while True:
            distance, before = [1 << 62] * n, [None] * n
            distance[s] = 0
            queue = [(0, s)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > distance[a]:
                    continue
                for k, (b, capacity, cost, _) in enumerate(self.graph[a]):
                    nd = d + cost + potential[a] - potential[b]
                    if capacity > 0 and nd < distance[b]:
                        distance[b], before[b] = nd, (a, k)
                        heapq.heappush(queue, (nd, b))
            if before[t] is None:
                return flow, total
            potential = [p + d if d < 1 << 62 else p for p, d in zip(potential, distance, strict=True)]
            push, b = 1 << 62, t
            while b != s:
                a, k = before[b]
                push, b = min(push, self.graph[a][k][1]), a
            b = t
            while b != s:
                a, k = before[b]
                arc = self.graph[a][k]
                arc[1] -= push
                self.graph[b][arc[3]][1] += push
                total += push * arc[2]
                b = a
            flow += push


def plan(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], budget: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source.

    The k-th use of a pattern's tokens costs k - 1, so repetition starts only when
    first uses are exhausted; a source takes at most max_repeats times a pattern's
    tokens, and a pattern gives at most the largest max_repeats of its sources.
    Without a budget the total is the largest whose quotas can all be filled.
    """
    names, keys = sorted(targets), sorted(patterns)

    def solve(total: int) -> tuple[int, MinCostFlow, dict]:
        net = MinCostFlow(2 + len(keys) + len(names))
        arcs = {}
        for i, p in enumerate(keys):
            for k in range(max(targets[s][1] for s in p)):
                net.add(0, 2 + i, patterns[p], k)
            for s in p:
                arcs[p, s] = net.add(2 + i, 2 + len(keys) + names.index(s), patterns[p] * targets[s][1], 0)
        for j, s in enumerate(names):
            net.add(2 + len(keys) + j, 1, int(total * targets[s][0]), 0)
        return net.run(0, 1)[0], net, arcs

    if budget is None:
        low, high = 0, sum(n * max(targets[s][1] for s in p) for p, n in patterns.items())
        while low < high:
            middle = (low + high + 1) // 2
            quota = sum(int(middle * share) for share, _ in targets.values())
            low, high = (middle, high) if solve(middle)[0] == quota else (low, middle - 1)
        budget = low
    _, net, arcs = solve(budget)
    return {k: f for k, a in arcs.items() if (f := net.used(a)) > 0}


def records(documents: DataFrame, targets: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(record_id, pattern, n_tokens): one row per distinct text; pattern is the sorted list of target sources that hold a copy, record_id the smallest doc_id."""
    named = documents.where("source IS NOT NULL AND text IS NOT NULL AND text <> ''").join(F.broadcast(_checked(targets)).select("source"), "source")
    rows = with_tokens(named.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text"), "text", "n_tokens", tokenizer)
    return rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("record_id"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0").select("record_id", "pattern", "n_tokens")


def _checked(targets: DataFrame, most: int = 1000) -> DataFrame:
    """The targets, once it is known that they are few enough to send to every task."""
    good = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    if good.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sources in the targets")
    return good


def mixture(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, tokenizer: str = DEFAULT_TOKENIZER, most_patterns: int = 100_000) -> DataFrame:
    """(doc_id, source, repeats, n_tokens): the chosen records, how often each is used and for which source.

    Each flow of pattern p to source s is a stretch of the line that p's records
    make when laid end to end, again and again, in an order by seeded hash; a
    record is used as often as it starts in the stretch. The line's offsets come
    from 4,096 hash buckets whose token sums are aggregated first, so no pattern,
    however large, is sorted in one task. Documents without text, source or target
    take no part. An empty corpus gives no rows. Records are told apart by the set of
    sources that hold them; more than ``most_patterns`` such sets are an error.
    """
    spark = documents.sparkSession
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in _checked(targets).collect()}
    total_share = sum(s for s, _ in goal.values()) or 1.0
    goal = {k: (s / total_share, m) for k, (s, m) in goal.items()}
    recs = cut(records(documents, targets, tokenizer).withColumn("h", F.xxhash64(F.lit(seed), "record_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    sums = recs.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))
    found = sums.groupBy("pattern").agg(F.sum("t").alias("t")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} sets of sources share records")
    patterns = {tuple(r["pattern"]): int(r["t"]) for r in found}
    flows = plan(patterns, goal, budget) if patterns else {}
    # stretches [start, stop) of each pattern's line, one after the other
    rows, at = [], {}
    for (p, s), f in sorted(flows.items()):
        start = at.get(p, 0)
        rows.append((list(p), s, start, start + f, patterns[p]))
        at[p] = start + f
    stretches = spark.createDataFrame(rows, "pattern array<string>, source string, start long, stop long, size long")
    offset = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = recs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offset, ["pattern", "bucket"]).withColumn("x", F.col("before") + F.col("inner"))
    # starts x, x + size, x + 2 size ... that fall into [start, stop)
    below = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("x")) / F.col("size")))
    used = placed.join(F.broadcast(stretches), "pattern").withColumn("repeats", (below("stop") - below("start")).cast("int"))
    return used.where("repeats > 0").select(F.col("record_id").alias("doc_id"), "source", "repeats", "n_tokens")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_records, n_uses, n_tokens, actual_share): what each source contributes; sources that give nothing are kept with zeros."""
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("repeats").alias("n_uses"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("n_tokens"))
    total = Window.partitionBy(F.lit(1))  # one row per source
    out = _checked(targets).join(got, "source", "left").fillna(0, ["n_records", "n_uses", "n_tokens"])
    return out.withColumn("actual_share", F.round(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(total), F.lit(0)), 6)).select("source", "target_share", "n_records", "n_uses", "n_tokens", "actual_share")
