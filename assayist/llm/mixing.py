"""Mixing sources to target weights: min-cost flow over membership patterns, then a seeded choice of documents.

Equal texts are one *content*, which belongs to every source that holds a copy. Contents with the same set of sources form a
pattern; only the tokens by pattern (of a counted number) reach the driver. There a min-cost flow routes them to
the sources' quotas: using a pattern's tokens for the k-th time costs k - 1, so repetition is spread evenly and only where
it is needed, and a source takes no content more than its ``max_repeats`` times. On the cluster the flow of a pattern is
laid out along a tape: the contents in seeded order, once for each round of use; each stretch of the tape belongs to a
source. Places on the tape come from sums by bucket of the seeded hash, so no window holds a whole pattern.
"""

from __future__ import annotations

import os
from collections import deque

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayist.session import bounded, small, written

#: The tokenizer by default: a public byte-level BPE; any file of the ``tokenizers`` library will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BUCKETS = 4096
#: Sets of sources that hold a content: what the flow on the driver takes. More are refused, with a message.
PATTERNS = 20_000


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which the workers find a file of the driver's."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def token_counts(name: str):
    """An Arrow function that counts the tokens of whole texts by a tokenizer that was :func:`shipped`; null has none."""

    def run(texts: pa.Array) -> pa.Array:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if (t := _LOADED.get(name)) is None:
            t = _LOADED[name] = Tokenizer.from_file(SparkFiles.get(name))
            t.encode_special_tokens = True
        listed = texts.to_pylist()
        return pa.array([len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in listed], pa.int64())

    return F.arrow_udf(run, T.LongType())


_LOADED: dict = {}


class Flow:
    """Successive shortest paths for whole-number capacities and costs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist, via, queue, inside = {s: 0}, {}, deque([s]), {s}
            while queue:
                x = queue.popleft()
                inside.discard(x)
                for e in self.out.get(x, ()):
                    if self.cap[e] and (d := dist[x] + self.cost[e]) < dist.get(self.to[e], 1 << 60):
                        dist[self.to[e]], via[self.to[e]] = d, e
                        if self.to[e] not in inside:
                            inside.add(self.to[e])
                            queue.append(self.to[e])
            if t not in via:
                return total
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            f = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= f
                self.cap[e ^ 1] += f
            total += f


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens routed from each pattern to each source, for quotas of share * total; and their sum."""
    patterns = dict(sorted(patterns.items()))  # among flows of equal cost, always the same one
    g, names, arcs = Flow(), sorted(targets), {}
    node = {x: i + 2 for i, x in enumerate([*patterns, *names])}
    for p, tokens in patterns.items():
        for k in range(max(targets[s][1] for s in p)):
            g.arc(0, node[p], tokens, k)
        for s in p:
            arcs[p, s] = g.arc(node[p], node[s], tokens * targets[s][1])
    for s in names:
        g.arc(node[s], 1, int(targets[s][0] * total))
    done = g.run(0, 1)
    return done, {k: g.cap[e ^ 1] for k, e in arcs.items() if g.cap[e ^ 1]}


def largest_total(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total whose quotas can all be filled by the sources that hold any document."""
    held = {s for p in patterns for s in p}
    own = {s: v for s, v in targets.items() if s in held and v[0] > 0}
    if not own:
        return 0
    lo, hi = 0, sum(t * max(targets[s][1] for s in p) for p, t in patterns.items()) * 2
    kept = {tuple(s for s in p if s in own): 0 for p in patterns}
    for p, t in patterns.items():
        kept[tuple(s for s in p if s in own)] += t
    kept.pop((), None)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if route(kept, own, mid)[0] == sum(int(v[0] * mid) for v in own.values()):
            lo = mid
        else:
            hi = mid - 1
    return lo


def source_name(col):
    """One spelling of a source: lower case, trimmed, '_' for hyphens and blanks."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, times, tokens): how often each chosen document is used, for which source, and its size.

    ``docs``: doc_id, text, source; ``targets``: source, target_share, max_repeats. ``total``: tokens wanted; the largest that
    all quotas of the sources with documents can be filled for, unless given. Sources without a target and empty texts
    aren't used; a target without documents gets nothing. Copies are used through the smallest doc_id. A source is met up to
    one document at each end of its stretches.
    """
    plan = {source: (float(share), int(most)) for source, share, most in targets.filter("target_share > 0 and max_repeats > 0").select(source_name(F.col("source")), "target_share", "max_repeats").collect()}
    named = docs.filter(F.length("text") > 0).select("doc_id", source_name(F.col("source")).alias("source"), "text").filter(F.col("source").isin(list(plan)))
    # tokens are counted in the scan; only (doc_id, source, digest, tokens) is shuffled, never a text
    counted = named.select("doc_id", "source", F.unhex(F.md5("text")).alias("content"), token_counts(shipped(docs.sparkSession, tokenizer))("text").alias("tokens"))
    contents = counted.groupBy("content").agg(F.concat_ws("|", F.array_sort(F.collect_set("source"))).alias("pattern"), F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    sized = written(contents.select("doc_id", "pattern", "tokens"), "sized")
    order = F.xxhash64(F.lit(seed), "doc_id")
    sized = sized.filter("tokens > 0").select("*", order.alias("h"), F.pmod(F.shiftrightunsigned(order, 40).cast("int"), F.lit(BUCKETS)).alias("bucket"))
    per = bounded(sized.groupBy("pattern").agg(F.sum("tokens").alias("t")), PATTERNS)
    patterns = {tuple(r["pattern"].split("|")): int(r["t"]) for r in per.collect()}
    _, flows = route(patterns, plan, largest_total(patterns, plan) if total is None else total)
    tape, at = [], {}
    for (p, s), f in sorted(flows.items()):
        start = at.get(p, 0)
        at[p] = start + f
        tape.append(("|".join(p), s, start, start + f, patterns[p]))
    spark = docs.sparkSession
    stretches = spark.createDataFrame(tape, "pattern string, source string, start bigint, stop bigint, size bigint")
    sums = sized.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("pattern", "bucket", (F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id")) - F.col("tokens")
    placed = sized.select("doc_id", "pattern", "bucket", "tokens", inside.alias("inside")).join(before, ["pattern", "bucket"]).select("doc_id", "pattern", "tokens", (F.col("before") + F.col("inside")).alias("place"))
    # places of the document on the tape: place + k * size within [start, stop)
    low, high = F.greatest(F.ceil((F.col("start") - F.col("place")) / F.col("size")), F.lit(0)), F.ceil((F.col("stop") - F.col("place")) / F.col("size"))
    return placed.join(small(stretches), "pattern").select("doc_id", "source", (high - low).cast("bigint").alias("times"), "tokens").filter("times > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, n_documents, most_used) of a mix, a row for each target."""
    got = mix.groupBy("source").agg(F.sum(F.col("times") * F.col("tokens")).alias("tokens"), F.count("*").alias("n_documents"), F.max("times").alias("most_used"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(got, "source", "left").join(F.broadcast(all_)).select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens"), zero("n_documents"), zero("most_used"))
