"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by their membership pattern (the set of sources they
belong to). The flow network has a pattern's words once for each repetition, at
costs that rise with every repetition, and a source's target as its quota; the
cheapest flow says how many words of a pattern the mix takes. Within a pattern,
documents are taken whole in a seeded order: all of them `base` times, and once
more each one that fits into the rest of the flow; what is left at the end is
filled with smaller ones from behind.

Only pattern totals, sums of 256 ranges and a few documents at a cut reach the
driver, for each of the sources' combinations and whatever the number of documents.
The seeded order is never sorted: sums of ranges find where a cut falls, and the
range is divided until a few documents are left.

Edge cases: null and empty texts have size 0; a null source is a source; of rows that
agree in everything as many are taken as are needed, whichever; an empty table gives an
empty result, one without words takes nothing; very long texts are documents like others,
whose size a source's target may miss by; other columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.llm.common import table, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
_WORDS = r"[^\x20\x09-\x0D]+"


def fair_targets(sizes: dict, weights: dict, total: float, most: float = MOST_COPIES) -> dict:
    """Shares of total by weight, none above `most` times its source's size; the excess is shared again."""
    out, open_, left = {}, set(sizes), float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / weight for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def min_cost_flow(arcs: list[tuple], source, sink) -> tuple[list[int], int]:
    """The cheapest maximal flow by successive shortest paths with potentials.
    arcs: (from, to, capacity, cost) with whole capacities and costs of 0 or more; returns each arc's flow and the cost."""
    head, cap, cost, out = [], [], [], defaultdict(list)
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(head))
            head.append(y)
            cap.append(z)
            cost.append(v)
    potential = defaultdict(int)
    while True:
        dist, via, heap, order = {source: 0}, {}, [(0, 0, source)], 0
        done = set()
        while heap:
            d, _, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                if cap[e] > 0 and (n := d + cost[e] + potential[x] - potential[head[e]]) < dist.get(head[e], 1 << 62):
                    dist[head[e]], via[head[e]] = n, e
                    order += 1
                    heapq.heappush(heap, (n, order, head[e]))
        if sink not in dist:
            break
        far = max(dist.values())
        for x in list(out):
            potential[x] += dist.get(x, far)
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = head[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flows = [cap[2 * i + 1] for i in range(len(arcs))]
    return flows, sum(f * a[3] for f, a in zip(flows, arcs))


def route(patterns: dict[tuple, int], targets: dict, most: int = MOST_COPIES) -> dict[tuple, int]:
    """Words that the mix takes of each pattern: the k-th repetition of a word costs k - 1.
    Sources that no pattern connects are solved apart."""
    parent = {s: s for s in targets}

    def find(s):
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[find(s)] = find(p[0])
    groups = defaultdict(list)
    for p in patterns:
        if p:
            groups[find(p[0])].append(p)
    taken = dict.fromkeys(patterns, 0)
    for own in groups.values():
        arcs = [("in", ("p", p), patterns[p], k) for p in own for k in range(most)]
        n = len(arcs)
        arcs += [(("p", p), ("s", s), most * patterns[p], 0) for p in own for s in p]
        arcs += [(("s", s), "out", int(round(targets[s])), 0) for s in {s for p in own for s in p}]
        flows, _ = min_cost_flow(arcs, "in", "out")
        for (_, (_, p), _, _), f in zip(arcs[:n], flows):
            taken[p] += f
    return taken


def measured(docs: DataFrame, memberships, seed: int) -> DataFrame:
    """docs with pattern, size and the seeded order (u, then doc_id, then tie)."""
    return docs.withColumns(
        {
            "pattern": F.array_sort(F.array_distinct(memberships)),
            "size": F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long"),
            "u": F.xxhash64(F.lit(seed), "doc_id"),
            "tie": F.xxhash64("text"),
        }
    )


def _order():
    return F.struct("u", F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")


_O = "struct<u:bigint,id:bigint,tie:bigint>"
_SOME = f"array<struct<o:{_O},n:bigint>>"
_ROUNDS = f"array<struct<after:{_O},stop:{_O},most_size:bigint>>"


def _asked(narrow: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    """The documents of the patterns in rows, with the rows' columns; a row for each pattern is broadcast only while they are few."""
    state = narrow.sparkSession.createDataFrame(rows, kind)
    return narrow.withColumn("o", _order()).join(F.broadcast(state) if len(rows) <= 100_000 else state, F.col("pattern").eqNullSafe(F.col("pp")))


def _cuts(narrow: DataFrame, state: dict[tuple, tuple], leaf: int) -> dict[tuple, tuple]:
    """For each pattern of state (want, after, most_size): stop, the first order whose documents no longer
    fit when those behind `after` of at most most_size are taken in turn (None: all fit), how many of the
    equal rows of that order still fit, and what is left.

    Sums of 256 ranges of the order find the one that the cut falls into, which is divided in
    turn until `leaf` documents at most are in it; the order is never sorted, not even a part of it."""
    out, open_ = {}, {p: (want, None, None) for p, (want, _, _) in state.items()}
    kind = f"pp array<string>, after {_O}, most_size long, u0 long, prefix long"
    for depth in range(16):
        if not open_:
            break
        # eight bits of u at a time, then, for documents of one id, of tie
        word, place = ("u", depth) if depth < 8 else ("tie", depth - 8)
        rows = _asked(narrow, [(list(p), *state[p][1:], u0, prefix) for p, (_, u0, prefix) in open_.items()], kind)
        rows = rows.where((F.col("after").isNull() | (F.col("o") > F.col("after"))) & (F.col("size") <= F.col("most_size")))
        if depth >= 8:
            rows = rows.where(F.col("u") == F.col("u0"))
        if place:
            rows = rows.where(F.shiftright(word, 64 - 8 * place) == F.col("prefix"))
        rows = rows.withColumn("b", F.shiftright(word, 56 - 8 * place))
        sums = defaultdict(list)
        for r in rows.groupBy("pp", "b").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect():  # 256 for each pattern at most
            sums[tuple(r.pp)].append((r.b, r.words, r.n))
        last, after = {}, {}
        for p, (want, u0, _) in open_.items():
            for b, words, n in sorted(sums[p]):
                if words > want:
                    (last if n <= leaf or depth == 15 else after)[p] = (want, b if depth == 7 else u0, b)
                    break
                want -= words
            else:
                out[p] = None, 0, want
        if last:
            few = _asked(rows.drop("pp", "o"), [(list(p), b) for p, (_, _, b) in last.items()], "pp array<string>, cut long").where("b = cut")
            orders = defaultdict(list)
            for r in few.groupBy("pp", "o").agg(F.sum("size").alias("words"), F.min("size").alias("least"), F.max("size").alias("size")).collect():
                # only rows of one size can be taken by number
                orders[tuple(r.pp)].append((tuple(r.o), r.words, r.size if r.size == r.least else r.words))
            for p, (want, _, _) in last.items():
                for o, words, size in sorted(orders[p]):
                    if words > want:
                        out[p] = o, want // size, want % size
                        break
                    want -= words
        open_ = after
    return out


def _inside(o):
    """Whether a document is taken in any of the rounds."""
    return F.exists("rounds", lambda r: (F.col("size") <= r["most_size"]) & (r["after"].isNull() | (o > r["after"])) & (r["stop"].isNull() | (o < r["stop"])))


def _fillers(narrow: DataFrame, state: DataFrame, each: int, most: int) -> DataFrame:
    """For each pattern of state (pp, want, base, rounds, part) the orders of documents that fill what is left, one
    row of each: larger ones first, of the first `each` of every doubling of size (a bounded choice, whatever the
    pattern's size), those not taken yet before others; or the one document just too large, if that comes nearer."""
    rows = narrow.where("size > 0").withColumn("o", _order()).join(state, F.col("pattern").eqNullSafe(F.col("pp")))
    rows = rows.where(~F.exists("part", lambda x: x["o"] == F.col("o")))
    rows = rows.withColumn("again", _inside(F.col("o")).cast("int")).where(F.col("base") + F.col("again") < most).withColumn("place", F.struct("again", "o"))
    kind = F.floor(F.log2("size"))
    # the first of each share of a size's documents, then the first of those
    firsts = rows.where("size <= want").groupBy("pp", kind.alias("kind"), F.pmod(F.col("u"), F.lit(16 * each)).alias("share")).agg(F.min("place").alias("place"), F.min_by("size", "place").alias("size"))
    nth = F.row_number().over(Window.partitionBy("pp", "kind").orderBy("place"))
    small = firsts.withColumn("nth", nth).where(F.col("nth") <= each).groupBy("pp").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("n"), F.col("place.o").alias("o")))).alias("c"))
    large = rows.where("size > want").groupBy("pp").agg(F.min(F.struct("size", "place")).alias("l"))
    both = state.join(small.withColumnRenamed("pp", "sp"), F.col("pp").eqNullSafe(F.col("sp")), "left").join(large.withColumnRenamed("pp", "lp"), F.col("pp").eqNullSafe(F.col("lp")), "left")
    empty = F.expr(f"cast(array() as array<{_O}>)")
    greedy = F.aggregate(
        F.coalesce("c", F.expr(f"cast(array() as array<struct<n:bigint,o:{_O}>>)")),
        F.struct(F.col("want").alias("left"), empty.alias("got")),
        lambda a, x: F.when(-x["n"] <= a["left"], F.struct((a["left"] + x["n"]).alias("left"), F.concat(a["got"], F.array(x["o"])).alias("got"))).otherwise(a),
    )
    both = both.withColumn("g", greedy)
    return both.select(F.col("pp").alias("pattern"), F.when(F.col("l.size") - F.col("want") < F.col("g.left"), F.array("l.place.o")).otherwise(F.col("g.got")).alias("fill"))


def plan(narrow: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, per_bucket: int = 200, rounds: int = 6, fill: int = 4) -> DataFrame:
    """One row for each pattern: source_size, target (of its first source), base copies, and which documents
    are taken once more: those of any round (behind `after`, before `stop`, of at most most_size), all rows of the
    orders in whole, and so many of the equal rows of each order in part.
    narrow: pattern, size, u, doc_id, tie. A pattern takes another round only while one document that
    didn't fit leaves more open than a hundredth of its flow."""
    spark = narrow.sparkSession
    totals = narrow.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    patterns = {tuple(r.pattern or ()): r.words for r in totals}
    sizes = defaultdict(int)
    for p, words in patterns.items():
        for s in p:
            sizes[s] += words
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = fair_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(patterns.values()), most)
    taken = route(patterns, targets, most)
    parts = {p: divmod(taken[p], words) if words else (0, 0) for p, words in patterns.items()}
    state = {p: (extra, None, extra) for p, (_, extra) in parts.items() if extra}
    steps, some, open_ = {p: [] for p in parts}, {p: {} for p in parts}, set(state)
    for _ in range(rounds):
        if not open_:
            break
        for p, (stop, fit, rest) in _cuts(narrow, {p: state[p] for p in open_}, per_bucket).items():
            _, after, size = state[p]
            steps[p].append((after, stop, size))
            if fit:
                some[p][stop] = fit
            state[p] = (rest, stop, rest)
        open_ = {p for p in open_ if steps[p] and steps[p][-1][1] is not None and 100 * state[p][0] > parts[p][1]}
    left = [p for p in state if state[p][0]]
    if left:
        asked = spark.createDataFrame([(list(p), state[p][0], parts[p][0], steps[p], list(some[p].items())) for p in left], f"pp array<string>, want long, base long, rounds {_ROUNDS}, part {_SOME}")
        asked = F.broadcast(asked) if len(left) <= 100_000 else asked
        for r in _fillers(narrow, asked, fill, most).collect():
            some[tuple(r.pattern or ())].update((tuple(o), 1) for o in r.fill)
    # an order of which all rows are taken needs no count of them
    every = {(p, r.o) for p, r in _rows_of(narrow, some) if r.n <= some[p][tuple(r.o)]}
    rows = []
    for i, (p, (base, _)) in enumerate(parts.items()):
        whole, part = [], []
        for o, n in some[p].items():
            (whole if (p, o) in every else part).append((o, n))
        rows.append((i, list(p), sizes[p[0]] if p else 0, targets[p[0]] if p else 0.0, base, steps[p], [o for o, _ in whole], part))
    return written(spark.createDataFrame(rows, f"pid long, pattern array<string>, source_size long, target double, base long, rounds {_ROUNDS}, whole array<{_O}>, part {_SOME}"), "mix-plan")


def _rows_of(narrow: DataFrame, some: dict[tuple, dict]) -> list[tuple]:
    """(pattern, row with o and n) for the orders in some: how many rows have each. A few orders for each pattern."""
    asked = [(list(p), [o for o in own]) for p, own in some.items() if own]
    if not asked:
        return []
    rows = _asked(narrow, asked, f"pp array<string>, os array<{_O}>").where(F.array_contains("os", F.col("o")))
    return [(tuple(r.pp or ()), r) for r in rows.groupBy("pp", "o").agg(F.count("*").alias("n")).collect()]


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (as from measured()) with source_size, target, copies and taken. Only equal rows of which some are
    taken once more and some aren't are shuffled, to be counted; docs aren't."""
    small, counted = plan.count() <= 100_000, not plan.where(F.size("part") > 0).isEmpty()
    p = plan.withColumnRenamed("pattern", "pp")
    p = F.broadcast(p) if small else p
    o = _order()
    out = docs.join(p, F.col("pattern").eqNullSafe(F.col("pp")))
    out = out.withColumn("more", _inside(o).cast("long") + F.array_contains("whole", o).cast("long"))
    if counted:
        place = F.array_position(F.transform("part", lambda x: x["o"]), o)
        few = _numbered(out.where(place > 0).withColumn("place", place))
        few = few.withColumn("more", F.col("more") + (F.col("number") <= F.get("part", F.col("place").cast("int") - 1)["n"]).cast("long"))
        out = out.where(place == 0).unionByName(few.select(out.columns))
    return out.withColumn("copies", F.col("base") + F.col("more")).withColumn("taken", F.col("copies") * F.col("size")).drop("pid", "pp", "base", "rounds", "whole", "part", "more")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with number, from 1, among those of the same (pid, place): counted within partitions, then added up over them."""
    rows = written(rows.withColumn("own", F.spark_partition_id()), "mix-equal")
    counts = rows.groupBy("pid", "place", "own").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("pid", "place").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("pid", "place", "own").orderBy(F.lit(0)))
    both = rows.withColumn("within", within).join(counts.select("pid", "place", "own", before.alias("before")), ["pid", "place", "own"])
    return both.withColumn("number", F.col("before") + F.col("within"))


def mix(docs: DataFrame, memberships, seed: int = 17) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them; texts are read twice and never shuffled."""
    full = measured(docs.select(F.struct("*").alias("doc"), "doc_id", "text", memberships.alias("in")), F.col("in"), seed)
    narrow = written(full.select("doc_id", "pattern", "size", "u", "tie"), "mix-sizes")
    out = mixed(full, plan(narrow)).where("copies > 0 OR size = 0")
    # a document without words costs nothing and stays
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).select("doc.*")


def op1(spark: SparkSession, sf_dir: str, seed: int = 17) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    narrow = written(measured(docs, F.array("source"), seed).drop("text"), "mix-sizes")
    return mixed(narrow, plan(narrow)).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op1: sizes and targets."""
    return op1(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))
