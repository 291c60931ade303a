"""Mixing of sources to target weights, over a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.common import documents, stored, text_or_empty, words_of

LEVELS = ("domain", "lang", "source")
#: The driver holds a row for each leaf; more leaves than this are refused.
MOST_LEAVES = 100_000
#: A leaf's documents are counted in so many stretches of hashes, and one stretch of them in order.
STRETCH_BITS = 12
SEED = 20_240
#: Weights of children by the path of their parent and their name; children without one weigh 1 (parameters of the query).
WEIGHTS = {("web",): 0.4, ("books",): 0.3, ("code",): 0.2, ("forum",): 0.1}
LANGUAGE_WEIGHTS = {"en": 0.4, "fr": 0.25, "de": 0.2, "es": 0.15}
SHARE, MOST_EPOCHS = 0.6, 2

Path = tuple


def share_out(budget: int, capacities: Mapping[object, int], weights: Mapping[object, float]) -> dict[object, int]:
    """budget among siblings by weight; what exceeds a sibling's capacity goes to the others by their weights."""
    given = dict.fromkeys(capacities, 0)
    left, open_ = min(budget, sum(capacities.values())), {k for k, c in capacities.items() if c > 0}
    order = sorted(open_, key=repr)
    while left > 0 and open_:
        total = sum(weights[k] for k in order if k in open_)
        offers = {k: left * weights[k] / total if total > 0 else left / len(open_) for k in order if k in open_}
        full = [k for k in offers if given[k] + offers[k] >= capacities[k]]
        if not full:
            for k, x in offers.items():
                given[k] += int(x)
            rest = budget if budget < sum(capacities.values()) else sum(capacities.values())
            for k in [k for k in order if k in open_]:  # what rounding leaves, in order
                if (more := rest - sum(given.values())) <= 0:
                    break
                given[k] += min(more, capacities[k] - given[k])
            break
        for k in full:
            left -= capacities[k] - given[k]
            given[k] = capacities[k]
            open_.discard(k)
    return given


def allocate(sizes: Mapping[Path, int], weights: Mapping[Path, float], budget: int, epochs: int) -> dict[Path, int]:
    """Tokens for each leaf. From the root down each node's budget is shared out among its children, so a leaf's shortage
    goes to its siblings, and reaches the siblings of an ancestor only when the whole subtree is short."""
    capacity: dict[Path, int] = {}
    children: dict[Path, set[Path]] = {}
    for path, n in sizes.items():
        for k in range(len(path) + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0) + n * epochs
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
    given, todo = {(): min(budget, capacity.get((), 0))}, [()]
    while todo:
        node = todo.pop()
        own = children.get(node, ())
        given.update(share_out(given[node], {c: capacity[c] for c in own}, {c: weights.get(c, 1.0) for c in own}))
        todo += own
    return {p: given[p] for p in sizes}


def _order(epoch: Column, seed: int) -> Column:
    """The place of a row in the epoch's order of its leaf."""
    return F.xxhash64(F.lit(seed), epoch, F.col("mix_id"), F.col("mix_hash"))


def _same_leaf(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in LEVELS:
        out = out & F.col(f"{a}.mix_{c}").eqNullSafe(F.col(f"{b}.mix_{c}"))
    return out


def _measured(docs: DataFrame, id_col: str, text_col: str, levels: Mapping[str, Column]) -> DataFrame:
    """(row, mix_id, mix_hash, mix_tokens, mix_<level>...): row holds the columns of docs, so that their names can't clash."""
    text = text_or_empty(F.col(text_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col(id_col).alias("mix_id"), F.xxhash64(text).alias("mix_hash"), F.size(words_of(text)).cast("long").alias("mix_tokens"), *[levels[c].cast("string").alias(f"mix_{c}") for c in LEVELS])


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[Path, float], share: float, epochs: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", by_lang: Mapping[str, float] | None = None) -> DataFrame:
    """(row, epoch, mix_tokens, mix_<level>...): the chosen rows of docs as structs, once for each epoch.

    The budget is `share` of all tokens (words). A leaf with a quota of e times its tokens and a rest gives e whole epochs
    and, in the seeded order of the next epoch, the longest prefix of rows whose tokens fit the rest; rows of equal
    hash, such as repeated ones, fall on the same side. Prefixes are found from sums over stretches of hashes and
    the rows of one stretch, so a leaf that holds a third of all rows is never in one task, and the rows themselves are
    not shuffled. Null levels are values of their own; null and empty texts have no tokens and cost nothing. Texts may be
    of any length; an empty table gives an empty one, and columns of docs may have any names.
    """
    sized = _measured(docs, id_col, text_col, levels)
    light = stored(sized.select("mix_id", "mix_hash", "mix_tokens", *[f"mix_{c}" for c in LEVELS]), "mixing")
    leaves = light.groupBy(*[f"mix_{c}" for c in LEVELS]).agg(F.sum("mix_tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    sizes = {tuple(r[f"mix_{c}"] for c in LEVELS): r["tokens"] for r in leaves}
    known = dict(weights)
    for path in sizes:
        known.setdefault(path[:2], (by_lang or {}).get(path[1], 1.0))
    quota = allocate(sizes, known, int(share * sum(sizes.values())), epochs)
    rows = [(k, *p, *(divmod(q, sizes[p]) if sizes[p] else (0, 0))) for k, (p, q) in enumerate(sorted(quota.items(), key=repr))]
    schema = "leaf int, " + ", ".join(f"mix_{c} string" for c in LEVELS) + ", whole int, rest long"
    table = docs.sparkSession.createDataFrame(rows, schema)
    of_leaf = lambda df: df.alias("d").join(F.broadcast(table).alias("t"), _same_leaf("d", "t")).select("d.*", "t.leaf", "t.whole", "t.rest")
    placed = of_leaf(light).withColumn("place", _order(F.col("whole"), seed)).withColumn("stretch", F.shiftright("place", 64 - STRETCH_BITS))
    by_leaf = Window.partitionBy("leaf").orderBy("stretch")
    sums = placed.groupBy("leaf", "stretch", "rest").agg(F.sum("mix_tokens").alias("n")).withColumn("upto", F.sum("n").over(by_leaf))
    last = sums.where("upto > rest").groupBy("leaf").agg(F.min_by(F.struct("stretch", (F.col("upto") - F.col("n")).alias("before")), "stretch").alias("s")).select("leaf", "s.stretch", "s.before")
    inside = placed.join(F.broadcast(last), ["leaf", "stretch"]).withColumn("upto", F.col("before") + F.sum("mix_tokens").over(Window.partitionBy("leaf").orderBy("place")))
    cuts = inside.groupBy("leaf").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("cut"), F.shiftleft(F.min("stretch").cast("long"), 64 - STRETCH_BITS).alias("begin"))
    limits = stored(table.join(cuts, "leaf", "left").select(*[f"mix_{c}" for c in LEVELS], "whole", "cut", "begin"), "mixing-limits")
    chosen = sized.alias("d").join(F.broadcast(limits).alias("t"), _same_leaf("d", "t")).select("d.*", "t.whole", "t.cut", "t.begin")
    chosen = chosen.select("*", F.explode(F.sequence(F.lit(0), "whole")).alias("epoch"))
    place = _order(F.col("epoch"), seed)
    inside = F.coalesce(place <= F.col("cut"), place < F.col("begin"), F.lit(True))  # up to the cut; else before its stretch; else all
    return chosen.where((F.col("epoch") < F.col("whole")) | inside).select("row", "epoch", "mix_tokens", *[f"mix_{c}" for c in LEVELS])


def domain(source: Column) -> Column:
    """The queries' domains: a source's number tells its domain, as no table states one."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return F.when(source.isNull() | n.isNull(), "other").when(n < 5, "web").when(n < 10, "books").when(n < 15, "code").otherwise("forum")


def query_levels() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by domain, language and source to WEIGHTS, SHARE of all tokens, each MOST_EPOCHS times at most."""
    chosen = mix(documents(spark, sf_dir), query_levels(), WEIGHTS, SHARE, MOST_EPOCHS, by_lang=LANGUAGE_WEIGHTS)
    return chosen.select("row.doc_id", "epoch", F.col("mix_domain").alias("domain"), "row.lang", "row.source", F.col("mix_tokens").alias("tokens"))
