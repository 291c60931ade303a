"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgertide.llm.common import SPACE_CHARS, documents, let, stored, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
#: Fewest documents from which a language and source sets its own thresholds; smaller ones take their language's, then everyone's.
LEAST_DOCS = 100
#: The adaptive rules, each on an integer measure: name, numerator, factor, denominator, tail, slack. Numerators leave out what a
#: short clean text may hold (a few marks, one repeated window, one repeated line). The tail is the percentile up to which a
#: group's own values count as usual: marks, repeats and repeated lines are zero in most texts, so their quartiles say nothing.
MEASURES = (
    ("symbols", "greatest(n_symbols - 4, 0)", 1000, "n_words", 95, 100),
    ("repeats", f"greatest(n_repeat_words - {2 * WINDOW_WORDS}, 0)", 1000, "n_words", 99, 50),
    ("dup_lines", "greatest(n_dup_lines - 1, 0)", 1000, "n_words", 99, 20),
    ("length", "word_chars", 100, "n_words", 75, 300),
)
#: A measure fails above the larger of q3 + FENCE * (q3 - q1) and its tail's value, plus slack. Texts that fail the base rule
#: are left out of these quantiles.
FENCE = 3
#: The sketch keeps this many sub-buckets in each power of two: a relative error of at most 1/16.
SUB_BITS = 4
#: Broadcast the thresholds up to so many language and source pairs.
MOST_BROADCAST_GROUPS = 10_000


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW_WORDS words that the text holds at least twice."""
    reach = range(WINDOW_WORDS)

    def covered(w: Column) -> Column:
        window = lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in reach]).alias("key"), i.alias("at"))
        ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW_WORDS), window))

        def repeated_starts(e: Column) -> Column:
            same = lambda x, j: F.coalesce(x["key"] == F.get(e, j)["key"], F.lit(False))
            return F.sort_array(F.transform(F.filter(e, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["at"]))

        reached = lambda q: F.aggregate(
            F.transform(q, lambda p, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(q, j + 1) - p, F.lit(WINDOW_WORDS)))), F.lit(0), lambda a, b: a + b
        )
        return let(let(ordered, repeated_starts), reached)

    def from_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW_WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in reach]))
        none_repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))  # equal windows have equal hashes
        return F.when(F.size(w) < WINDOW_WORDS, F.lit(0)).otherwise(F.when(none_repeats, F.lit(0)).otherwise(covered(w)))

    return let(words, from_words)


def base_measures(text: Column) -> dict[str, Column]:
    body = text_or_empty(text)
    without = lambda chars: F.translate(body, chars, "")
    has_word = lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0
    lines = F.filter(F.split(body, "\n"), has_word)
    return {
        "n_words": F.size(words_of(body)).cast("long"),
        "word_chars": F.length(without(SPACE_CHARS)).cast("long"),
        "n_symbols": (F.length(body) - F.length(without(SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words_of(body)).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _measure(numerator: str, factor: int, denominator: str) -> Column:
    return F.expr(f"CASE WHEN {denominator} > 0 THEN ({numerator} * {factor}) div {denominator} ELSE 0L END")


def bucket(value: Column) -> Column:
    """Log-linear bucket of a non-negative integer: exact below 2^SUB_BITS, then 2^SUB_BITS buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - (SUB_BITS + 1), F.lit(0))
    return let(F.struct(value.alias("v"), shift.alias("s")), lambda x: x["s"] * (1 << SUB_BITS) + F.call_function("shiftright", x["v"], x["s"]).cast("int"))


def bucket_top(b: Column) -> Column:
    """The largest value in a bucket."""
    half = 1 << SUB_BITS
    shift = F.greatest(F.floor(b / half).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * half + 1).cast("long"), shift) - 1


def sketch(measured: DataFrame, group_cols: list[str]) -> DataFrame:
    """Counts (group_cols, rule, bucket, n) of the texts that pass the base rule. Sketches merge by adding the counts of equal
    buckets, in any order, with the same result. A group without such texts keeps its buckets, with n = 0."""
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), bucket(_measure(a, f, d)).alias("bucket")) for n, a, f, d, *_ in MEASURES])
    passes = (~base_failed()).alias("passes")
    return measured.select(*group_cols, passes, F.explode(rules).alias("m")).groupBy(*group_cols, "m.rule", "m.bucket").agg(F.count_if("passes").alias("n"))


def _by_rule(place: int) -> Column:
    """An entry of MEASURES for the row's rule."""
    return F.create_map(*[F.lit(x) for m in MEASURES for x in (m[0], m[place])])[F.col("rule")]


def quartiles(sketched: DataFrame, group_cols: list[str]) -> DataFrame:
    """(group_cols, rule, n, q1, q3, tail): the tops of the buckets in which the quartiles and the rule's tail lie."""
    group = Window.partitionBy(*group_cols, "rule")
    seen = sketched.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), bucket_top(F.col("bucket"))))
    return seen.groupBy(*group_cols, "rule").agg(F.max("total").alias("n"), at(F.lit(25)).alias("q1"), at(F.lit(75)).alias("q3"), at(_by_rule(4)).alias("tail"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, limit_<rule>...) for each language and source there is, null counting as a value.

    The leaf sketches are merged upwards; a leaf of fewer than LEAST_DOCS documents that pass the base rule takes its language's fence, and a
    language of fewer takes that of all documents.
    """
    leaf = sketch(measured, ["lang", "source"])
    by_lang = leaf.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    usual = F.greatest(F.col("q3") + FENCE * (F.col("q3") - F.col("q1")), F.col("tail"))
    fence = lambda df, cols, tag: quartiles(df, cols).select(*cols, "rule", F.col("n").alias(f"n_{tag}"), (usual + _by_rule(5)).alias(f"limit_{tag}"))
    a, b, c = fence(leaf, ["lang", "source"], "leaf"), fence(by_lang, ["lang"], "lang"), fence(overall, [], "all")
    a, b = a.alias("a"), b.alias("b")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule"))).select("a.*", "b.n_lang", "b.limit_lang").join(c, "rule")
    limit = F.when(F.col("n_leaf") >= LEAST_DOCS, F.col("limit_leaf")).when(F.col("n_lang") >= LEAST_DOCS, F.col("limit_lang")).otherwise(F.col("limit_all"))
    names = [m[0] for m in MEASURES]
    pick = [F.max(F.when(F.col("rule") == n, F.col("limit"))).alias(f"limit_{n}") for n in names]
    return joined.withColumn("limit", limit).groupBy("lang", "source").agg(*pick)


def verdict() -> Column:
    fails = [_measure(a, f, d) > F.col(f"limit_{n}") for n, a, f, d, *_ in MEASURES]
    return ~(base_failed() | fails[0] | fails[1] | fails[2] | fails[3])


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    found = base_measures(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *[c.alias(n) for n, c in found.items()])


def _with_limits(measured: DataFrame, limits: DataFrame) -> DataFrame:
    keys = lambda side: F.struct(F.col(f"{side}.lang"), F.col(f"{side}.source"))
    same = F.xxhash64(keys("m")) == F.xxhash64(keys("t"))
    return measured.alias("m").join(limits.alias("t"), same & F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source"))).select("m.*", *[f"t.limit_{x[0]}" for x in MEASURES])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    Null and empty texts have no words and fail the base rule. Null languages and sources are groups like any other.
    Repeated rows get repeated results; texts may be of any length; an empty table gives an empty one, and columns other than
    those named have no effect. The measures are stored once, then read for the sketches and for the filter.
    """
    measured = stored(measure(docs, id_col, text_col, lang_col, source_col), "quality")
    judged = _with_limits(measured, thresholds(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict().alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs, whatever their names. Nulls, empty texts and
    repeated rows as in quality().

    Rows are stored beside their measures, so each text is measured once. The limits, a row for each language and source,
    go to the rows, which are not shuffled unless there are more than MOST_BROADCAST_GROUPS limits.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stored(docs.select(row, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *[c.alias(n) for n, c in base_measures(F.col(text_col)).items()]), "quality-rows")
    limits = stored(thresholds(rows), "quality-limits")
    if limits.count() <= MOST_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    return _with_limits(rows, limits).where(verdict()).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of each document, with thresholds of its language and source."""
    return quality(documents(spark, sf_dir))


def _sql_measure(numerator: str, factor: int, denominator: str) -> str:
    return f"CASE WHEN {denominator} > 0 THEN {numerator} * {factor} // {denominator} ELSE 0 END"


def _sql_fence(keys: str, tag: str) -> str:
    """Limits from the sketches of `keys` (a list of columns, each followed by a comma)."""
    window = f"PARTITION BY {keys}rule"
    top = lambda percent: f"min(((bucket - shift * 16 + 1) << shift) - 1) FILTER (WHERE 100 * upto >= {percent} * total)"
    return f"""s_{tag} AS (SELECT {keys}rule, tail, slack, bucket, count(*) FILTER (WHERE passes) AS n FROM m GROUP BY {keys}rule, tail, slack, bucket),
  u_{tag} AS (SELECT *, sum(n) OVER ({window} ORDER BY bucket) AS upto, sum(n) OVER ({window}) AS total, greatest(bucket // 16 - 1, 0) AS shift FROM s_{tag}),
  q_{tag} AS (SELECT {keys}rule, slack, max(total) AS n, {top(25)} AS q1, {top(75)} AS q3, {top("tail")} AS q_tail FROM u_{tag} GROUP BY {keys}rule, slack),
  f_{tag} AS (SELECT {keys}rule, n, greatest(q3 + {FENCE} * (q3 - q1), q_tail) + slack AS cap FROM q_{tag})"""


_RULES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AS passes, '{n}' AS rule, {q} AS tail, {s} AS slack, CAST({_sql_measure(a, f, d)} AS BIGINT) AS v FROM f" for n, a, f, d, q, s in MEASURES
)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
  x AS (SELECT doc_id, k, x FROM (SELECT doc_id, unnest(string_split_regex(t, '[\x20\x09-\x0D]+')) AS x, generate_subscripts(string_split_regex(t, '[\x20\x09-\x0D]+'), 1) AS k FROM d) WHERE x <> ''),
  w AS (SELECT doc_id, list(x ORDER BY k) AS w, sum(length(x)) AS chars FROM x GROUP BY doc_id),
  g AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
  r AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
  c AS (SELECT doc_id, sum(least(5, coalesce(nxt - p, 5))) AS n FROM r GROUP BY doc_id),
  l AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  f AS (SELECT d.doc_id, lang, source, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
  v AS ({_RULES}), m AS (SELECT *, greatest(length(bin(v)) - 5, 0) * 16 + (v >> greatest(length(bin(v)) - 5, 0)) AS bucket FROM v),
  {_sql_fence("lang, source, ", "leaf")}, {_sql_fence("lang, ", "lang")}, {_sql_fence("", "top")},
  b AS (SELECT m.doc_id, bool_or(v > CASE WHEN a.n >= {LEAST_DOCS} THEN a.cap WHEN o.n >= {LEAST_DOCS} THEN o.cap ELSE e.cap END) AS out FROM m
    JOIN f_leaf a ON a.rule = m.rule AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source JOIN f_lang o ON o.rule = m.rule AND o.lang IS NOT DISTINCT FROM m.lang JOIN f_top e ON e.rule = m.rule GROUP BY m.doc_id),
  z AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT z.*, NOT (base_failed OR out) AS kept FROM z JOIN b USING (doc_id)
"""
