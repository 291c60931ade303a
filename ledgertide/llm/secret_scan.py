"""Secret candidates, told apart by how widely the corpus shares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.common import SPACE, documents, let, stored, text_or_empty

#: Base kinds in the order in which spans of equal start are listed: name, pattern, pattern that gives the value, fewest characters of it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # runs are maximal, so the least length can stand in the pattern
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A key's header and what follows of it: header fields, lines of the body (line ends may be written as \\n), however many (taken
#: possessively, which costs the regex engine no stack), and the last, short line.
_GAP = r"(?:[\x20\x09-\x0D\"',+#>|]|\\[nr])"
KEY_BLOCK = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_GAP}{{1,16}}(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]+){{0,4}}(?:{_GAP}{{0,16}}[A-Za-z0-9+/=]{{16,}})*+(?:{_GAP}{{0,16}}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={_GAP}{{0,16}}-----END))?"
#: Kinds that the ownership method adds where the corpus speaks for a live credential.
EXTRA = (
    ("key_block", KEY_BLOCK, 0, 20),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("service", r"(?:gh[opsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})", 0, 13),
    ("mixed", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
KINDS = [k[0] for k in BASE + EXTRA]
#: Equal texts of so many words are copies of one text; shorter ones are taken for uses of their own, by repository.
COPY_WORDS = 8
#: A value in more repositories than these is shared widely, though all be one owner's: a template or an example rather than a live secret.
WIDE_REPOSITORIES = 20


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<rank, gap, whole, hash>> of the leftmost non-overlapping matches: the length of the text since the
    match before, that of the match, and its value's hash, null where the value is too short.

    What split() leaves between the matches tells the gaps, and places are sums of gaps and matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    judged = lambda v: F.when(F.length(v) >= least, F.md5(F.regexp_replace(v, _GAP, "") if kind == "key_block" else v))
    cut = lambda x, v: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), judged(v).alias("hash"))
    pieces = lambda m: F.zip_with(F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("gap"), m.alias("whole")), values, cut)
    return F.when(text.rlike(pattern), let(found, pieces)).otherwise(F.array().cast("array<struct<rank:int,gap:int,whole:int,hash:string>>"))


def candidates(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """(doc_id, repository, owner, content, matches) of every whole text; copies of a text share content, and a null owner is
    another one in each repository."""
    owner = F.coalesce(F.concat(F.lit("owner:"), F.col(owner_col).cast("string")), F.concat(F.lit("of:"), F.col(repository_col).cast("string")))
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), owner.alias("owner"), text_or_empty(F.col(text_col)).alias("body"))
    text = F.col("body")
    copied = text.rlike(rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+{SPACE}){{{COPY_WORDS - 1}}}[^\x20\x09-\x0D]")
    content = F.when(copied, F.xxhash64(F.lit("text"), F.regexp_replace(text, SPACE, " "))).otherwise(F.xxhash64(F.lit("repository"), "repository"))  # a repository is known by its hash, as it is only counted
    return body.select("doc_id", F.xxhash64("repository").alias("repository"), "owner", content.alias("content"), F.concat(*[_matches(text, *k) for k in BASE + EXTRA]).alias("matches"))


def spans(found: DataFrame) -> DataFrame:
    """(row, content, repository, owner, rank, start, stop, hash) of the matches with a value, from rows of candidates() with `row`.

    Places are running sums over the matches of a kind in a text, so their cost grows with their number.
    """
    each = found.select("row", "content", "repository", "owner", F.posexplode("matches").alias("nth", "m")).select("row", "content", "repository", "owner", "nth", "m.*")
    before = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("whole")).over(before)
    return each.withColumn("stop", stop).where("hash IS NOT NULL").select("row", "content", "repository", "owner", "rank", (F.col("stop") - F.col("whole")).alias("start"), "stop", "hash")


def ownership(each: DataFrame) -> DataFrame:
    """(hash, contents, repositories, owners, most, uses) of every candidate value; most is the contents that its widest owner holds.

    Pairs are made distinct before they are counted, so a value that a third of the corpus holds costs one row a task in
    each count. Null repositories count as one.
    """
    pairs = each.groupBy("hash", "content", "owner").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("held"), F.sum("uses").alias("uses")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.max("held").alias("most"), F.sum("uses").alias("uses"))
    by_content = pairs.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("contents"))
    by_repository = each.groupBy("hash", "repository").agg(F.count(F.lit(1)).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    return by_content.join(by_owner, "hash").join(by_repository, "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans) for each row.

    Base spans are always listed. A further kind of candidate is listed as well where its value looks live: one owner
    holds every text in which it stands, and it stands in WIDE_REPOSITORIES repositories at most. Copies of a text count once for
    both, so a copy elsewhere makes no example of what it holds. Unknown owners are one for each repository. n_live and n_example count the listed spans and the
    copied ones by that measure, base kinds included. Null texts count as empty, and texts without candidates get
    zeros and the digest of the empty list. Texts may be of any length and hold any number of candidates. Repeated rows get
    repeated results; an empty table gives an empty one, and columns other than those named have no effect. Candidates,
    without texts, are stored once; hot values meet only in counts and in a join whose skewed side Spark splits.
    """
    found = stored(candidates(docs, id_col, text_col, repository_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = stored(spans(found), "secret-spans")
    live = (F.col("most") == F.col("contents")) & (F.least("contents", "repositories") <= WIDE_REPOSITORIES)
    base = F.col("rank") < len(BASE)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    span = F.struct("start", "rank", F.concat_ws(":", kind, F.col("start").cast("string"), F.col("stop").cast("string")).alias("text"))
    judged = (
        each.join(ownership(each), "hash").withColumns({"live": live, "span": span})
        .groupBy("row")
        .agg(
            *[F.count_if(F.col("rank") == k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)], F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
            *[F.collect_list(F.when(which, F.col("span"))).alias(name) for name, which in (("base", base), ("listed", base | live), ("live_spans", F.col("live")))],
        )
    )
    text = lambda name: F.coalesce(F.array_join(F.transform(F.sort_array(name), lambda x: x["text"]), ","), F.lit(""))
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return found.select("row", "doc_id").join(judged, "row", "left").select(
        "doc_id", *[count(f"n_{k[0]}") for k in BASE], F.sha2(text("base"), 256).alias("base_sha256"), text("listed").alias("spans"), count("n_live"), count("n_example"), text("live_spans").alias("live_spans")
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a document is a repository and its source the owner."""
    return scan(documents(spark, sf_dir))
