"""Secret scan by two character Markov models (native).

Three fixed patterns find the base spans.  Beyond them, every run of
``RUN`` or more key characters is scored by the log-likelihood ratio of two
first-order Markov models over characters: one of random strings, counted in
the values that the base patterns found, and one of ordinary identifiers,
counted in all other runs of the corpus.  Both count over all documents; a
uniform prior stands for random strings where few or none were found.  Runs
whose ratio passes ``TOTAL`` in sum and ``EACH`` per character step are
added as ``markov`` spans, unless they overlap a base span.

Spans are found by splitting the text at the pattern: a hit starts where the
pieces and hits before it end, in code points.

Defined cases: null text is empty and has no spans; repeated rows and null
ids are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom.llm.common import keyed, stored, text_or_empty

# The base patterns; group 1 is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A longer minimum finds the same spans here as dropping short hits later:
# a run that is too short holds no other start that could succeed.
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
ASSIGN_MIN = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = 16
CANDIDATE = rf"([A-Za-z0-9+/_=-]{{{RUN},}})"
KINDS = ("assign", "access", "hex", "markov")
PRIOR_RANDOM = 1.0
PRIOR_PLAIN = 0.1
TOTAL = 10.0
EACH = 0.3


def _hits(pattern: str) -> Column:
    """array<struct<gap, hit, value>>: how far each hit is from the one before."""
    text, p = F.col("text"), F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, p, F.lit(1)).alias("value"))
    # The last piece has no hit behind it.
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["hit"].isNotNull()))


def _spans(hits: DataFrame, kind: str) -> DataFrame:
    """(_key, kind, start, end, value) from the stored gaps and hits."""
    rows = hits.where(F.col(kind).isNotNull()).select("_key", F.posexplode(kind).alias("i", "x")).select(
        "_key", "i", "x.gap", F.length("x.hit").alias("n"), F.col("x.value").alias("value"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("_key").orderBy("i"))
    return (rows.withColumn("end", end.cast("long"))
            .select("_key", F.lit(KINDS.index(kind)).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end", "value"))


def _steps(values: DataFrame) -> DataFrame:
    """(vid, a, b, n, n_a): how often b, and anything at all, follows a in a value."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("at")
    of_a = Window.partitionBy("vid", "a")
    return (values.where(F.length("value") > 1).repartition("vid").select("vid", "value", at)
            .groupBy("vid", F.expr("substring(value, at, 1)").alias("a"), F.expr("substring(value, at + 1, 1)").alias("b"))
            .agg(F.count("*").alias("n")).withColumn("n_a", F.sum("n").over(of_a)))


def _totals(steps: DataFrame, name: str) -> DataFrame:
    return steps.groupBy("a", "b").agg(F.sum("n").alias(name))


def ratios(steps: DataFrame, random: DataFrame, plain: DataFrame) -> DataFrame:
    """(vid, ratio): log-likelihood ratio of each value's steps.

    ``random`` are the steps that train the one model, ``plain`` the vids of
    ``steps`` that train the other; such a value is scored without its own
    share in the counts, or each would vouch for itself.
    """
    chars = F.array(*[F.lit(c) for c in ALPHABET])
    after = Window.partitionBy("a")
    table = (steps.sparkSession.range(1).select(F.explode(chars).alias("a")).withColumn("b", F.explode(chars))
             .join(_totals(random, "r"), ["a", "b"], "left")
             .join(_totals(steps.join(plain, "vid", "left_semi"), "p"), ["a", "b"], "left").fillna(0, ["r", "p"])
             .withColumn("r_a", F.sum("r").over(after)).withColumn("p_a", F.sum("p").over(after)))
    table = stored(table, "secret-model")
    own = F.when(F.col("trains"), 1).otherwise(0)
    each = (F.log((F.col("r") + PRIOR_RANDOM) / (F.col("r_a") + PRIOR_RANDOM * len(ALPHABET)))
            - F.log((F.col("p") - own * F.col("n") + PRIOR_PLAIN) / (F.col("p_a") - own * F.col("n_a") + PRIOR_PLAIN * len(ALPHABET))))
    # The model has one row for each pair of ALPHABET, whatever the corpus.
    return (steps.join(plain.withColumn("trains", F.lit(True)), "vid", "left").fillna(False, ["trains"])
            .join(F.broadcast(table), ["a", "b"]).groupBy("vid").agg(F.sum(F.col("n") * each).alias("ratio")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has _key and id of each document, spans (_key, kind, start, end, value)."""
    rows, _ = keyed(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "id")
    patterns = zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)
    hits = stored(rows.select("_key", *[_hits(p).alias(k) for k, p in patterns]), "secret-hits")
    base = _spans(hits, "assign").where(F.length("value") >= ASSIGN_MIN)
    for kind in ("access", "hex"):
        base = base.unionByName(_spans(hits, kind))
    base = stored(base, "secret-base")
    runs = stored(_spans(hits, "markov"), "secret-runs")
    numbered = lambda df, name: stored(df.select("value").distinct().withColumn("vid", F.monotonically_increasing_id()), name)
    found = numbered(base, "secret-found")
    values = numbered(runs, "secret-values")
    steps = stored(_steps(values), "secret-steps")
    random = stored(_steps(found), "secret-random")
    # A run that holds a base value, or is one, is no ordinary identifier; nor,
    # for the second model, is one that the first takes for random.
    plain = stored(values.where(~(F.col("value").rlike(ASSIGN) | F.col("value").rlike(ACCESS) | F.col("value").rlike(HEX)))
                   .join(found.select("value"), "value", "left_anti").select("vid"), "secret-plain")
    first = ratios(steps, random, plain)
    plain = stored(plain.join(first.where("ratio > 0"), "vid", "left_anti"), "secret-plain")
    flagged = (ratios(steps, random, plain).join(values, "vid")
               .where((F.col("ratio") >= TOTAL) & (F.col("ratio") >= EACH * (F.length("value") - 1))))
    added = runs.join(flagged.select("value"), "value", "left_semi").select(*base.columns)
    # Only documents with an added span compare their spans, within the document.
    mine = stored(added, "secret-added")
    by_doc = (base.join(mine.select("_key").distinct(), "_key", "left_semi")
              .groupBy("_key").agg(F.collect_list(F.struct("start", "end")).alias("taken")))
    free = (mine.join(by_doc, "_key", "left")
            .where(F.coalesce(~F.exists("taken", lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"])), F.lit(True)))
            .select(*base.columns))
    return rows.select("_key", "id"), base.unionByName(free)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: id, counts, base_sha256 and spans."""
    of = spans.groupBy("_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("all"))
    every = F.coalesce("all", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"))
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return rows.join(of, "_key", "left").withColumn("all", every).select(
        "id", count(0), count(1), count(2),
        F.sha2(_listed(F.filter("all", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"))
