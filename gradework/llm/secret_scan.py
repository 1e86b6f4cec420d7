"""Operator 7 [native]: secrets by patterns and by a battery of randomness tests.

Base spans come from three patterns.  The method adds runs of key-like characters that look drawn at
random: an encoding is inferred for each run (decimal, hex, base32, base64), and three tests are made
against what structured text gives in that encoding:

* chi-squared uniformity over the encoding's alphabet: structured text uses some characters far more often;
* runs: structured text changes between letters and digits, or between cases, seldom;
* serial correlation of neighbouring characters: sequences such as ``abcdef`` or ``012345`` follow on.

Each gives a probability that a structured run of that length looks so random; they are combined
(Stouffer), and Benjamini-Hochberg decides over all runs of the corpus at rate ``FDR``.  Means and
deviations depend on the length, and so does the level of the step-up: a run's probability is divided by
a weight that grows with its length, so short runs must look more random.  Probabilities are binned, so
the step-up works on a few thousand counts at any input size.

All of it is DataFrame functions; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage

#: The patterns of the contract, with the least lengths; a maximal run of a class is its own match, so its length can stand in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

#: Runs that the tests look at: 20 characters or more, with a digit or both cases.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Z+/_-]*[a-z][a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
FDR = 0.001
#: (pattern, alphabet size, likeness): likeness is alphabet size times the chance that two characters of structured text agree.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", 10, 2.0),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, 2.2),
    ("base32", r"^[A-Z2-7]+=*$", 32, 2.2),
    ("base64", r"^.*$", 64, 3.6),
)
_CHANGES = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z]{2})"
_BIN = 20  # bins a power of ten


def _pieces(pattern: str, group: int = 0) -> Column:
    """array<struct<before, hit, value>>: what lies between matches and the matches, in order."""
    text = F.col("text")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.split(text, pattern, -1), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(hits, F.length)
    made = F.transform(F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda x, i: F.struct(F.get(lengths, i).alias("before"), x["hit"].alias("hit"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), made)


def _spans(rows: DataFrame, column: str, kind: Column) -> DataFrame:
    """(row, kind, start, end, value, hit) of each match: a running sum over a text's matches."""
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.filter(F.col(column).isNotNull()).select("row", F.posexplode(column).alias("at", "m")).select("row", "at", "m.before", "m.hit", "m.value")
    passed = F.coalesce(F.sum(F.col("before") + F.length("hit")).over(before), F.lit(0))
    return each.withColumn("start", passed + F.col("before")).select("row", kind.alias("kind"), "start", (F.col("start") + F.length("hit")).alias("end"), "value", "hit")


def _normal_tail(z: Column) -> Column:
    """log10 P(Z < z), capped at z = -1, for falling z: Mills' ratio bounds, exact enough for the tail."""
    x = F.greatest(-z, F.lit(1.0))
    return -(x * x) / 2 / F.lit(2.302585092994046) - F.log10(x * 2.5066282746310002 * (1 + 1 / (x * x + 2)))


def randomness(candidates: DataFrame) -> DataFrame:
    """``candidates`` (row, start, end, hit) with encoding and log_p, the combined log10 probability."""
    body = F.regexp_replace("hit", "=+$", "")
    encoding, size, like = F.lit(None), F.lit(None), F.lit(None)
    for name, pattern, n, likeness in reversed(ENCODINGS):
        fits = F.col("hit").rlike(pattern)
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        size = F.when(fits, F.lit(float(n))).otherwise(size)
        like = F.when(fits, F.lit(likeness)).otherwise(like)
    rows = candidates.select("*", body.alias("body"), encoding.alias("encoding"), size.alias("size"), like.alias("like")).withColumn("n", F.length("body").cast("double"))
    squares = F.aggregate(
        F.array_distinct(F.split("body", "")),
        F.lit(0.0),
        lambda a, c: a + F.pow((F.col("n") - F.length(F.replace(F.col("body"), c, F.lit("")))).cast("double"), 2.0),
    )
    codes = F.transform(F.split("body", ""), lambda c: F.ascii(c).cast("double"))
    rows = rows.withColumn("chi", F.col("size") / F.col("n") * squares - F.col("n")).withColumn("codes", codes)
    mean = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    rows = rows.withColumn("mean", mean)
    spread = F.aggregate("codes", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    pairs = F.zip_with(F.expr("slice(codes, 1, int(n) - 1)"), F.expr("slice(codes, 2, int(n) - 1)"), lambda x, y: (x - F.col("mean")) * (y - F.col("mean")))
    rows = rows.withColumn("serial", F.coalesce(F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x), spread), F.lit(1.0)))
    # Structured text: chi has mean (A - 1) + (n - 1)(like - 1); its deviation is that of chi-squared plus that of the repeated characters.
    centre = (F.col("size") - 1) + (F.col("n") - 1) * (F.col("like") - 1)
    deviation = F.sqrt(2 * (F.col("size") - 1) + 4 * (F.col("n") - 1) * (F.col("like") - 1) * F.col("like") / 2)
    z_chi = (F.col("chi") - centre) / deviation
    # Structured text changes class at one place in ten; a run drawn at random from letters and digits far more often.
    changes = F.size(F.split("body", _CHANGES, -1)) - 1
    z_runs = F.when(F.col("encoding") == "decimal", F.lit(0.0)).otherwise(((F.col("n") - 1) * 0.1 - changes) / F.sqrt((F.col("n") - 1) * 0.09))
    # Structured text has a serial correlation of about a half.
    z_serial = (F.abs("serial") - 0.5) * F.sqrt(F.col("n"))
    return rows.withColumn("log_p", _normal_tail((z_chi + z_runs + z_serial) / F.sqrt(F.lit(3.0)))).drop("body", "size", "like", "n", "chi", "codes", "mean", "serial")


def discoveries(tested: DataFrame, rate: float = FDR) -> DataFrame:
    """The rows that the step-up keeps.  The weight of a run of n characters is n / 32, between a half and two."""
    weight = F.least(F.greatest((F.col("end") - F.col("start")) / 32.0, F.lit(0.5)), F.lit(2.0))
    binned = tested.withColumn("bin", F.ceil(F.greatest(F.col("log_p") - F.log10(weight), F.lit(-60.0)) * _BIN))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))  # at most 60 * _BIN rows, whatever the input
    up_to = Window.orderBy("bin")
    steps = counts.withColumn("below", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    last = steps.filter(F.pow(F.lit(10.0), F.col("bin") / _BIN) * F.col("all") <= F.col("below") * rate).agg(F.max("bin").alias("last"))
    return binned.join(F.broadcast(last), F.col("bin") <= F.col("last")).drop("bin", "last")


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """One row a document: doc_id, base (array of kind, start, end), added (same).

    Positions are code points, ends exclusive.  Null text is the empty text, without spans; repeated rows
    and rows without doc_id are documents of their own; an empty table gives no rows; other columns are
    ignored.  A run that meets a base span is not added.
    """
    kept = stage(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            _pieces(ASSIGN, 2).alias("assign"),
            _pieces(ACCESS).alias("access"),
            _pieces(HEX).alias("hex"),
            _pieces(RUN).alias("run"),
        ),
        "secret-matches",
    )
    found = _spans(kept, "assign", F.lit(KINDS[0])).filter(F.col("value") >= ASSIGN_VALUE)
    for kind in KINDS[1:]:
        found = found.unionByName(_spans(kept, kind, F.lit(kind)))
    base = found.select("row", F.lit(0).alias("added"), F.struct("start", F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).otherwise(2).alias("rank"), "end", "kind").alias("span"))
    runs = discoveries(randomness(_spans(kept, "run", F.lit("random"))), rate)
    added = runs.select("row", F.lit(1).alias("added"), F.struct("start", F.lit(3).alias("rank"), "end", "kind").alias("span"))
    spans = base.unionByName(added).groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(F.col("added") == k, F.col("span")))).alias(name) for k, name in ((0, "base"), (1, "added"))))
    none = F.array().cast(spans.schema["base"].dataType)
    rows = kept.select("row", "doc_id").join(spans, "row", "left").withColumn("base", F.coalesce("base", none)).withColumn("added", F.coalesce("added", none))
    free = F.filter("added", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select("doc_id", "base", free.alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = scan(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
