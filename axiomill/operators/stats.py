"""Counting, diversity, lengths, vocabularies and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomill.functions.hashing import safe_ratio


def distribution_metrics(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Per group: coverage, effective number of names (exp of the entropy in nats, 3 digits), share of the four largest (4 digits)."""
    counts = df.where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__n"), name))
    shares = counts.select(*by, "__n", (F.col("__n") / total).alias("__p"), rank.alias("__rank"))
    return shares.groupBy(*by).agg(
        F.count(F.lit(1)).alias("coverage"),
        F.round(F.exp(-F.sum(F.col("__p") * F.ln("__p"))), 3).alias("effective_names"),
        F.round(F.sum(F.when(F.col("__rank") <= 4, F.col("__n")).otherwise(0)) / F.sum("__n"), 4).alias("top_four_fraction"),
    )


def nearest_rank(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of whole numbers: the value at index round-half-even((n - 1) * fraction) of the sorted ones.

    Works on the histogram (value, count), which combines on the map side; a group's rows are never sorted in one task.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("__n").over(Window.partitionBy(*by))
    cum = hist.select(*by, value, upto.alias("__upto"), total.alias("__total"))
    at = lambda f: F.bround(((F.col("__total") - 1) * F.lit(f)).cast("decimal(20,6)"), 0)
    picks = [F.min(F.when(F.col("__upto") > at(f), F.col(value))).alias(name) for name, f in fractions.items()]
    return cum.groupBy(*by).agg(F.max("__total").alias("rows"), F.min(value).alias("min"), *picks, F.max(value).alias("max"))


def length_summary(df: DataFrame, by: list[str], value: str, limit: int) -> DataFrame:
    out = nearest_rank(df, by, value, {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99})
    over = df.groupBy(*by).agg(F.count_if(F.col(value) > limit).alias("over_limit"))
    return out.join(over, by).withColumn("limit", F.lit(limit))


def grouping_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows): one-column distributions of all columns in a single pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("rows"))


def rounded_histogram(df: DataFrame, value: str, digits: int = 1) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.bround(F.col(value).cast("decimal(18,3)"), digits).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def per_row_counts(df: DataFrame, names: Column, once: bool = True) -> DataFrame:
    """How many rows (once) or how often (not once) each name of an array column occurs."""
    return df.select(F.explode(F.array_distinct(names) if once else names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def rarest_name(df: DataFrame, row: list[str], name: str) -> DataFrame:
    """Each row's rarest name over all rows, ties by name: (row columns, name, prevalence)."""
    pairs = df.select(*row, name).distinct()
    prevalence = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("prevalence"))
    return pairs.join(prevalence, name).groupBy(*row).agg(F.min(F.struct("prevalence", name)).alias("__m")).select(*row, F.col(f"__m.{name}").alias(name), F.col("__m.prevalence").alias("prevalence"))


def vocabulary(df: DataFrame, words: Column, size: int, reserved: tuple[str, ...] = ("<unk>", "<s>", "</s>", "<pad>")) -> DataFrame:
    """(id, word, n): reserved symbols first, then the most frequent words, ties by word."""
    counts = df.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(~F.col("word").isin(*reserved)).orderBy(F.desc("n"), "word").limit(max(0, size - len(reserved)))
    ids = F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1 + len(reserved)  # of at most `size` rows
    first = df.sparkSession.createDataFrame([(i, w, 0) for i, w in enumerate(reserved)], "id int, word string, n long")
    return first.unionByName(top.select(ids.cast("int").alias("id"), "word", "n"))


def unknown_rate(df: DataFrame, by: list[str], words: Column, known: DataFrame) -> DataFrame:
    """Per group: pieces, unknown pieces and their fraction (6 digits). known: a column word."""
    pieces = df.select(*by, F.explode(words).alias("word")).where("word <> ''").groupBy(*by, "word").agg(F.count(F.lit(1)).alias("__n"))
    marked = pieces.join(known.select("word", F.lit(1).alias("__known")).distinct(), "word", "left")
    n, lost = F.sum("__n"), F.sum(F.when(F.col("__known").isNull(), F.col("__n")).otherwise(0))
    return marked.groupBy(*by).agg(n.alias("pieces"), lost.alias("unknown"), safe_ratio(lost, n, 6).alias("fraction"))


def sum_counters(df: DataFrame, by: list[str], counters: str) -> DataFrame:
    """Sums of a map column key by key."""
    return df.select(*by, F.explode(counters).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("value"))


def configuration_report(df: DataFrame, config: str, rows: Column, attempts: Column, seconds: Column, share: Column) -> DataFrame:
    """Sums per configuration and its place by rows per CPU hour, rows per 1,000 attempts and the smaller share."""
    sums = df.groupBy(config).agg(F.sum(rows).alias("rows"), F.sum(attempts).alias("attempts"), F.sum(seconds).alias("seconds"), F.max(share).alias("share"))
    rate, thousand = safe_ratio(F.col("rows") * 3600, F.col("seconds")), safe_ratio(F.col("rows") * 1000, F.col("attempts"))
    out = sums.select(config, "rows", "attempts", rate.alias("rows_per_cpu_hour"), thousand.alias("rows_per_thousand"), F.round("share", 4).alias("top_share"))
    place = F.row_number().over(Window.orderBy(F.desc("rows_per_cpu_hour"), F.desc("rows_per_thousand"), "top_share", config))  # a row per configuration
    return out.withColumn("place", place)


def exact_match(df: DataFrame, target: Column, predictions: Column, valid: Column) -> DataFrame:
    """One row of held-out rates over rows with ranked predictions and their validity (arrays)."""
    hit = F.transform(predictions, lambda p: p == target)
    both = F.zip_with(hit, valid, lambda a, b: a & b)
    top = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(False)).cast("int")
    some = lambda a: F.exists(a, lambda x: F.coalesce(x, F.lit(False))).cast("int")
    parts = {"top1_exact": top(hit), "topk_exact": some(hit), "top1_valid": top(valid), "topk_any_valid": some(valid), "top1_exact_and_valid": top(both), "topk_exact_and_valid": some(both)}
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.round(F.coalesce(F.sum(v), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias(k) for k, v in parts.items()))


def status_counts(df: DataFrame, status: Column, values: tuple[str, ...]) -> list[Column]:
    return [F.count_if(status == v).alias(v) for v in values]
