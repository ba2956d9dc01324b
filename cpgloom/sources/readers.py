"""Readers of the text inputs: labels, splits, signatures, features and model labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cpgloom.sources.artifacts import stage

MISSING = ("", "NA", "nan", "NaN")


def number(c: str):
    """A double, null for missing words."""
    return F.when(~F.trim(F.col(c)).isin(*MISSING), F.expr(f"try_cast(`{c}` AS double)"))


def samples(spark: SparkSession, path: str, most: int = 40, records: int | None = None) -> DataFrame:
    """(sample_id, name): first tab-separated field of each non-empty line, in file order; over ``most``, or another number than ``records``, is an error."""
    rows = _lines(spark, path).select("line", F.split("value", "\t")[0].alias("name")).where(F.col("name") != "")
    out = rows.select((F.row_number().over(Window.orderBy("line")) - 1).cast("int").alias("sample_id"), "name")
    n = out.count()
    if n > most:
        raise ValueError(f"more than {most} samples")
    if records is not None and n != records:
        raise ValueError(f"{n} names for {records} records")
    return out


def named(records: DataFrame, names: DataFrame, key: str = "cell_id") -> DataFrame:
    """``records`` with a ``name`` for each ``key``: that of ``names`` (sample_id, name), or the key's number from 1 on where there is none."""
    own = names.select(F.col("sample_id").cast("long").alias(key), F.col("name").alias("_name"))
    return records.join(own, key, "left").withColumn("name", F.coalesce("_name", (F.col(key) + 1).cast("string"))).drop("_name")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file of a few lines: names, labels or splits, one for each sample or cell."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def labels(spark: SparkSession, path: str, n_cells: int) -> DataFrame:
    """(cell_id, label): one trimmed label a line, blank lines skipped; the count must be that of the cells."""
    rows = _lines(spark, path).select("line", F.trim("value").alias("label")).where(F.col("label") != "")
    out = rows.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("cell_id"), "label")
    if (n := out.count()) != n_cells:
        raise ValueError(f"{n} labels for {n_cells} cells")
    return out


def splits(spark: SparkSession, path: str, n_cells: int) -> DataFrame:
    """(cell_id, split) from lines of index and train, val or test; comments, blanks and one header are skipped.

    Every cell must come exactly once, and training and validation must not be empty.
    """
    rows = _lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("line", F.split("value", "\t").alias("f"))
    rows = rows.select("line", F.expr("try_cast(trim(f[0]) AS bigint)").alias("cell_id"), F.trim(F.try_element_at("f", F.lit(2))).alias("split"))
    first = rows.orderBy("line").first()
    if first is not None and first["cell_id"] is None:
        rows = rows.where(F.col("line") != first["line"])
    kinds = ("train", "val", "test")
    counted = [F.count("*").alias("n"), F.count_distinct("cell_id").alias("cells"), F.count_if(F.col("cell_id").between(0, n_cells - 1)).alias("inside")]
    seen = rows.agg(*counted, *[F.count_if(F.col("split") == k).alias(k) for k in kinds]).first()
    if not seen["n"] == seen["cells"] == seen["inside"] == n_cells:
        raise ValueError("every cell must be listed exactly once")
    if sum(seen[k] for k in kinds) != seen["n"] or not seen["train"] or not seen["val"]:
        raise ValueError("splits must be train, val or test, with some of train and val")
    return rows.select("cell_id", "split")


def signature(spark: SparkSession, path: str, key: str = "cell_type") -> DataFrame:
    """(cell_type, pattern, beta) of a table of types by patterns; NA and empty are null, short rows end in nulls. At least two types."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *patterns = wide.columns
    long = wide.select(F.col(first).alias(key), *[number(c).alias(c) for c in patterns]).unpivot([key], patterns, "pattern", "beta")
    if wide.count() < 2:
        raise ValueError("a signature needs two cell types or more")
    return long


def features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A feature table with the given columns. A first line with a field that is neither a number nor missing is a header; in later lines such a field is null."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def strange(c: str):
        return ~F.trim(F.coalesce(F.col(c), F.lit(""))).isin(*MISSING) & F.expr(f"try_cast(`{c}` AS double) IS NULL")

    first = spark.read.csv(path, sep="\t", header=False, schema=schema).limit(1)
    head = bool(first.where(" OR ".join(f"`{c}` IS NOT NULL" for c in columns)).select(F.array(*[strange(c) for c in columns]).alias("s")).where(F.array_contains("s", True)).count())
    raw = spark.read.csv(path, sep="\t", header=head, schema=schema)
    return raw.select(*[number(c).alias(c) for c in columns])


def model_labels(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, label) of the line of a key-value file whose key is ``labels``."""
    rows = spark.read.csv(path, sep="\t", header=False, schema="key string, value string").where("key = 'labels'")
    return rows.select(F.posexplode(F.split("value", ",")).alias("class_idx", "label"))


def unit_ids(spark: SparkSession, path: str, n_units: int) -> DataFrame:
    """(unit) of a list of unit numbers between white space: at least one, each below ``n_units`` and once."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where(F.col("w") != "")
    out = words.select(F.expr("try_cast(w AS int)").alias("unit"))
    seen = out.agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units"), F.count_if(F.col("unit").between(0, n_units - 1)).alias("inside")).first()
    if not 0 < seen["n"] == seen["units"] == seen["inside"]:
        raise ValueError("unit numbers must be in range and listed once, and there must be one")
    return out


def pattern_counts(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, n) of lines of a count and a pattern of digits 0 to 2."""
    parts = [F.regexp_extract("value", r"^\s*([0-9]+)\s+([0-2]+)\s*$", g) for g in (1, 2)]
    rows = spark.read.text(path).select(parts[0].alias("n"), parts[1].alias("pattern"))
    out = rows.select("pattern", F.expr("try_cast(n AS bigint)").alias("n"))
    seen = out.agg(F.count("*").alias("rows"), F.count_distinct("pattern").alias("patterns"), F.count_if(F.col("n").between(1, 2**32 - 1)).alias("counts")).first()
    if not seen["rows"] == seen["patterns"] == seen["counts"]:
        raise ValueError("every line must have a count that fits 32 bits and a pattern of its own")
    return out


def site_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(cpg_idx, pattern) of a text of one pattern a line, a line for each CpG in order; files of a folder follow each other by name.

    Lines are numbered within the splits that Spark reads, and shifted by the lines of the splits before, so no split waits for another.
    """
    raw = spark.read.text(path).select(F.trim("value").alias("pattern"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = stage(raw.select("*", F.monotonically_increasing_id().alias("id")), "lines")
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # one row for each split of the input
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"))
    return rows.join(splits, ["file", "start"]).select((F.col("before") + F.col("id") - F.col("first")).alias("cpg_idx"), "pattern")


def check_patterns(sites: DataFrame, counts: DataFrame) -> None:
    """The sites' patterns must be those of the counts, each as often; the background (all 2) and another must be among them."""
    have = sites.groupBy("pattern").agg(F.count("*").alias("sites"))
    both = have.join(counts, "pattern", "full")
    background = F.regexp_like("pattern", F.lit("^2+$"))
    seen = both.agg(F.count_if(~F.col("sites").eqNullSafe(F.col("n"))).alias("off"), F.count_if(background).alias("pna"), F.count_if(~background).alias("real")).first()
    if seen["off"] or not seen["pna"] or not seen["real"]:
        raise ValueError("patterns of the sites and their counts disagree")


def write_linear(path: str, model: DataFrame, method: str, names: list[str], header: str = "cpgloom") -> None:
    """A linear model (pattern, weight, mean, bias, scale; one row for each pattern of a model) as text of one file, fields cut by tabs, numbers with nine digits."""
    rows = model.orderBy("pattern").collect()
    if len(names) != 2 or any("\t" in x or "\n" in x for x in [method, *names, *(r["pattern"] for r in rows)]):
        raise ValueError("two class names are needed, and names without tabs and line ends")
    cut = (rows[0]["bias"], rows[0]["scale"]) if rows else (0.0, 1.0)
    lines = [f"{header}-linear\t1", f"method\t{method}", "labels\t" + "\t".join(names), f"bias\t{cut[0]:.9g}", f"scale\t{cut[1]:.9g}"]
    lines += [f"feature\t{r['pattern']}\t{r['weight']:.9g}\t{r['mean']:.9g}" for r in rows]
    spark = model.sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def read_linear(spark: SparkSession, path: str) -> tuple[DataFrame, str, list[str]]:
    """(model, method, names) of a linear model as text.

    The header is any name before ``-linear``; a scale of 0 counts as 1, unknown
    lines are skipped, and a file without header, method or both names, or with a
    feature of fewer than three fields, is an error.
    """
    lines = [r["value"].split("\t") for r in spark.read.text(path).collect()]  # a row for each pattern of one model
    found: dict[str, list[str]] = {}
    features = []
    for key, *rest in lines:
        if key.endswith("-linear"):
            found["header"] = rest
        elif key == "feature":
            if len(rest) < 3:
                raise ValueError("a feature needs a name, a weight and a mean")
            features.append((rest[0], float(rest[1]), float(rest[2])))
        elif rest:
            found[key] = rest
    if "header" not in found or "method" not in found or len(found.get("labels", ())) < 2:
        raise ValueError("not a linear model")
    bias, scale = (float(found[k][0]) if k in found else 0.0 for k in ("bias", "scale"))
    schema = "pattern string, weight double, mean double, bias double, scale double"
    return spark.createDataFrame([(*f, bias, scale or 1.0) for f in features], schema), found["method"][0], found["labels"][:2]
