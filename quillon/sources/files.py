"""File sources with declared schemas and strictness, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """A CSV file under a contract: the header's names and order are checked, and a value that doesn't parse fails the read.

    windows-1252, which Spark doesn't read, is read as ISO-8859-1, from which it differs in 32 code points that are translated.
    """
    western = encoding.lower() in ("windows-1252", "cp1252")
    df = spark.read.csv(path, schema=schema, header=header, encoding="ISO-8859-1" if western else encoding, mode="FAILFAST", enforceSchema=False)
    if not western:
        return df
    known = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
    plain = lambda c: F.translate(c, "".join(known), "".join(known.values())).alias(c)
    return df.select(*[plain(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def series_csv(spark: SparkSession, path: str, date: str, hour: str, value: str, date_format: str = "dd/MM/yyyy", encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns, and timestamp (date plus hours, no time zone) and target (number); bad dates, hours or values fail the query. Order and rows stay."""
    raw = spark.read.csv(path, header=True, encoding=encoding)
    if missing := [c for c in (date, hour, value) if c not in raw.columns]:
        raise ValueError(f"missing columns {missing}")
    col = lambda c: F.col(f"`{c}`")
    h = F.try_to_number(F.trim(col(hour)), F.lit("99")).cast("int")
    day = F.to_timestamp_ntz(col(date), F.lit(date_format))
    hours = F.when(h.between(0, 23), h).otherwise(F.raise_error(F.concat(F.lit("bad hour: "), F.coalesce(col(hour), F.lit("null")))).cast("int"))
    target = col(value).try_cast("double")
    good = F.when(target.isNotNull() & ~F.isnan(target), target).otherwise(F.raise_error(F.concat(F.lit("bad value: "), F.coalesce(col(value), F.lit("null")))).cast("double"))
    return raw.withColumn("timestamp", day + F.make_dt_interval(hours=hours)).withColumn("target", good)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object a line. Strict: blank lines and bad JSON fail; lenient: blank lines are skipped."""
    if strict and spark.read.text(path).where("trim(value) = ''").limit(1).count():
        raise ValueError(f"blank line in {path}")
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """A runtime view: nothing but these columns can be read from it, so labels can't leak."""
    return df.select(*columns)


def ordered_mapping(spark: SparkSession, path: str) -> DataFrame:
    """pos, id, text of one JSON object, in the file's order."""
    text = spark.read.text(path, wholetext=True).first()[0]
    pairs = json.loads(text, object_pairs_hook=list)
    if not isinstance(pairs, list) or not all(isinstance(k, str) and isinstance(v, str) for k, v in pairs):
        raise ValueError("not an object of texts")
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("repeated id")
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "pos int, id string, text string")


def matrix(spark: SparkSession, values, missing_ok: bool = True) -> DataFrame:
    """row, col, value of a two-dimensional array that the driver holds; NaN is null, or refused."""
    import numpy as np

    a = np.asarray(values, float)
    if a.ndim != 2:
        raise ValueError("not a matrix")
    if not missing_ok and np.isnan(a).any():
        raise ValueError("missing values")
    rows = [(i, j, None if np.isnan(x) else float(x)) for (i, j), x in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def interactions(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The long table of a matrix with ids: pair (numbered without the missing), flat index, row_id, col_id, value. Numbers come from counts before each row, so no window sees the whole table."""
    from pyspark.sql import Window

    n_cols = cols.count()
    known = cells.where("value is not null")
    per_row = known.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    before = per_row.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each matrix row
    inside = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    r, c = rows.select(F.col("pos").alias("row"), F.col("id").alias("row_id")), cols.select(F.col("pos").alias("col"), F.col("id").alias("col_id"))
    return known.withColumn("inside", inside).join(before, "row").join(r, "row").join(c, "col").select((F.col("before") + F.col("inside")).cast("long").alias("pair"), (F.col("row").cast("long") * n_cols + F.col("col")).alias("flat_index"), "row_id", "col_id", "value")


def replication(arrays: dict, k: int) -> list[tuple]:
    """Flat rows of replication k of arrays shaped (n, R) or (n, d, R)."""
    import numpy as np

    out = []
    for name, a in arrays.items():
        a = np.asarray(a)
        if a.ndim < 2 or not 0 <= k < a.shape[-1]:
            raise ValueError(f"{name} has no replication {k}")
        flat = a[..., k]
        out += [(name, flat)] if flat.ndim == 1 else [(f"{name}{j}", flat[:, j]) for j in range(flat.shape[1])]
    return out


def npz_replication(spark: SparkSession, path: str, k: int) -> DataFrame:
    """row and a column for each array (or array column) of replication k of a NumPy archive that the driver can open; pickled objects are refused."""
    import numpy as np

    with np.load(path, allow_pickle=False) as archive:
        flat = replication({name: archive[name] for name in archive.files}, k)
    if len({len(v) for _, v in flat}) != 1:
        raise ValueError("arrays of different lengths")
    columns = [[float(x) for x in v] for _, v in flat]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns, strict=True))], "row int, " + ", ".join(f"`{n}` double" for n, _ in flat))


def bundle(spark: SparkSession, folder: str, parts: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """The CSV files of a bundle: name -> (schema, encoding) gives name -> table. A file that is absent is refused before any is read."""
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    paths = {name: f"{folder}/{name}.csv" for name in parts}
    if missing := [n for n, p in paths.items() if not Path(p).getFileSystem(conf).exists(Path(p))]:
        raise ValueError(f"missing files {missing}")
    return {name: csv(spark, paths[name], schema, encoding) for name, (schema, encoding) in parts.items()}


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, abstract (sentences) and the searchable text; ids must be unique."""
    from quillon.operators.checks import require

    df = jsonl(spark, path, "doc_id long, title string, abstract array<string>")
    return require(df, keys=["doc_id"]).withColumn("text", F.concat_ws(" ", "title", F.concat_ws(" ", "abstract")))


def gold_citations(spark: SparkSession, path: str) -> DataFrame:
    """claim_id, doc_id, label, sentences of each piece of evidence; claims without any have one row of NO_EVIDENCE; a claim of two labels is refused."""
    raw = jsonl(spark, path, "id long, claim string, evidence map<string, array<struct<label: string, sentences: array<int>>>>")
    rows = raw.select(F.col("id").alias("claim_id"), F.explode_outer("evidence").alias("doc_id", "parts")).select("claim_id", F.col("doc_id").cast("long"), F.explode_outer("parts").alias("part"))
    flat = rows.select("claim_id", "doc_id", F.coalesce("part.label", F.lit("NO_EVIDENCE")).alias("label"), F.sort_array("part.sentences").alias("sentences"))
    if flat.groupBy("claim_id").agg(F.count_distinct("label").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a claim has two labels")
    return flat


def theorems(spark: SparkSession, path: str) -> DataFrame:
    """pos, name, statement of the theorem declarations in whole files, their proofs dropped."""
    text = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(r"(?s)theorem\s+[A-Za-z0-9_']+.*?:="), F.lit(0))
    return text.select(F.posexplode(found).alias("pos", "decl")).select("pos", F.regexp_extract("decl", r"theorem\s+([A-Za-z0-9_']+)", 1).alias("name"), F.trim(F.regexp_replace("decl", r"(?s)^theorem\s+[A-Za-z0-9_']+|:=$", "")).alias("statement"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes, SHA-256 and class of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"\.(csv|tsv)$"), "table").when(name.rlike(r"\.jsonl?$"), "json").when(name.rlike(r"\.parquet$"), "parquet").otherwise("other")
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


# ---- sinks ----

ONE_FILE = 1_000_000


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """In a declared order: one file for up to ONE_FILE rows, else files whose names follow the order."""
    rows = df.orderBy(*order)
    if df.limit(ONE_FILE + 1).count() <= ONE_FILE:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").csv(path, header=True)


def report(df: DataFrame) -> DataFrame:
    """A table of a few rows as one JSON document, NaN and infinities as null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    rows = df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("j"))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("document"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    """Adds rows; none is ever rewritten."""
    df.write.mode("append").json(path)


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]]) + "\n"
