"""Readers of delimited, interval, sequence, ontology and taxonomy files as DataFrames, and writers of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.shared import written
from weftline.sources.wrapped import wrapped_fastq

GFF = "seqname string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
BED = "chr string, start long, end long, label string, score int, strand string"


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A table of a given schema; lines that start with # are comments, a wrong number of columns is an error, and gz and bz2
    files are read by their suffix."""
    return spark.read.csv(path, schema=schema, sep=sep, comment="#", mode="FAILFAST")


def key_values(spark: SparkSession, path: str, sep: str = "\t", order: str | None = None) -> DataFrame:
    """(key, value), and with ``order`` a column of that name by which rows stand as in the files: by file name, place of the
    split, and row within it.  Row ids alone would not do, as Spark reads the splits of several files by their size."""
    rows = delimited(spark, path, "key string, value string", sep)
    if not order:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("key", "value", place.alias(order))


def sign(strand: Column) -> Column:
    """1, -1, or 0 for anything else."""
    return F.when(strand.isin("+", "1"), 1).when(strand.isin("-", "-1"), -1).otherwise(0).cast("tinyint")


def attributes(text: Column) -> Column:
    """map<string, array<string>> of ``k=v`` and ``k "v"`` lists; a repeated key keeps all its values in order."""
    pairs = F.transform(F.split(text, ";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(x))
    real = F.filter(pairs, lambda x: x.rlike(r"^[^\s=]+\s*[=\s]"))
    key = lambda x: F.regexp_extract(x, r"^([^\s=]+)", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^\s=]+\s*[=\s]\s*(.*)$", 1)), '^"|"$', "")
    names = F.array_distinct(F.transform(real, key))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.transform(F.filter(real, lambda x: key(x) == k), value)))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 or GTF: chr, feature, source, start (0-based), end, score, strand (1, -1, 0), phase, attributes as a map."""
    raw = delimited(spark, path, GFF)
    return raw.select(
        F.col("seqname").alias("chr"),
        F.col("type").alias("feature"),
        "source",
        (F.col("start") - 1).alias("start"),
        "end",
        F.coalesce(F.expr("try_cast(score AS float)"), F.lit(0.0).cast("float")).alias("score"),
        sign(F.col("strand")).alias("strand"),
        "phase",
        attributes(F.col("attributes")).alias("attributes"),
    )


def attribute_columns(table: DataFrame, names: list[str] | None = None, drop_incomplete: bool = False) -> DataFrame:
    """Attributes as columns; missing ones are null.  drop_incomplete leaves out those that do not occur exactly once in every
    row.  Without names, all keys of the table are used, which are few in any real file."""
    keys = names or sorted(r.k for r in table.select(F.explode(F.map_keys("attributes")).alias("k")).distinct().collect())
    if drop_incomplete:
        once = table.agg(*[F.bool_and(F.coalesce(F.size(F.col("attributes")[k]) == 1, F.lit(False))).alias(f"c{i}") for i, k in enumerate(keys)]).first()
        keys = [k for i, k in enumerate(keys) if once[f"c{i}"]]
    return table.select(*[c for c in table.columns if c != "attributes"], *[F.array_join(F.col("attributes")[k], ",").alias(k) for k in keys])


def gff_as_bed(table: DataFrame) -> DataFrame:
    return table.select("chr", "start", "end", F.col("feature").alias("label"), "score")


def gff_as_json(table: DataFrame) -> DataFrame:
    """(json): one object for each row; of repeated attributes the last one."""
    last = F.transform_values("attributes", lambda k, v: F.element_at(v, -1))
    return table.select(F.to_json(F.struct("chr", "feature", "source", "start", "end", "score", "strand", last.alias("attributes"))).alias("json"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of six columns, strand as 1, -1 or 0; rows without a chromosome are left out."""
    return delimited(spark, path, BED).where("chr is not null and chr <> ''").withColumn("strand", sign(F.col("strand")))


def save_intervals(table: DataFrame, path: str) -> None:
    """A folder for each feature (if there is one) and chromosome, each file in order of start and end."""
    parts = [c for c in ("feature", "chr") if c in table.columns]
    table.repartition(*parts).sortWithinPartitions(*parts, "start", "end").write.mode("append").partitionBy(*parts).parquet(path)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq.  Records are parted by the reader itself, so a file of any size is split."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "")
    body = F.when(F.locate("\n", record) > 0, F.substring(record, F.locate("\n", record) + 1, F.length(record))).otherwise("")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.regexp_replace(body, r"[^\x21-\x7E]", "").alias("seq"))


def fastq(spark: SparkSession, path: str, wrapped: bool = False) -> DataFrame:
    """name, comment, seq, qual; a record whose quality is not as long as its sequence is an error.

    Records of four lines: a quality line may itself start with @, so records are put together from numbered lines.  Lines are
    numbered within each split, and what comes before a split is added from one row for each, so a file of any size is read by
    many tasks.  wrapped: sequences and qualities may go over several lines (see weftline.sources.wrapped).
    """
    if wrapped:
        return wrapped_fastq(spark, path)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = written(spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("n")), "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", (F.coalesce(F.sum("lines").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    k = F.col("n") + F.col("shift")
    placed = lines.join(F.broadcast(offsets), ["file", "block"]).select("file", "value", k.alias("k"))
    four = placed.groupBy("file", F.expr("k div 4").alias("r")).agg(*[F.max(F.when(F.col("k") % 4 == i, F.rtrim(F.regexp_replace("value", "\r$", "")))).alias(c) for i, c in enumerate(("head", "seq", "plus", "qual"))])
    real = four.where("head <> '' or seq <> ''")  # lines after the last record may be empty
    checked = F.when(F.length("qual") == F.length("seq"), F.col("qual")).otherwise(F.raise_error(F.concat(F.lit("quality and sequence differ in length: "), F.col("head"))))
    return real.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.regexp_extract("head", r"^@\S*\s+(.*)$", 1).alias("comment"), "seq", checked.alias("qual"))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq of a FASTQ file (by its suffix) or a FASTA file."""
    named = path.removesuffix(".gz").lower()
    return (fastq(spark, path).drop("qual") if named.endswith((".fq", ".fastq")) else fasta(spark, path)).select("name", "comment", "seq")


def obo(spark: SparkSession, path: str) -> DataFrame:
    """id, ontology, fields (map of arrays) and xref (map of arrays by database) of each [Term]; other stanzas are left out.
    Stanzas are parted where a line starts with a bracket, whatever ends the lines."""
    stanzas = spark.read.option("lineSep", "\n[").text(path)
    header = stanzas.where(r"value NOT RLIKE '^\\[?[A-Za-z]+\\]'").select(F.regexp_extract("value", r"(?m)^ontology:\s*(\S+)", 1).alias("o"), F.regexp_extract("value", r"(?m)^default-namespace:\s*(\S+)", 1).alias("d")).agg(F.max("o").alias("o"), F.max("d").alias("d")).first()
    ontology = (header.o or header.d or "") if header else ""
    terms = stanzas.where(r"value RLIKE '^\\[?Term\\]'")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^[^\[:\s]+:"))
    key = lambda x: F.regexp_extract(x, r"^([^:]+):", 1)
    value = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1), '"', ""), r" ! .*$", ""))
    names = F.array_distinct(F.filter(F.transform("lines", key), lambda k: k != "xref"))
    fields = F.map_from_arrays(names, F.transform(names, lambda k: F.transform(F.filter("lines", lambda x: key(x) == k), value)))
    refs = F.transform(F.filter("lines", lambda x: key(x) == "xref"), value)
    base = lambda x: F.substring_index(x, ":", 1)
    bases = F.array_distinct(F.transform(refs, base))
    xref = F.map_from_arrays(bases, F.transform(bases, lambda d: F.transform(F.filter(refs, lambda x: base(x) == d), lambda x: F.regexp_replace(x, r"^[^:]*:", ""))))
    return terms.select(lines.alias("lines")).select(fields.alias("fields"), xref.alias("xref")).select(F.col("fields")["id"][0].alias("id"), F.lit(ontology).alias("ontology"), "fields", "xref")


def gi_taxid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="gi long, tax long", sep="\t")


def taxonomy_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tax, parent) of a nodes dump."""
    parts = F.split("value", r"\t\|\t?")
    return spark.read.text(path).select(parts[0].cast("long").alias("tax"), parts[1].cast("long").alias("parent"))


def save_by_taxonomy(sequences: DataFrame, gi_tax: DataFrame, paths: DataFrame, folder: str, least: int = 32, file_bytes: int = 128 << 20) -> None:
    """Sequences of at least a length as text under a folder for each taxonomy path.  A header that lists several gi numbers
    counts as its least; sequences without a known one are dropped.  A path is dealt over as many files as its bytes fill, known
    from a count before, so one that has most of the sequences is written by many tasks."""
    numbers = F.transform(F.regexp_extract_all(F.concat_ws(" ", "name", "comment"), F.lit(r"gi\|(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    own = sequences.where(F.length("seq") >= least).withColumn("gi", F.array_min(numbers))
    met = own.join(gi_tax, "gi").join(paths.select(F.col("node").cast("long").alias("tax"), F.col("path").alias("tax_path")), "tax")
    lines = written(met.select("tax_path", F.concat(F.lit(">"), F.concat_ws(" ", "name", "comment"), F.lit("\n"), F.col("seq")).alias("value")), "taxa")
    heavy = lines.groupBy("tax_path").agg(F.ceil(F.sum(F.octet_length("value")) / file_bytes).alias("files")).where("files > 1")
    part = F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.coalesce("files", F.lit(1)))
    dealt = lines.join(heavy, "tax_path", "left").select("tax_path", "value", part.alias("part"))
    dealt.repartition("tax_path", "part").drop("part").write.mode("append").partitionBy("tax_path").text(folder)


def infer_types(df: DataFrame, wide_floats: bool = True, most_categories: int = 256) -> DataFrame:
    """(name, type) of each string column from its values, in one aggregate: the narrowest integer type, float, category (few
    values) or text.  wide_floats accepts any decimal number; otherwise at most one digit may stand before the point."""
    number = r"^-?\d*\.?\d+([eE][+-]?\d+)?$" if wide_floats else r"^-?\d?\.\d+$"
    measures = []
    for k, c in enumerate(df.columns):
        x, n = F.col(f"`{c}`"), F.expr(f"try_cast(`{c}` AS bigint)")
        measures += [F.bool_and(x.rlike(r"^\d+$")).alias(f"u{k}"), F.bool_and(x.rlike(r"^-?\d+$")).alias(f"i{k}"), F.bool_and(x.rlike(number)).alias(f"f{k}"), F.min(n).alias(f"lo{k}"), F.max(n).alias(f"hi{k}"), F.count(x).alias(f"n{k}")]
    one = df.agg(*measures)

    def kind(k: int) -> Column:
        u, i, f, lo, hi, n = (F.col(f"{p}{k}") for p in ("u", "i", "f", "lo", "hi", "n"))
        unsigned = F.when(hi <= 255, "UBYTE").when(hi <= 65535, "USHORT").when(hi <= 4294967295, "UINT").otherwise("ULONG")
        signed = F.when((lo >= -128) & (hi <= 127), "BYTE").when((lo >= -32768) & (hi <= 32767), "SHORT").when((lo >= -(1 << 31)) & (hi < (1 << 31)), "INT").otherwise("LONG")
        return F.when(u, unsigned).when(i, signed).when(f, "FLOAT").when(n <= most_categories, "CATEGORY").otherwise("TEXT")

    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), kind(k).alias("type")) for k, c in enumerate(df.columns)])).alias("r")).select("r.*")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def as_columns(df: DataFrame) -> dict[str, list]:
    """A small result as {column: values}, as query clients want it."""
    table = df.toArrow()
    return {name: table.column(name).to_pylist() for name in table.column_names}
