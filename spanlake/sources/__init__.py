"""Readers and writers of the text formats, all through Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions import decode_samples, decode_sources, encode_samples, encode_sources
from spanlake.model import FEATURE_TEXT
from spanlake.operators.genes import gene_spans
from spanlake.operators.intervals import BIN, dense_ids, level_of
from spanlake.operators.stats import dense_ids_of, infer_types


def _tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = False) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "").option("comment", "")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def _lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated text columns; a row of fewer has nulls."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Seventeen tab-separated columns; a header line, if any, is passed over."""
    raw = _tsv(spark, path, FEATURE_TEXT).where("feature_id is not null")
    return raw.withColumns({"annotated": ~F.coalesce("annotated", F.lit("0")).isin("0", ""), "left_sources": decode_sources("left_sources"), "right_sources": decode_sources("right_sources"), "samples": decode_samples("samples")})


def feature_text(df: DataFrame) -> DataFrame:
    """Features in the columns of their text form."""
    out = df.withColumns({"annotated": F.col("annotated").cast("int").cast("string"), "left_sources": encode_sources("left_sources"), "right_sources": encode_sources("right_sources"), "samples": encode_samples("samples")})
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_TEXT))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata: a header line, all columns text but the first, which is the integer id."""
    raw = _tsv(spark, path, header=True)
    return raw.withColumn(raw.columns[0], F.col(raw.columns[0]).cast("long"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, "`group` string, long_name string, n long, ids string")
    return raw.withColumn("sids", F.transform(F.split("ids", ","), lambda x: x.cast("long"))).drop("ids")


def read_bases(spark: SparkSession, path: str) -> DataFrame:
    """Wide coverage (chrom, start, end, a column for each sample id; a header in each file) in long form, values as double, missing ones left out.

    A line is one array, whose places are told by the header of its file: however many samples a file has, no column of the plan stands for one.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    cut = lambda df: df.select("file", F.split("value", "\t").alias("cells"))
    titled = F.col("value").rlike(r"^chrom\tstart\tend(\t|$)")
    header = cut(lines.where(titled)).select("file", F.posexplode("cells").alias("place", "sid")).where("place > 2").select("file", "place", F.col("sid").cast("long").alias("sid"))
    rows = cut(lines.where(~titled & (F.col("value") != ""))).select("file", *(F.col("cells")[i].alias(c) for i, c in enumerate(("chrom", "start", "end"))), F.posexplode("cells").alias("place", "text"))
    values = rows.where("place > 2").withColumn("value", F.expr("try_cast(text AS DOUBLE)")).where("value is not null")
    return values.join(header.distinct(), ["file", "place"]).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "sid", "value")


def write_bases(bases: DataFrame, path: str, files: int = 32) -> None:
    """Long coverage (chrom, start, end, sid, value) as wide text that `read_bases` reads: a line for each place, a cell for each sample, a header in each file.

    A line is written gap by gap from its sorted entries, so no column of the plan stands for a sample. Of several values the largest is kept; entries without a sample have no cell.
    """
    own = bases.where("sid is not null").groupBy("chrom", "start", "end", "sid").agg(F.max("value").alias("value"))
    ids = dense_ids_of(own.select("sid"), "sid").select("sid", F.col("id").cast("int").alias("at"))
    header = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sid"))), lambda x: x["sid"].cast("string")).alias("sids"))
    lists = own.join(ids.hint("merge"), "sid").groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("text")))).alias("e"))
    tabs = lambda n: F.repeat(F.lit("\t"), n)
    cells = F.array_join(F.transform("e", lambda x, i: F.concat(tabs(x["at"] - F.coalesce(F.get("e", i - 1)["at"], F.lit(-1))), F.coalesce(x["text"], F.lit("")))), "")
    lines = lists.crossJoin(F.broadcast(ids.agg((F.max("at") + 1).alias("n")))).select(F.concat(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")), cells, tabs(F.col("n") - 1 - F.element_at("e", -1)["at"])).alias("value"), F.pmod(F.xxhash64("chrom", "start", "end"), F.lit(files)).alias("file"))
    titles = bases.sparkSession.range(files).crossJoin(header).select(F.concat_ws("\t", F.lit("chrom"), F.lit("start"), F.lit("end"), F.array_join("sids", "\t")).alias("value"), F.col("id").alias("file"))
    both = lines.withColumn("line", F.lit(1)).unionByName(titles.withColumn("line", F.lit(0)))
    both.repartition(files, "file").sortWithinPartitions("file", "line").select("value").write.text(path)


GTF = ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"]


def read_gtf(spark: SparkSession, path: str, feature: str = "exon") -> DataFrame:
    """Exons of a GTF file: comments, rows of another feature, without ids or with start >= end go."""
    raw = _lines(spark, path, GTF).where(~F.col("chrom").startswith("#") & (F.col("feature") == feature))
    value = lambda k: F.regexp_extract("attributes", rf'(?:^|;)\s*{k} "?([^";]+)"?', 1)
    out = raw.select("chrom", "source", F.expr("try_cast(start AS BIGINT)").alias("start"), F.expr("try_cast(end AS BIGINT)").alias("end"), "strand", value("gene_id").alias("gene"), value("transcript_id").alias("tx"))
    return out.where("start < end and gene <> '' and tx <> ''")


def read_gff3(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """Rows of a kind from a GFF3 file, with the attributes as a map."""
    raw = _lines(spark, path, GTF).where(~F.col("chrom").startswith("#") & (F.col("feature") == feature))
    return raw.select("chrom", "source", F.expr("try_cast(start AS BIGINT)").alias("start"), F.expr("try_cast(end AS BIGINT)").alias("end"), "strand", F.expr("str_to_map(attributes, ';', '=')").alias("attributes"))


def read_gene_symbols(spark: SparkSession, path: str, max_gap: int = 10_000) -> DataFrame:
    """Spans of genes from (name, -, chrom, strand, start, end, ...), starts 0-based."""
    raw = _lines(spark, path, ["gene", "_", "chrom", "strand", "start", "end"])
    return gene_spans(raw.select(F.upper("gene").alias("gene"), "chrom", (F.col("start").cast("long") + 1).alias("start"), F.col("end").cast("long").alias("end")), max_gap)


def _numbers(text: str) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("long"))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical transcripts (name, chrom, strand, start, end, exon starts, exon ends, gene), starts 0-based."""
    raw = _lines(spark, path, ["tx", "chrom", "strand", "start", "end", "exon_starts", "exon_ends", "gene"])
    return raw.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "exon_starts": _numbers("exon_starts"), "exon_ends": _numbers("exon_ends")})


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Consolidated transcripts: GTF columns, attributes transcript_id, cds_span and exons (start-end, comma separated)."""
    raw = _lines(spark, path, GTF)
    value = lambda k: F.regexp_extract("attributes", rf'(?:^|;)\s*{k} "?([^";]*)"?', 1)
    exons = F.transform(F.filter(F.split(value("exons"), ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("long").alias("start"), F.split_part(x, F.lit("-"), F.lit(2)).cast("long").alias("end")))
    return raw.select("chrom", "source", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", value("transcript_id").alias("tx"), (value("cds_span") != "").alias("coding"), exons.alias("exons")).withColumn("n_exons", F.size("exons"))


def read_raw_junctions(spark: SparkSession, path: str) -> DataFrame:
    raw = _lines(spark, path, ["chrom", "strand", "start", "end", "sids", "covs"])
    return raw.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "sids": _numbers("sids"), "covs": _numbers("covs")})


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat elements (columns 6, 7, 8, 10, 11, 12 of their table), starts made 1-based, once for each place."""
    raw = _lines(spark, path, ["_1", "_2", "_3", "_4", "_5", "chrom", "start", "end", "_9", "strand", "name", "class"])
    return raw.select("chrom", (F.col("start").cast("long") + 1).alias("start"), F.col("end").cast("long").alias("end"), "strand", "name", "class").dropDuplicates(["chrom", "start", "end"])


def read_genepred(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """Gene predictions, their columns shifted by `offset`: tx, chrom, strand, arrays of exon starts (0-based) and ends."""
    raw = _lines(spark, path, [*(f"_{i}" for i in range(offset)), "tx", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "n_exons", "starts", "ends"])
    return raw.select("tx", "chrom", "strand", _numbers("starts").alias("exon_starts"), _numbers("ends").alias("exon_ends"))


def write_clustered(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet by chromosome, in order of start and end, so that row groups hold narrow ranges."""
    dealt = df.repartitionByRange(partitions, "chrom", "start") if partitions else df.repartitionByRange("chrom", "start")
    dealt.sortWithinPartitions("chrom", "start", "end").write.partitionBy("chrom").parquet(path)


def write_levelled(df: DataFrame, path: str, width: int = BIN, partitions: int | None = None) -> None:
    """Parquet by chromosome, in order of level and start: column level (see `level_of`) parts short features from long ones, so that a region's scan (`in_region` with levels)
    looks back no further than a level's features are long, and few long ones don't widen it for all."""
    own = df.withColumn("level", level_of(F.col("end") - F.col("start") + 1, width))
    dealt = own.repartitionByRange(partitions, "chrom", "level", "start") if partitions else own.repartitionByRange("chrom", "level", "start")
    dealt.sortWithinPartitions("chrom", "level", "start", "end").write.partitionBy("chrom").parquet(path)


def to_tsv_rows(df: DataFrame, prefix: str, fields: list[str] | None = None) -> DataFrame:
    """One text column: the prefix, then the fields."""
    return df.select(F.concat_ws("\t", F.lit(prefix), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (fields or df.columns))).alias("line"))


def write_tsv(df: DataFrame, path: str, prefix: str, fields: list[str] | None = None) -> None:
    to_tsv_rows(df, prefix, fields).write.text(path)


def to_bed(df: DataFrame, score_by: str = "samples_count", name: str = "feature_id") -> DataFrame:
    return df.select("chrom", (F.col("start") - 1).alias("chrom_start"), F.col("end").alias("chrom_end"), F.col(name).cast("string").alias("name"), F.col(score_by).alias("score"), "strand")


def to_bedgraph(bases: DataFrame, op: str = "sum") -> DataFrame:
    value = F.sum("value") if op == "sum" else F.avg("value")
    return bases.groupBy("chrom", "start", "end").agg(value.alias("value"))


def to_scored_bed(df: DataFrame) -> DataFrame:
    """BED rows whose score is the least of 1000 and 200 times the logarithm of samples_count, whole."""
    score = F.least(F.lit(1000), F.floor(F.log("samples_count") * 200)).cast("long")
    return to_bed(df.withColumn("_score", score), "_score").withColumnRenamed("_score", "score")


def write_bed_shards(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most so many BED rows."""
    df.select("chrom", (F.col("start") - 1).alias("s"), "end", F.lit("").alias("a"), F.lit("").alias("b"), "strand").write.option("maxRecordsPerFile", rows).option("sep", "\t").option("emptyValue", "").csv(path)


def matrix_market(df: DataFrame, order: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The triples (row, column, value), 1-based, and one row of dimensions of the matrix of features by samples.

    order: sid, column (1-based). keep: samples to restrict to; features without any of these are left out and not numbered.
    Rows are numbered in coordinate order.
    """
    if keep is not None:
        order = order.join(keep.select("sid").distinct(), "sid", "left_semi")
        order = order.withColumn("column", F.row_number().over(Window.orderBy("column")))
    entries = df.select("feature_id", "chrom", "start", F.explode("samples").alias("e")).select("feature_id", "chrom", "start", "e.sid", "e.cov").join(order, "sid")
    rows = dense_ids(entries.select("feature_id", "chrom", "start").distinct() if keep is not None else df.select("feature_id", "chrom", "start"), ["feature_id"], name="row").select("feature_id", (F.col("row") + 1).alias("row"))
    triples = entries.join(rows, "feature_id").select("row", F.col("column").cast("long").alias("column"), F.col("cov").alias("value"))
    dims = rows.agg(F.count("*").alias("n_rows")).join(order.agg(F.count("*").alias("n_columns"))).join(triples.agg(F.count("*").alias("n_values")))
    return triples, dims


def write_matrix_market(df: DataFrame, path: str, order: DataFrame, keep: DataFrame | None = None) -> None:
    """A folder of text whose part files, one after the other in order of their names, are the file: header, sizes, then entries by row and column."""
    triples, dims = matrix_market(df, order, keep)
    head = dims.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("column"), F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n"), F.concat_ws(" ", "n_rows", "n_columns", "n_values")).alias("line"))
    lines = head.unionByName(triples.select(F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), F.concat_ws(" ", "row", "column", "value").alias("line")))
    lines.orderBy("row", "column").select("line").write.text(path)


def registry(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, fields): a map from each metadata field to its type."""
    out = None
    for name, df in datasets.items():
        one = infer_types(df.select(*(F.col(c).cast("string") for c in df.columns)), df.columns).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "type")))).alias("fields"))


def fields_table(df: DataFrame) -> DataFrame:
    """Ordinal, name and type of the columns, and how many rows have a value in each."""
    rows = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "ordinal long, field string, type string")
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).unpivot([], df.columns, "field", "n_values")
    return rows.join(counts, "field").select("ordinal", "field", "type", "n_values")


