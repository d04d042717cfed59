"""A loan tape derived from the generated test tables.

One loan per order. The values carry no meaning; they are arithmetic on keys,
written so that every engine computes the same ones. ``o_orderkey`` rides
along as ``row_key``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanbook.config import DEFAULT, TapeConfig
from loanbook.functions.ordered import shared_folder, staged, wide_rows
from loanbook.operators.clean import derive_columns, null_sentinels
from loanbook.sources.files import matching

# The synthetic tape, column by column.
TAPE_COLUMNS: tuple[tuple[str, str], ...] = (
    ("reporting_period", "'200208'"),
    ("pool_prefix", "concat(substring(cast(year(o.o_orderdate) AS VARCHAR),3,2),'DNA1')"),
    ("loan_id", "concat(substring(cast(year(o.o_orderdate) AS VARCHAR),3,2),'DNA1',lpad(cast(o.o_orderkey AS VARCHAR),8,'0'))"),
    ("property_state", "n.n_name"),
    ("servicer_name", "c.c_mktsegment"),
    ("orig_date", "cast(year(o.o_orderdate)*100+month(o.o_orderdate) AS VARCHAR)"),
    ("orig_interest_rate", "2.5e0 + cast((o.o_orderkey*13) % 500 AS DOUBLE)/100e0"),
    ("orig_loan_amount", "o.o_totalprice"),
    ("occupancy_status", "CASE o.o_orderkey % 7 WHEN 0 THEN 'S' WHEN 1 THEN 'I' ELSE 'P' END"),
    ("channel", "CASE o.o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'R' END"),
    ("property_type", "CASE o.o_custkey % 6 WHEN 0 THEN 'CO' WHEN 1 THEN 'PU' WHEN 2 THEN 'MH' ELSE 'SF' END"),
    ("loan_purpose", "CASE o.o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'C' ELSE 'N' END"),
    ("num_borrowers", "cast(1 + o.o_orderkey % 2 AS DOUBLE)"),
    ("first_time_homebuyer", "CASE WHEN o.o_custkey % 4 = 0 THEN 'Y' ELSE 'N' END"),
    ("credit_score", "cast(CASE WHEN o.o_custkey % 97 = 0 THEN 9999 ELSE 560 + (o.o_custkey*37) % 270 END AS DOUBLE)"),
    ("current_credit_score", "cast(CASE WHEN o.o_orderkey % 11 = 0 THEN 9999 ELSE 550 + (o.o_orderkey*29) % 290 END AS DOUBLE)"),
    ("ltv", "cast(CASE WHEN o.o_orderkey % 101 = 0 THEN 999 ELSE 30 + o.o_orderkey % 68 END AS DOUBLE)"),
    ("dti", "cast(CASE WHEN o.o_orderkey % 53 = 0 THEN 999 ELSE 10 + (o.o_orderkey*3) % 41 END AS DOUBLE)"),
    ("loan_age", "cast(CASE WHEN o.o_orderkey % 211 = 0 THEN NULL ELSE (2002-year(o.o_orderdate))*12 - month(o.o_orderdate) END AS DOUBLE)"),
    ("current_ib_upb", "CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_totalprice*(40e0+cast(o.o_orderkey % 60 AS DOUBLE))/100e0 END"),
    ("current_actual_upb", "CASE WHEN o.o_orderkey % 3 = 1 THEN o.o_totalprice*(35e0+cast(o.o_orderkey % 60 AS DOUBLE))/100e0 END"),
    ("current_deferred_upb", "CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_totalprice/10e0 END"),
    ("delinquency_status", "CASE WHEN o.o_orderkey % 100 < 88 THEN '00' WHEN o.o_orderkey % 100 < 92 THEN '01' WHEN o.o_orderkey % 100 < 94 THEN '02' WHEN o.o_orderkey % 100 < 95 THEN '03' WHEN o.o_orderkey % 100 < 97 THEN '07' WHEN o.o_orderkey % 100 < 98 THEN 'RA' WHEN o.o_orderkey % 100 < 99 THEN 'F' ELSE NULL END"),
    ("payment_history", "CASE WHEN o.o_orderkey % 307 = 0 THEN NULL WHEN o.o_orderkey % 311 = 0 THEN '0000' ELSE concat(translate(lpad(cast((o.o_orderkey*7919+11) % 999999999989 AS VARCHAR),12,'0'),'3456789','0000000'),translate(lpad(cast((o.o_orderkey*104729+o.o_custkey) % 999983 AS VARCHAR),12,'0'),'56789','0000X'),translate(lpad(cast((o.o_orderkey*15485863+o.o_custkey*31) % 999999999989 AS VARCHAR),12,'0'),'6789','00X0'),translate(lpad(cast((o.o_orderkey*32452843+o.o_custkey*17) % 999999999989 AS VARCHAR),12,'0'),'6789','00X0')) END"),
)

SPREAD = 2  # tasks a core that rows are dealt out to


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str, spread: bool = False, file: str | None = None) -> DataFrame:
    """The typed tape. Join strategies are left to the optimizer: the nation
    table is tiny, the customer side is broadcast only below Spark's limit.

    ``spread`` deals the rows out to all cores before columns are derived:
    that costs far more than reading them, and the files have few splits.
    ``file`` names the tape file of a row; then the rows of each file lie
    together, in order of the key, and ``_file`` has its name. They are moved
    before columns are derived, while they are narrow."""
    orders = _table(spark, sf_dir, "orders").alias("o")
    customers = _table(spark, sf_dir, "customer").alias("c")
    nations = _table(spark, sf_dir, "nation").alias("n")
    joined = orders.join(customers, F.expr("o.o_custkey = c.c_custkey")).join(
        nations, F.expr("c.c_nationkey = n.n_nationkey")
    )
    if spread:
        joined = joined.repartition(SPREAD * spark.sparkContext.defaultParallelism, "o.o_orderkey", "o.o_custkey", "o.o_totalprice")
    placed = []
    if file is not None:
        pool = dict(TAPE_COLUMNS)["pool_prefix"].replace("VARCHAR", "STRING")
        # As in the raw tape, where an unset field is empty.
        joined = joined.withColumn("_file", F.expr(file.replace("row_key", "o.o_orderkey").replace("pool_prefix", f"coalesce({pool}, '')")))
        joined = joined.repartition("_file").sortWithinPartitions("_file", "o.o_orderkey")
        placed = ["_file"]
    return joined.select(
        *placed,
        F.col("o.o_orderkey").alias("row_key"),
        *[F.expr(sql.replace("VARCHAR", "STRING")).alias(name) for name, sql in TAPE_COLUMNS],
    )


def loans(spark: SparkSession, sf_dir: str, cfg: TapeConfig = DEFAULT, spread: bool = False) -> DataFrame:
    """The loan table over the test tables."""
    return derive_columns(null_sentinels(tape(spark, sf_dir, spread).drop("row_key"), cfg), cfg)


# -- raw text with planted defects ---------------------------------------------

# What is wrong with some rows of the raw tape. ``{v}`` is the
# clean text of the column.
DEFECTS: dict[str, str] = {
    "credit_score": "CASE row_key % 997 WHEN 1 THEN 'abc' WHEN 2 THEN '1d' WHEN 3 THEN 'nan' WHEN 4 THEN ' 700 ' WHEN 5 THEN '' WHEN 6 THEN '0' ELSE {v} END",
    "dti": "CASE row_key % 499 WHEN 1 THEN 'n/a' WHEN 2 THEN '1_0' ELSE {v} END",
    "orig_date": "CASE row_key % 613 WHEN 1 THEN concat(substring({v},1,4),'13') WHEN 2 THEN concat(substring({v},1,4),'00') WHEN 3 THEN substring({v},1,4) WHEN 4 THEN '' ELSE {v} END",
    "delinquency_status": "CASE row_key % 701 WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN ' 04 ' WHEN 4 THEN 'X' ELSE {v} END",
    "orig_interest_rate": "CASE row_key % 811 WHEN 1 THEN '3.4995' WHEN 2 THEN '7..1' ELSE {v} END",
    "property_state": "CASE row_key % 907 WHEN 1 THEN '  ' ELSE {v} END",
    "current_ib_upb": "CASE row_key % 1013 WHEN 1 THEN '-5.25' ELSE {v} END",
}
# One file whose lines are too short for the schema, one of blank lines.
SHORT_FILE, BLANK_FILE = "00short_lld.txt", "00blank_lld.txt"
FLAT_FILE = f"CASE WHEN row_key % 500 = 0 THEN '{BLANK_FILE}' WHEN row_key % 50 = 0 THEN '{SHORT_FILE}' ELSE concat(pool_prefix,'_lld.txt') END"
RECORD_FILE = "concat(pool_prefix,'_records_lld.txt')"


def raw_tape(spark: SparkSession, sf_dir: str, cfg: TapeConfig = DEFAULT, file: str | None = None) -> DataFrame:
    """All 90 columns as tape text, defects included; unset fields are empty."""
    whole_numbers = set(cfg.names_of("int"))
    typed = tape(spark, sf_dir, file=file)
    kept = ["row_key"] if file is None else ["row_key", "_file"]

    def text(name: str):
        if name not in typed.columns:
            return F.lit("").alias(name)
        value = F.col(name)
        if name in whole_numbers:
            value = value.cast("long")
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    texts = typed.select(*kept, *[text(n) for n in cfg.names])
    return texts.select(
        *kept,
        *[
            F.expr(DEFECTS[n].replace("{v}", n)).alias(n) if n in DEFECTS else F.col(n)
            for n in cfg.names
        ],
    )


def _written(lines: DataFrame) -> DataFrame:
    with wide_rows(lines.sparkSession):
        return staged(lines)


def flat_lines(spark: SparkSession, sf_dir: str, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """``derived_flat_lines`` written down, as tapes are: what follows reads them."""
    return _written(derived_flat_lines(spark, sf_dir, cfg))


def derived_flat_lines(spark: SparkSession, sf_dir: str, cfg: TapeConfig = DEFAULT, placed: bool = False) -> DataFrame:
    """Lines of flat tape files, one file per pool, with lines that are too
    short, too long or blank, and two files that cannot be loaded. ``placed``
    lines lie file by file and in order, as ``tape_folder`` takes them."""
    raw = raw_tape(spark, sf_dir, cfg, FLAT_FILE if placed else None)
    line = F.concat_ws("|", *[F.col(n) for n in cfg.names])
    names = cfg.names
    key = F.col("row_key")
    value = (
        F.when(key % 500 == 0, "   ")
        .when(key % 50 == 0, F.concat_ws("|", *[F.col(n) for n in names[:60]]))
        .when(key % 1009 == 7, "")
        .when(key % 97 == 3, F.concat_ws("|", *[F.col(n) for n in names[:87]]))
        .when(key % 101 == 5, F.concat_ws("|", *[F.col(n) for n in names[:88]]))
        .when(key % 89 == 4, F.concat(line, F.lit("|x|x|x|x|x")))
        .otherwise(line)
    )
    file = F.col("_file") if placed else F.expr(FLAT_FILE)
    return raw.select(file.alias("file"), key.alias("line_order"), value.alias("value"))


def tape_folder(spark: SparkSession, *placed: DataFrame) -> str:
    """Write ``placed`` lines as real tape files into the shared folder, one
    per name, by all tasks at once; each finished part is moved to its file's
    name."""
    folder = f"{shared_folder(spark)}/tapes-{uuid.uuid4().hex}"
    for n, lines in enumerate(placed):
        with wide_rows(spark):
            lines.select("file", "value").write.partitionBy("file").text(f"{folder}/parts/{n}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/tapes"))
    for part in system.globStatus(path(f"{folder}/parts/*/file=*/part-*")) or []:
        name = part.getPath().getParent().getName()[len("file="):]
        system.rename(part.getPath(), path(f"{folder}/tapes/{name}"))
    return f"{folder}/tapes"


TORN_FILE = "00torn_lld.txt"


def tear(spark: SparkSession, folder: str) -> None:
    """Add a copy of a tape that lost its second half after its checksums were
    written, so that reading it fails. Only local file systems can be made to
    hold such a file."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    torn = jvm.org.apache.hadoop.fs.Path(f"{folder}/{TORN_FILE}")
    system = torn.getFileSystem(conf)
    if system.getScheme() != "file":
        raise RuntimeError("the damaged tape needs a local file system")
    whole = max(matching(spark, f"{folder}/*_lld.txt"), key=lambda s: s.getLen())
    jvm.org.apache.hadoop.fs.FileUtil.copy(system, whole.getPath(), system, torn, False, conf)
    system.getRaw().truncate(torn, whole.getLen() // 4 * 2 + 1)


def record_lines(spark: SparkSession, sf_dir: str, cfg: TapeConfig = DEFAULT) -> DataFrame:
    """``derived_record_lines`` written down."""
    return _written(derived_record_lines(spark, sf_dir, cfg))


def derived_record_lines(spark: SparkSession, sf_dir: str, cfg: TapeConfig = DEFAULT, placed: bool = False) -> DataFrame:
    """Lines of record-type files: headers, repeated records (the last one
    wins), originations without a performance record and lines without a loan.
    ``placed`` as above."""
    raw = raw_tape(spark, sf_dir, cfg, RECORD_FILE if placed else None)
    key = F.col("row_key")

    def record(kind: str, layout: dict[int, str], **changed: str):
        fields = [F.lit(kind)]
        for i in range(1, max(layout) + 1):
            if i == 1:
                fields.append(F.col("loan_id"))
            elif i not in layout:
                fields.append(F.lit(""))
            elif layout[i] in changed:
                fields.append(F.lit(changed[layout[i]]))
            else:
                fields.append(F.col(layout[i]))
        return F.concat_ws("|", *fields)

    origination, performance = cfg.origination_record, cfg.performance_record
    slots = [
        (key % 1000 == 0, F.lit("10|HEADER")),
        (key % 19 == 0, record("50", performance, delinquency_status="09")),
        (F.lit(True), record("20", origination)),
        (key % 13 != 0, record("50", performance)),
        (key % 17 == 0, record("20", origination, property_state="ZZ")),
        (key % 23 == 0, F.lit("20")),
    ]
    entries = F.array(
        *[
            F.struct((key * 8 + slot).alias("line_order"), F.when(present, value).alias("value"))
            for slot, (present, value) in enumerate(slots)
        ]
    )
    file = F.col("_file") if placed else F.expr(RECORD_FILE)
    exploded = raw.select(file.alias("file"), F.explode(entries).alias("line"))
    return exploded.select("file", "line.line_order", "line.value").filter(F.col("value").isNotNull())
