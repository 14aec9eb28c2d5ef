"""Scans of the formats that market data comes in, each one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ZONES, epoch_ns_to_eastern, truth
from ..operators.bars import validate

BAR_JSON = "Time string, Open double, High double, Low double, Close double, Volume double, WAP double, Count int"
VENDOR_CSV = "ticker string, volume long, open double, close double, high double, low double, window_start long, transactions int"
FILING_XML = """struct<
 issuer: struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>,
 reportingOwner: struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>,
   reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, officerTitle: string>>,
 aff10b5One: string,
 nonDerivativeTable: struct<nonDerivativeTransaction: array<{row}>>,
 derivativeTable: struct<derivativeTransaction: array<{row}>>>"""
_VALUE = "struct<value: string>"
_ROW = f"""struct<securityTitle: {_VALUE}, transactionDate: {_VALUE}, transactionCoding: struct<transactionCode: string>,
 transactionAmounts: struct<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}, transactionAcquiredDisposedCode: {_VALUE}>>"""


def eastern(time: Column) -> Column:
    """`yyyyMMdd HH:mm:ss <zone>` as Eastern wall-clock time; an unknown zone counts as Eastern."""
    at = F.try_to_timestamp(F.substring(time, 1, 17), F.lit("yyyyMMdd HH:mm:ss")).cast("timestamp_ntz")
    zone = F.trim(F.substring(time, 18, 64))
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.lower(zone))
    known = F.coalesce(alias, F.when(zone.rlike(r"^[A-Za-z_]+/[A-Za-z_/]+$|^UTC$"), zone), F.lit("America/New_York"))
    return F.convert_timezone(known, F.lit("America/New_York"), at)


def bars_json(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """JSON lines of bars: distinct lines, parsed permissively, with errors and warnings."""
    rows = spark.read.text(path).where(F.trim("value") != "").distinct().select(F.from_json("value", BAR_JSON).alias("r"))
    b = rows.select(
        F.lit(symbol).alias("symbol"),
        eastern(F.col("r.Time")).alias("ts"),
        F.col("r.Open").alias("open"),
        F.col("r.High").alias("high"),
        F.col("r.Low").alias("low"),
        F.col("r.Close").alias("close"),
        F.coalesce("r.Volume", F.lit(0.0)).alias("volume"),
        F.col("r.WAP").alias("wap"),
        F.greatest("r.Count", F.lit(0)).alias("count"),
    )
    return validate(b)


def bars_daily_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Date,Open,High,Low,Close,Volume: rows of a bad date, a price not positive or high < low are
    dropped, a bad volume is 0; wap is the close, count 1."""
    d = spark.read.csv(path, header=True, schema="Date string, Open string, High string, Low string, Close string, Volume string")
    n = lambda c: F.expr(f"try_cast({c} as double)")
    b = d.select(
        F.lit(symbol).alias("symbol"),
        F.expr("try_cast(Date as date)").cast("timestamp_ntz").alias("ts"),
        *[n(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.coalesce(n("Volume"), F.lit(0.0)).alias("volume"),
    )
    ok = F.col("ts").isNotNull() & (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.col("low"))
    ok = ok & F.col("open").isNotNull() & F.col("close").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    return b.where(ok).withColumns({"wap": F.col("close"), "count": F.lit(1)})


def bars_vendor_csv(spark: SparkSession, path: str, underlying: str | None = None, regular_hours: bool = True) -> DataFrame:
    """Minute aggregates of stocks and options, nanoseconds in UTC: Eastern time, 09:30 to 16:15."""
    d = spark.read.csv(path, header=True, schema=VENDOR_CSV)
    if underlying:
        own = r"^O:" + underlying + r"[0-9]{6}[CP][0-9]{8}$"
        d = d.where((F.col("ticker") == underlying) | F.col("ticker").rlike(own))
    d = d.withColumn("ts", epoch_ns_to_eastern(F.col("window_start")).cast("timestamp_ntz"))
    if regular_hours:
        minute = F.hour("ts") * 60 + F.minute("ts")
        d = d.where((minute >= 9 * 60 + 30) & (minute < 16 * 60 + 15))
    return d.withColumnsRenamed({"ticker": "symbol", "transactions": "count"})


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Files of any of three formats under path, told apart by what they say, in one scan: kind, symbol, ts, open, high, low, close, volume.

    A file with the vendor's header (ticker and window_start) holds minute aggregates, one with `Date,Open,...` daily
    prices, one of JSON objects bars; a file with a line that starts with # is a placeholder and gives nothing, as does an
    unknown one. symbol is the ticker, or the name of the file's folder; ts is Eastern. Lines that do not parse are
    dropped; no file, no rows.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    low = F.lower("value")
    says = {"placeholder": low.startswith("#"), "vendor": low.contains("ticker") & low.contains("window_start"), "daily": low.rlike(r"^date,\s*open,"), "json": low.startswith("{")}
    kinds = lines.groupBy("file").agg(*[F.max(c).alias(k) for k, c in says.items()])
    kind = F.when(F.col("placeholder"), "placeholder")
    for k in ("vendor", "daily", "json"):
        kind = kind.when(F.col(k), k)
    kinds = kinds.select(F.col("file").alias("_file"), kind.otherwise("unknown").alias("kind"))
    d = lines.join(kinds, F.col("file") == F.col("_file")).where(F.col("kind").isin("vendor", "daily", "json"))
    is_, folder = (lambda k: F.col("kind") == k), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    d = d.withColumns(
        {
            "v": F.when(is_("vendor"), F.from_csv("value", VENDOR_CSV)),
            "c": F.when(is_("daily"), F.from_csv("value", "Date date, Open double, High double, Low double, Close double, Volume double")),
            "j": F.when(is_("json"), F.from_json("value", BAR_JSON)),
        }
    )
    pick = lambda name: F.coalesce(F.col(f"v.{name.lower()}"), F.col(f"c.{name}"), F.col(f"j.{name}")).cast("double").alias(name.lower())
    ts = F.coalesce(epoch_ns_to_eastern(F.col("v.window_start")).cast("timestamp_ntz"), F.col("c.Date").cast("timestamp_ntz"), eastern(F.col("j.Time")))
    out = d.select("kind", F.when(is_("vendor"), F.col("v.ticker")).otherwise(folder).alias("symbol"), ts.alias("ts"), *[pick(c) for c in ("Open", "High", "Low", "Close", "Volume")])
    return out.where("ts is not null and open is not null and close is not null")


def vendor_path(kind: str, day: str, root: str = "") -> str:
    """<root><kind>_v1/YYYY/MM/YYYY-MM-DD.csv.gz"""
    y, m, _ = day.split("-")
    return f"{root}{kind}_v1/{y}/{m}/{day}.csv.gz"


def latest_files(df: DataFrame, n: int = 10) -> DataFrame:
    """The rows of the n newest files by the date in their name."""
    from pyspark.sql import Window

    day = F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1))
    d = df.select("*", day.alias("file_day"))
    days = d.select("file_day").distinct().withColumn("k", F.dense_rank().over(Window.orderBy(F.col("file_day").desc()))).where(F.col("k") <= n)
    return d.join(F.broadcast(days.select("file_day")), "file_day")  # n rows


def edgar_index(spark: SparkSession, path: str, form: str = "4", day: str | None = None) -> DataFrame:
    """A quarterly form index: rows after the rule of dashes, fields two or more spaces apart."""
    lines = spark.read.text(path)
    f = F.split("value", r"\s{2,}")
    d = lines.where(F.size(f) >= 5).select(
        F.trim(F.get(f, F.lit(0))).alias("form_type"),
        F.get(f, F.lit(1)).alias("company"),
        F.get(f, F.lit(2)).alias("cik"),
        F.expr("try_cast(split(value, '\\\\s{2,}')[3] as date)").alias("filing_date"),
        F.trim(F.get(f, F.lit(4))).alias("url"),
    )
    d = d.where((F.col("form_type") == form) & F.col("filing_date").isNotNull())
    if day:
        d = d.where(F.col("filing_date") == F.lit(day).cast("date"))
    return d.withColumn("accession", F.regexp_extract("url", r"(\d{10}-\d{2}-\d{6})", 1)).dropDuplicates(["accession"])


def form4(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Filings (accession, xml text) shredded to a row per transaction, derivatives marked."""
    d = filings.select("accession", F.from_xml(F.col(xml), FILING_XML.format(row=_ROW)).alias("x"))
    head = d.select(
        "accession",
        F.col("x.issuer.issuerTradingSymbol").alias("ticker"),
        F.col("x.reportingOwner.reportingOwnerId.rptOwnerName").alias("owner"),
        truth(F.col("x.reportingOwner.reportingOwnerRelationship.isDirector")).alias("is_director"),
        truth(F.col("x.reportingOwner.reportingOwnerRelationship.isOfficer")).alias("is_officer"),
        F.col("x.reportingOwner.reportingOwnerRelationship.officerTitle").alias("title"),
        F.coalesce(truth(F.col("x.aff10b5One")), F.lit(False)).alias("plan"),
        F.col("x.nonDerivativeTable.nonDerivativeTransaction").alias("plain"),
        F.col("x.derivativeTable.derivativeTransaction").alias("derived"),
    )
    names = [c for c in head.columns if c not in ("plain", "derived")]

    def rows(column: str, mark: str) -> DataFrame:
        t = head.select(*names, F.explode(column).alias("t"))
        amount = F.col("t.transactionAmounts")
        return t.select(
            *names,
            F.concat(F.lit(mark), F.coalesce("t.securityTitle.value", F.lit(""))).alias("security"),
            F.expr("try_cast(t.transactionDate.value as date)").alias("day"),
            F.col("t.transactionCoding.transactionCode").alias("code"),
            F.expr("try_cast(t.transactionAmounts.transactionShares.value as decimal(38,10))").alias("shares"),
            F.expr("try_cast(t.transactionAmounts.transactionPricePerShare.value as decimal(38,10))").alias("price"),
            amount["transactionAcquiredDisposedCode"]["value"].alias("direction"),
        )

    return rows("plain", "").unionByName(rows("derived", "[DERIVATIVE] "))


def triangle_wave(spark: SparkSession, low: float, high: float, cycles: int, n: int) -> DataFrame:
    """(i, value): n points of a triangle wave, by arithmetic on a range."""
    phase = (F.col("id") * cycles % n) / n
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(low) + (high - low) * (1 - F.abs(2 * phase - 1))).alias("value"))


def sine_wave(spark: SparkSession, n: int, p1: float, p2: float, p3: float, p4: float, p5: float) -> DataFrame:
    angle = F.col("id") / n * p1 * F.pi() * p2 + p5
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (p3 + p4 * F.sin(angle)).alias("value"))


def bars_from_closes(closes: DataFrame, minutes: int = 1440, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """symbol and an array of closes -> bars a step apart: each opens at the close before it (the first
    at its own) and spans both prices; wap is the close, volume and count 1."""
    d = closes.select("symbol", "closes", F.posexplode("closes").alias("i", "close"))
    before = F.coalesce(F.get("closes", F.col("i") - 1), F.col("close"))
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("i") * minutes).cast("int"))
    d = d.select("symbol", at.alias("ts"), before.alias("open"), "close")
    return d.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "wap": F.col("close"), "volume": F.lit(1), "count": F.lit(1)})
