"""Dates and numbers (N)."""

from pyspark.sql import functions as F

from cairn.functions import parse as X
from cairn.plans.registry import query

MONTH = "['January','February','March','April','May','June','July','August','September','October','November','December']"


@query("n01_informal_date", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') END AS day FROM orders")
def n01(t):
    d = F.col("o_orderdate")
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "MMMM d, yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "MMMM yyyy"))
        .otherwise("soon")
    )
    return t.orders.select("o_orderkey", X.informal_date(raw).alias("day"))


@query("n02_us_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def n02(t):
    raw = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yy"))
    return t.orders.select("o_orderkey", X.us_date(raw).alias("day"))


@query("n03_range", "SELECT p_partkey, p_size AS low, CASE WHEN p_size % 2 = 0 THEN p_size + 30 ELSE p_size END AS high FROM part")
def n03(t):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 == 0, F.concat(size, F.lit("-"), (F.col("p_size") + 30).cast("string"))).when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(" – "), (F.col("p_size") + 30).cast("string"), F.lit(" m"))).otherwise(F.concat(size, F.lit(" m")))
    return t.part.select("p_partkey", X.number_range(raw).alias("r")).select("p_partkey", "r.low", "r.high")


@query("n04_area_and_slope", "SELECT p_partkey, 1000.0 * (p_size % 3) + p_size + 0.5 AS area, CAST(p_size + 5 AS DOUBLE) AS slope FROM part")
def n04(t):
    size = F.col("p_size")
    written = F.concat(F.format_number(1000 * (size % 3) + size, 0), F.lit(".5"), F.when(size % 2 == 0, " ha").otherwise(""))  # with separators, the unit now and then
    return t.part.select("p_partkey", X.area(written).alias("area"), X.high_percent(F.concat(size.cast("string"), F.lit("-"), (size + 5).cast("string"), F.lit("%"))).alias("slope"))


@query("n05_size_and_unit", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 1000.0 ELSE CAST(p_size AS DOUBLE) END::DOUBLE AS ml FROM part")
def n05(t):
    return t.part.select("p_partkey", X.millilitres(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "l").otherwise("ml")).alias("ml"))


@query("n06_plain_number", "SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000 + 0.25 AS price, p_size / 100 AS dollars FROM part")
def n06(t):
    raw = F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(",000.25"))
    return t.part.select("p_partkey", X.plain_number(raw).alias("price"), (F.col("p_size") / 100).alias("dollars"))


@query("n07_number_words", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS n FROM lineitem")
def n07(t):
    words = F.array(*map(F.lit, X.NUMBER_WORDS))
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.initcap(words[F.col("l_linenumber")])).otherwise(F.col("l_linenumber").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", X.number_word(raw).alias("n"))


#: Prose, and the window it names for the vintage 2010 in 2024.
WINDOWS = [
    ("Will improve over the next 10 to 12 years", 2024, 2022), ("over the next twenty-five years!", 2024, 2035), ("Should develop over nine years", 2013, 2019),
    ("Enjoy now and over the next five years", 2024, 2015), ("Enjoy now and the next 6 years", 2024, 2030), ("drink now and for 4 more years", 2024, 2028),
    ("Best from 2018 to 2030", 2018, 2030), ("best starting 2020", 2020, 2030), ("Window: 2015 – 2025.", 2015, 2025), ("1970-1975", None, None), ("no window", None, None),
]


@query("n08_drinking_window", "SELECT p_partkey, [" + ", ".join(str(w[1] or "NULL") for w in WINDOWS) + '][p_size % 11 + 1] AS "start", [' + ", ".join(str(w[2] or "NULL") for w in WINDOWS) + '][p_size % 11 + 1] AS "end" FROM part')
def n08(t):
    prose = F.get(F.array(*[F.lit(w[0]) for w in WINDOWS]), F.col("p_size") % 11)
    return t.part.select("p_partkey", X.drinking_window(prose, F.lit(2010), F.lit(2024)).alias("w")).select("p_partkey", "w.start", "w.end")


#: Prose, and the window that it names from the vintage 2010 on.
FROM_VINTAGE = [
    ("Drink over the next ten to fifteen years.", 2010, 2025),
    ("Will develop for twenty-two years", 2010, 2032),
    ("Enjoy now and over the next 5 years", 2010, 2015),
    ("drink now and for fifty years", 2010, 2060),
    ("Best after 2016", 2016, 2031),
    ("2014 – 2029", 2014, 2029),
    ("over the next many years, best from 2018", 2018, 2033),
    ("2060-2070", None, None),
    ("for the next six to some years", None, None),
    ("", None, None),
]


@query("n08_from_vintage", "SELECT p_partkey, [" + ", ".join(str(w[1] or "NULL") for w in FROM_VINTAGE) + '][p_size % 10 + 1] AS "start", [' + ", ".join(str(w[2] or "NULL") for w in FROM_VINTAGE) + '][p_size % 10 + 1] AS "end" FROM part')
def n08_vintage(t):
    prose = F.get(F.array(*[F.lit(w[0]) for w in FROM_VINTAGE]), F.col("p_size") % 10)
    return t.part.select("p_partkey", X.window_from_vintage(prose, F.lit(2010)).alias("w")).select("p_partkey", "w.start", "w.end")


@query("n09_guarded", "SELECT p_partkey, CASE WHEN 1780 + p_size >= 1800 THEN 1780 + p_size END AS founded, CASE WHEN p_size % 10 > 0 THEN CAST(p_size % 10 AS BIGINT) * 1000 END AS cases FROM part")
def n09(t):
    raw = F.concat((F.col("p_size") % 10).cast("string"), F.lit(",000 cases"))
    return t.part.select("p_partkey", X.guarded_year((1780 + F.col("p_size")).cast("string")).alias("founded"), X.guarded_count(raw).alias("cases"))


@query("n10_months_and_percent", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS months, CAST(p_size + 1 AS DOUBLE) AS pct FROM part")
def n10(t):
    prose = F.format_string("Aged %d month%s in 85%% French oak, %d%% new", F.col("p_size"), F.when(F.col("p_size") > 1, "s").otherwise(""), F.col("p_size") + 1)
    return t.part.select("p_partkey", X.amount(prose, "month").alias("months"), X.new_share(prose).alias("pct"))


@query("n11_barcodes", "SELECT o_orderkey, length(CAST(o_orderkey AS VARCHAR) || '0000') BETWEEN 8 AND 14 AS valid FROM orders")
def n11(t):
    return t.orders.select("o_orderkey", X.is_barcode(F.concat("o_orderkey", F.lit("0000"))).alias("valid"))


@query("n12_key_prefix", "SELECT c_custkey, CAST(1000000 + c_custkey AS VARCHAR) AS prefix FROM customer")
def n12(t):
    """The product of a code of eleven digits, which goes on with the vintage."""
    code = F.concat((1000000 + F.col("c_custkey")).cast("string"), (2000 + F.col("c_nationkey")).cast("string"))
    return t.customer.select("c_custkey", F.substring(code, 1, 7).alias("prefix"))


@query("n13_cost", "SELECT conv_id, CAST(sum(length(text)) AS DOUBLE) * 0.25 / 1000000 AS cost FROM conversations GROUP BY conv_id")
def n13(t):
    return t.conversations.groupBy("conv_id").agg((F.sum(F.length("text")).cast("double") * 0.25 / 1000000).alias("cost"))


@query("n14_duration", "SELECT event_id, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS took FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events)")
def n14(t):
    return t.events.select("event_id", X.duration(F.floor(F.col("value") * 60)).alias("took"))
