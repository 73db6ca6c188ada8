"""The rental view over the star tables: a row for each line of an order, its texts made from whole numbers.

The same two SQL blocks run in Spark and in DuckDB, so results can be held against the numbers behind the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORE = """
select l.l_orderkey as listing_id, l.l_linenumber as run_no,
       l.l_partkey as k1, l.l_suppkey as k2, l.l_extendedprice as k3, l.l_shipdate as k4,
       o.o_orderdate as posted_at, o.o_custkey as seller_id, n.n_nationkey as place_no,
       n.n_name as district, r.r_name as city,
       cast(floor(o.o_totalprice / 5000) as int) + 10 + l.l_linenumber % 3 as tenths,
       cast(10 + (l.l_orderkey * 7) % 41 as int) as area_n,
       cast(l.l_linenumber * 30 + l.l_orderkey % 5 as int) as age_days
from lineitem l
join orders o on l.l_orderkey = o.o_orderkey
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
"""

TEXT = """
select core.*,
  case cast(listing_id % 8 as int)
    when 0 then concat(cast(cast(floor(tenths / 10) as int) as string), ',', cast(tenths % 10 as string), ' triệu/tháng')
    when 1 then concat(cast(cast(floor(tenths / 10) as int) as string), '.', cast(tenths % 10 as string), ' tr/tháng')
    when 2 then concat(cast(cast(floor(tenths / 10) as int) as string), 'tr', cast(tenths % 10 as string))
    when 3 then concat(cast(cast(floor(tenths / 10) as int) as string), '.', cast(tenths % 10 as string), '00.000đ/tháng')
    when 4 then 'Thỏa thuận'
    when 5 then concat(cast(cast(floor(tenths / 10) as int) as string), ' triệu rưỡi')
    when 6 then concat(cast(tenths * 100 as string), ' nghìn')
  end as price_raw,
  case cast(listing_id % 8 as int)
    when 4 then null when 7 then null
    when 5 then cast(cast(floor(tenths / 10) as int) as bigint) * 1000000 + 500000
    else cast(tenths as bigint) * 100000
  end as price_expected,
  case cast(listing_id % 3 as int)
    when 0 then concat(cast(area_n as string), ' m²')
    when 1 then concat(cast(area_n as string), 'm2')
  end as area_raw,
  case when listing_id % 3 < 2 then cast(area_n as double) end as area_expected,
  concat('Quận ', district, ', TP. ', city) as location_raw,
  concat('https://site', cast(listing_id % 2 as string), '.example.com/thue-phong-tro/', cast(listing_id as string), '.htm') as url,
  case cast(listing_id % 5 as int)
    when 0 then concat(cast(day(posted_at) as string), '/', cast(month(posted_at) as string), '/', cast(year(posted_at) as string))
    when 1 then concat(cast(age_days as string), ' ngày trước')
    when 2 then 'Hôm qua'
    when 3 then concat(cast(run_no as string), ' tháng trước')
  end as posted_at_raw
from core
"""

#: The start of an oracle: rental, with the expected price and area under the names that the queries give them.
ORACLE = f"with core as ({CORE}), rental as (select t.*, t.price_expected as price_vnd, t.area_expected as area_m2, t.posted_at + to_days(t.age_days) as crawled_at from ({TEXT}) t)"
#: And its last row of each listing.
LATEST = (
    f"{ORACLE}, latest as (select * exclude (nth) from (select *, row_number() over (partition by listing_id order by run_no desc, k1 desc, k2 desc, k3 desc, k4 desc) as nth from rental) x where nth = 1)"
)

TABLES = ("lineitem", "orders", "customer", "nation", "region")
ORDER = ["run_no", "k1", "k2", "k3", "k4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw view: texts, and the numbers they were made from."""
    core = spark.sql(CORE.replace("from lineitem", "from {lineitem}").replace("join orders", "join {orders}").replace("join customer", "join {customer}").replace("join nation", "join {nation}").replace("join region", "join {region}"), **{t: table(spark, sf_dir, t) for t in TABLES})
    view = spark.sql(TEXT.replace("from core", "from {core} core"), core=core)
    return view.withColumn("crawled_at", F.timestamp_add("DAY", F.col("age_days"), F.col("posted_at").cast("timestamp")))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """district, lat, lon of each nation's made-up centre."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("district"), (10 + key * 0.1).alias("lat"), (106 + key % 5 * 0.1).alias("lon"))


CENTROIDS = "centroids as (select n_name as district, 10 + n_nationkey * cast(0.1 as double) as lat, 106 + n_nationkey % 5 * cast(0.1 as double) as lon from nation)"
