"""Registration, and the vehicle tables derived from the given ones, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid import schemas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col: Column | str) -> Column:
    return F.round(col, 6) + F.lit(0.0)


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def stamp(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# Raw make spellings given to parts in turn, and what they become.
RAW_MAKES = ("Chevy", "bwm", "MAZDA", " land-rover ", "acura", "benz", "ford", "honda")
CANONICAL_MAKES = (
    "Chevrolet", "BMW", "Mazda", "Land Rover", "Acura", "Mercedes-Benz", "Ford", "Honda")
FLAG_VIEWS = {
    ("A", "F"): "front", ("A", "O"): "rear", ("N", "F"): "side",
    ("N", "O"): "three-quarter-front", ("R", "F"): "three-quarter-rear", ("R", "O"): "interior",
}
NOW = "2002-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as listings without canonical labels."""
    part = table(spark, sf, "part")
    year = F.when(F.col("p_size") % 17 != 0, 2008 + F.col("p_size") % 8)
    fields = {
        "listing_id": F.col("p_partkey").cast("string"), "source": F.col("p_type"),
        "url": F.concat(F.lit("http://l/"), F.col("p_partkey")), "year": year,
        "make": pick(RAW_MAKES, F.col("p_partkey") % 8), "model": F.split("p_name", " ")[1],
        "trim": F.split("p_name", " ")[0], "mileage": F.floor("p_retailprice"),
        "scraped_at": F.timestamp_add("DAY", F.col("p_size"), F.lit("2001-01-01").cast("timestamp")),
    }
    return part.select(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.LISTINGS.fields])


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    from motorgrid.plans.labelling import canonicalize

    return canonicalize(listings(spark, sf))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as images; the split is the hash split of the id."""
    from motorgrid.functions.calc import hash_split

    view = None
    for (flag, status), name in FLAG_VIEWS.items():
        test = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        view = F.when(test, name) if view is None else view.when(test, name)
    view = F.when(F.col("l_tax") < 0.075, view)
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    fields = {
        "image_id": key, "listing_id": F.col("l_partkey").cast("string"),
        "source_url": F.concat(F.lit("http://i/"), key),
        "local_path": F.when(F.col("l_linenumber") < 7, F.concat(F.lit("p/"), key)).otherwise(""),
        "width": F.col("l_quantity") * 20 + 200, "height": F.col("l_linenumber") * 100 + 200,
        "bytes": F.col("l_extendedprice"),
        "position": F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")),
        "downloaded_at": F.col("l_shipdate"), "view": view,
        "view_score": 0.5 + 4 * F.col("l_discount"), "split": hash_split(key),
    }
    return table(spark, sf, "lineitem").select(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.IMAGES.fields])


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as queue items."""
    error = F.when(F.col("o_custkey") % 5 == 4, F.concat(F.lit("e"), F.col("o_custkey")))
    claimed = F.when(F.col("o_orderkey") % 5 == 1, F.col("o_orderdate"))
    fields = {
        "url": F.concat(F.lit("http://q/"), F.col("o_orderkey")),
        "source": pick(K.QUEUE_SOURCES, F.col("o_custkey") % 6),
        "kind": pick(K.QUEUE_KINDS, F.col("o_orderkey") % 3),
        "status": pick(K.QUEUE_STATUSES, F.col("o_orderkey") % 5),
        "attempts": F.col("o_custkey") % 6, "last_error": error,
        "next_try_at": F.col("o_orderdate"),
        "enqueued_at": F.timestamp_add("HOUR", -(F.col("o_custkey") % 24).cast("int"), F.col("o_orderdate")),
        "claimed_at": claimed,
    }
    return table(spark, sf, "orders").select(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.CRAWL_QUEUE.fields])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as labelled images with make, view and era taken from the part of that key."""
    from motorgrid.functions.calc import era_bucket, hash_split

    vec = table(spark, sf, "embeddings")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("vec_id"), F.col("p_brand").alias("make"), "p_size")
    year = F.when(F.col("p_size") % 13 != 0, 1980 + F.col("p_size"))
    return vec.join(part, "vec_id").select(
        F.col("vec_id").cast("string").alias("query_id"), "embedding",
        F.concat_ws("|", F.lit("2012"), F.concat(F.lit("make"), "label"),
                    F.concat(F.lit("model"), "label")).alias("class_id"),
        "label",
        F.when(F.col("vec_id") % 7 != 6, pick(K.EXTERIOR_VIEWS, F.col("vec_id") % 5)).alias("view"),
        "make", era_bucket(year).alias("era"),
        hash_split(F.col("vec_id").cast("string")).alias("split"))


HASH_SPLIT_SQL = (
    "CASE WHEN ('0x' || substr(sha1({0}), 1, 2))::INT % 10 < 8 THEN 'train' "
    "WHEN ('0x' || substr(sha1({0}), 1, 2))::INT % 10 = 8 THEN 'val' ELSE 'test' END")

_VIEW_CASE = " ".join(
    f"WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN '{v}'"
    for (f, s), v in FLAG_VIEWS.items())

VIEWS_SQL = {
    "v_listings": f"""
        SELECT p_partkey::VARCHAR AS listing_id, p_type AS source, 'http://l/' || p_partkey AS url,
          CASE WHEN p_size % 17 <> 0 THEN 2008 + p_size % 8 END AS year,
          ({sql_list(RAW_MAKES)})[p_partkey % 8 + 1] AS make, split_part(p_name, ' ', 2) AS model,
          split_part(p_name, ' ', 1) AS trim, floor(p_retailprice)::INT AS mileage,
          TIMESTAMP '2001-01-01' + to_days(p_size) AS scraped_at
        FROM part""",
    "v_canonical": f"""
        SELECT v_listings.*,
          ({sql_list(CANONICAL_MAKES)})[listing_id::BIGINT % 8 + 1] AS canonical_make,
          upper(model[1]) || lower(model[2:]) AS canonical_model,
          (1980 + floor((year - 1980) / 4.0) * 4)::INT AS generation_year
        FROM v_listings""",
    "v_images": f"""
        SELECT *, {HASH_SPLIT_SQL.format('image_id')} AS split FROM (
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS image_id,
          l_partkey::VARCHAR AS listing_id,
          CASE WHEN l_linenumber < 7 THEN 'p/' || concat_ws('-', l_orderkey, l_partkey, l_suppkey,
            l_linenumber) ELSE '' END AS local_path,
          floor(l_quantity * 20 + 200)::INT AS width, l_linenumber * 100 + 200 AS height,
          CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS position,
          l_shipdate AS downloaded_at,
          CASE WHEN l_tax < 0.075 THEN CASE {_VIEW_CASE} END END AS view,
          0.5 + 4 * l_discount AS view_score
        FROM lineitem)""",
    "v_queue": f"""
        SELECT 'http://q/' || o_orderkey AS url,
          ({sql_list(K.QUEUE_SOURCES)})[o_custkey % 6 + 1] AS source,
          ({sql_list(K.QUEUE_KINDS)})[o_orderkey % 3 + 1] AS kind,
          ({sql_list(K.QUEUE_STATUSES)})[o_orderkey % 5 + 1] AS status,
          (o_custkey % 6)::INT AS attempts,
          CASE WHEN o_custkey % 5 = 4 THEN 'e' || o_custkey END AS last_error,
          o_orderdate AS next_try_at, o_orderdate - to_hours((o_custkey % 24)::INT) AS enqueued_at,
          CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate END AS claimed_at
        FROM orders""",
    "v_vec": f"""
        SELECT vec_id::VARCHAR AS query_id, embedding::DOUBLE[] AS e,
          '2012|make' || label || '|model' || label AS class_id, label,
          CASE WHEN vec_id % 7 <> 6 THEN ({sql_list(K.EXTERIOR_VIEWS)})[vec_id % 5 + 1] END AS view,
          p_brand AS make,
          CASE WHEN p_size % 13 <> 0 THEN ((1980 + p_size) // 10 * 10) || 's' ELSE 'unknown' END
            AS era,
          {HASH_SPLIT_SQL.format('vec_id::VARCHAR')} AS split
        FROM embeddings JOIN part ON p_partkey = vec_id""",
    "v_means": """
        SELECT class_id, list(m ORDER BY pos) AS mean, max(n) AS n FROM (
          SELECT class_id, pos, avg(e[pos]) AS m, count(*) AS n
          FROM v_vec, range(1, 65) t(pos) WHERE split = 'train' GROUP BY class_id, pos)
        GROUP BY class_id""",
    "v_protos": """
        SELECT class_id, n, list_transform(mean, lambda x:
          x / sqrt(list_inner_product(mean, mean))) AS p FROM v_means""",
    "v_view_protos": """
        SELECT class_id, view, n, list_transform(mean, lambda x:
          x / sqrt(list_inner_product(mean, mean))) AS p FROM (
          SELECT class_id, view, list(m ORDER BY pos) AS mean, max(n) AS n FROM (
            SELECT class_id, view, pos, avg(e[pos]) AS m, count(*) AS n
            FROM v_vec, range(1, 65) t(pos) WHERE split = 'train' AND view IS NOT NULL
            GROUP BY class_id, view, pos) GROUP BY class_id, view)""",
    "v_ranked": """
        SELECT q.query_id, q.class_id AS true_class, q.make, q.view, q.era, p.class_id,
          list_inner_product(q.e, p.p) AS score,
          row_number() OVER (PARTITION BY q.query_id
            ORDER BY list_inner_product(q.e, p.p) DESC, p.class_id) AS rank
        FROM v_vec q, v_protos p WHERE q.split = 'test'""",
    "v_marked": """
        SELECT query_id, true_class, make, coalesce(view, 'unknown') AS view, era,
          max(CASE WHEN rank = 1 THEN class_id END) AS pred_class,
          max(CASE WHEN class_id = true_class THEN rank END) AS true_rank
        FROM v_ranked GROUP BY ALL""",
}
_NEEDS = {
    "v_canonical": ("v_listings",), "v_means": ("v_vec",), "v_protos": ("v_vec", "v_means"),
    "v_view_protos": ("v_vec",), "v_ranked": ("v_vec", "v_means", "v_protos"),
    "v_marked": ("v_vec", "v_means", "v_protos", "v_ranked"),
}


def over(views: str, body: str) -> str:
    """SQL body with the derived views it names in front."""
    wanted: list[str] = []
    for name in views.split():
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    head = ",\n".join(f"{name} AS ({VIEWS_SQL[name]})" for name in wanted)
    return f"WITH {head}\n{body}" if head else body
