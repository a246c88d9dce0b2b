"""The engine's queries over the test tables, each with its DuckDB equivalent.

Facts are line items with their supplier's nation as region; the dimension is nations
with a tier, one of them left out, so that an inner join drops its facts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.canonical import ColumnType
from tallyforge.operators.aggregate import SHARD
from tallyforge.operators.join import overlapping
from tallyforge.operators.rank import top_rows
from tallyforge.plans import catalog, templates
from tallyforge.plans.executor import Answer, Partials, Table, collect_groups, execute
from tallyforge.plans.planner import DirectoryRow, ShardKey
from tallyforge.sources import cold
from tallyforge.sources.loader import Ledger, LoadTable, Partition

INT8, TEXT, TIME, MONEY = ColumnType("int8"), ColumnType("text"), ColumnType("timestamptz"), ColumnType("numeric", 2)
TYPES = {"id": INT8, "region": TEXT, "amount": MONEY, "sparse": MONEY, "qty": INT8, "flag": TEXT, "line": INT8, "discount": MONEY, "shipped": TIME, "returned": TEXT}
ONE = (DirectoryRow("all"),)
LEFT_OUT = 7

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> str:
    return f"cast({column} as decimal(18,2))"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, region, amount and further columns; ``sparse`` is amount with nulls."""
    regions = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = _read(spark, sf_dir, "lineitem").join(regions, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "n_name as region", f"{_money('l_extendedprice')} as amount",
        f"case when (l_orderkey * 10 + l_linenumber) % 97 = 0 then null else {_money('l_extendedprice')} end as sparse",
        "cast(l_quantity as bigint) as qty", "l_linestatus as flag", "cast(l_linenumber as bigint) as line",
        f"{_money('l_discount')} as discount", "cast(l_shipdate as timestamp) as shipped",
        "case l_returnflag when 'R' then null when 'A' then '' else 'null' end as returned",
        "case when l_returnflag = 'A' then null else l_linestatus = 'F' end as filled",
    )


FACTS_SQL = """fact AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, n_name AS region, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN (l_orderkey * 10 + l_linenumber) % 97 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS sparse,
    CAST(l_quantity AS BIGINT) AS qty, l_linestatus AS flag, CAST(l_linenumber AS BIGINT) AS line,
    CAST(l_discount AS DECIMAL(18,2)) AS discount, CAST(l_shipdate AS TIMESTAMP) AS shipped,
    CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN '' ELSE 'null' END AS returned,
    CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus = 'F' END AS filled
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
DIM_SQL = f"dim AS (SELECT n_name AS region, n_nationkey % 3 + 1 AS tier FROM nation WHERE n_nationkey <> {LEFT_OUT})"


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").where(F.col("n_nationkey") != LEFT_OUT).selectExpr("n_name as region", "n_nationkey % 3 + 1 as tier")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, Table]:
    dim = Table("wh_probe_dim", {}, {"region": TEXT, "tier": INT8}, dimension(spark, sf_dir), (DirectoryRow("all", is_reference=True),))
    return {"wh_probe_agg": Table("wh_probe_agg", {}, TYPES, facts(spark, sf_dir), ONE), "wh_probe_dim": dim}


def request(select: list[tuple], table: str = "wh_probe_agg", **query) -> dict:
    """A request from ``(op, column or None, alias)`` triples and further clauses."""
    entries = [{"op": op, "alias": alias} | ({"col": col} if col else {}) for op, col, alias in select]
    return {"v": 1, "qid": "workload", "table": table, "query": {"select": entries, **query}}


def answer(spark: SparkSession, sf_dir: str, select: list[tuple], **query) -> Answer:
    return execute(request(select, **query), _tables(spark, sf_dir), lazy=True)


def settled(spark: SparkSession, answer: Answer) -> DataFrame:
    """The groups of an answer whose limits hold, at most as many as a response may have, without what was kept for them."""
    schema = answer.rows.schema
    try:
        return spark.createDataFrame(collect_groups(answer), schema)
    finally:
        answer.close()


_SQL_AGG = {
    "sum": "CAST(sum({c}) AS DECIMAL(38,{s})) AS {a}", "min": "CAST(min({c}) AS {t}) AS {a}", "max": "CAST(max({c}) AS {t}) AS {a}",
    "avg": "CAST(sum({c}) AS DECIMAL(38,{s})) AS {a}_num, nullif(count({c}), 0) AS {a}_den", "count": "count({c}) AS {a}",
}


def _aggregates(select: list[tuple]) -> str:
    out = []
    for op, col, alias in select:
        kind = TYPES.get(col)
        numeric = kind is not None and kind.name == "numeric"
        out.append(_SQL_AGG[op].format(c=col or "*", a=alias, s=2 if numeric else 0, t="DECIMAL(38,2)" if numeric else "BIGINT"))
    return ", ".join(out)


def _add(name: str, select: list[tuple], source: str = "fact", where: str = "", tail: str = "", ctes: str = FACTS_SQL, **query) -> None:
    """Registers a request on the facts and the SQL that says the same."""
    keys = query.get("groupBy") or []
    named = [f"fact.{k} AS {k}" if "JOIN" in source else k for k in keys]
    _queries[name] = lambda spark, sf_dir: answer(spark, sf_dir, select, **query).rows
    group = f" GROUP BY {', '.join(('fact.' if 'JOIN' in source else '') + k for k in keys)}" if keys else ""
    columns = _aggregates(select)
    if "JOIN" in source:
        columns = columns.replace("(amount)", "(fact.amount)").replace("(sparse)", "(fact.sparse)")
    _oracles[name] = f"WITH {ctes} SELECT {', '.join([*named, columns])} FROM {source}{' WHERE ' + where if where else ''}{group}{tail}"


SUM_COUNT = [("sum", "amount", "x"), ("count", None, "n")]
JOINED = [("sum", "sparse", "x"), ("count", "sparse", "c"), ("count", None, "n")]
BY_REGION = {"groupBy": ["region"]}
JOIN = {"table": "wh_probe_dim", "type": "inner", "on": {"left": "region", "right": "region"}}
TIER2 = JOIN | {"variant": "tier2"}
JOIN_SQL = "fact JOIN dim ON fact.region = dim.region"
TIER2_SQL = JOIN_SQL + " AND dim.tier = 2"
WITH_DIM = f"{FACTS_SQL}, {DIM_SQL}"

# Templates.
_add("w1_grouped_sum_count", SUM_COUNT, **BY_REGION)
_add("w2_scalar_minmax_countcol", [("min", "sparse", "lo"), ("max", "sparse", "hi"), ("count", "sparse", "c")])
_add("w3_scalar_avg_pair", [("avg", "sparse", "mean")])
_add("w6_join_agg", JOINED, JOIN_SQL, ctes=WITH_DIM, join=JOIN, **BY_REGION)
_add("w7_join_tier2", JOINED, TIER2_SQL, ctes=WITH_DIM, join=TIER2, **BY_REGION)
AVERAGED = [("avg", "sparse", "mean"), ("count", None, "n")]
_add("w8_join_avg_tier2", AVERAGED, TIER2_SQL, ctes=WITH_DIM, join=TIER2, **BY_REGION)


def _predicate(name: str, where: list[dict], sql: str, **query) -> None:
    """A filtered query; the request's ``where`` is data and the SQL's a condition."""
    keys = query.get("groupBy") or []
    _queries[name] = lambda spark, sf_dir: answer(spark, sf_dir, SUM_COUNT, where=where, **query).rows
    _oracles[name] = f"WITH {FACTS_SQL} SELECT {', '.join([*keys, _aggregates(SUM_COUNT)])} FROM fact WHERE {sql}{' GROUP BY ' + ', '.join(keys) if keys else ''}"


def _p(col: str, op: str, value) -> dict:
    return {"col": col, "op": op, "value": value}


# Predicates.
_predicate("w1_span_params", [_p("id", "gte", 1000), _p("id", "lt", 30000)], "id >= 1000 AND id < 30000", **BY_REGION)
_predicate("filter_eq", [_p("region", "eq", "FRANCE")], "region = 'FRANCE'")
_predicate("filter_neq", [_p("returned", "neq", "")], "returned <> ''", **BY_REGION)
_predicate("filter_gt", [_p("amount", "gt", "25000.50")], "amount > 25000.50", **BY_REGION)
_predicate("filter_gte", [_p("qty", "gte", 30)], "qty >= 30", **BY_REGION)
_predicate("filter_lt", [_p("qty", "lt", "10")], "qty < 10", **BY_REGION)
_predicate("filter_lte", [_p("discount", "lte", 0.05)], "discount <= 0.05", **BY_REGION)
_predicate("filter_between", [_p("shipped", "between", ["1995-01-01", "1996-06-30T12:00:00Z"])], "shipped BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30 12:00:00'", **BY_REGION)
_predicate("filter_is_null", [_p("returned", "is", None)], "returned IS NULL", **BY_REGION)
_predicate("filter_is_true", [_p("filled", "is", True)], "filled IS TRUE", **BY_REGION)
_predicate("filter_is_false", [_p("filled", "is", False)], "filled IS FALSE", **BY_REGION)
_predicate("filter_conjunction", [_p("qty", "gt", 10), _p("region", "neq", "CHINA"), _p("shipped", "lt", "1997-01-01"), _p("amount", "between", [1000, 40000])], "qty > 10 AND region <> 'CHINA' AND shipped < TIMESTAMP '1997-01-01' AND amount BETWEEN 1000 AND 40000", **BY_REGION)

# Group keys and aggregates.
_add("group_multi_key", SUM_COUNT, groupBy=["region", "flag", "line"])
_add("group_null_empty_nullstring", [("count", None, "n")], groupBy=["returned"])
_add("group_int_key", SUM_COUNT, groupBy=["line"])
_add("group_numeric_key", SUM_COUNT, groupBy=["discount"])
_oracles["group_numeric_key"] = _oracles["group_numeric_key"].replace("SELECT discount,", "SELECT CAST(discount AS DECIMAL(38,2)) AS discount,")
_queries["group_ts_key"] = lambda spark, sf_dir: answer(spark, sf_dir, SUM_COUNT, groupBy=["shipped"]).rows.withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
_oracles["group_ts_key"] = f"WITH {FACTS_SQL} SELECT strftime(shipped, '%Y-%m-%dT%H:%M:%S.%fZ') AS shipped, {_aggregates(SUM_COUNT)} FROM fact GROUP BY fact.shipped"
_predicate("scalar_empty_input", [_p("id", "lt", 0)], "id < 0")
_add("grouped_min_max_avg", [("min", "amount", "lo"), ("max", "amount", "hi"), ("avg", "amount", "mean"), ("min", "qty", "fewest"), ("avg", "qty", "each")], **BY_REGION)
_add("count_text_column", [("count", "returned", "n"), ("count", None, "rows")], **BY_REGION)

# Ranks and limits.
_EXACT = "CAST(sum({c}) * 100 AS HUGEINT)"
_AVG_ORDER = f" ORDER BY {_EXACT} // count({{c}}) {{d}} NULLS LAST, ({_EXACT} % count({{c}})) * 1000000000000 // count({{c}}) {{d}} NULLS LAST, {{k}}"


def _by_average(column: str, direction: str, k: int, key: str = "region") -> str:
    return _AVG_ORDER.format(c=column, d=direction, k=key) + f" LIMIT {k}"


_add("rank_avg_desc_top5", AVERAGED, TIER2_SQL, tail=_by_average("fact.sparse", "DESC", 5, "fact.region"), ctes=WITH_DIM, join=TIER2, rank_by={"agg": "mean"}, limit=5, **BY_REGION)
_add("rank_avg_asc", AVERAGED, tail=_by_average("sparse", "ASC", 7), rank_by={"agg": "mean", "direction": "asc"}, fetch_rows=7, **BY_REGION)
_add("rank_sum_desc", SUM_COUNT, tail=" ORDER BY sum(amount) DESC, region LIMIT 6", rank_by={"agg": "x", "direction": "desc"}, limit=6, **BY_REGION)
_add("rank_count_ties", [("count", "flag", "n")], tail=" ORDER BY n DESC, qty, line LIMIT 40", rank_by={"agg": "n"}, limit=40, groupBy=["qty", "line"])
_add("limit_slice", SUM_COUNT, tail=" ORDER BY region LIMIT 8", limit=8, **BY_REGION)
_add("limit_zero", SUM_COUNT, tail=" LIMIT 0", limit=0, **BY_REGION)
_add("fetch_rows_slice", SUM_COUNT, tail=" ORDER BY region LIMIT 3", fetch_rows=3, **BY_REGION)


def _rank_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions: groups without a value come last either way."""
    frame = facts(spark, sf_dir).withColumn("sparse", F.when(F.col("line") % 3 != 0, F.col("sparse")))
    table = {"wh_probe_agg": Table("wh_probe_agg", {}, TYPES, frame, ONE)}
    parts = []
    for direction in ("asc", "desc"):
        rows = execute(request([("sum", "sparse", "x")], groupBy=["line"], rank_by={"agg": "x", "direction": direction}, limit=6), table, lazy=True).rows
        parts.append(rows.select(F.lit(direction).alias("direction"), "line", "x"))
    return parts[0].unionByName(parts[1])


_queries["rank_nulls_last_both"] = _rank_nulls
_oracles["rank_nulls_last_both"] = f"""WITH {FACTS_SQL}, g AS (
  SELECT line, CAST(sum(CASE WHEN line % 3 <> 0 THEN sparse END) AS DECIMAL(38,2)) AS x FROM fact GROUP BY line)
(SELECT 'asc' AS direction, line, x FROM g ORDER BY x ASC NULLS LAST, line LIMIT 6)
UNION ALL (SELECT 'desc', line, x FROM g ORDER BY x DESC NULLS LAST, line LIMIT 6)"""


def _top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows(facts(spark, sf_dir).select("id", "region", "sparse"), "sparse", "id", 25)


_queries["w4_topk_rows"] = _top_rows
_oracles["w4_topk_rows"] = f"WITH {FACTS_SQL} SELECT id, region, sparse, (SELECT count(*) FROM fact) AS pre_trim FROM fact ORDER BY sparse DESC NULLS LAST, id LIMIT 25"

# Shards.
ORDER_TYPES = {"id": INT8, "amount": MONEY, "day": TIME, "priority": TEXT}
SPANS = [("S1", None, "1994-01-01"), ("S2", "1994-01-01", "1996-01-01"), ("S3", "1996-01-01", None)]
ORDERS_SQL = "o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS TIMESTAMP) AS day, o_orderpriority AS priority FROM orders)"
HASH_SLOTS = 4


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, amount, day and priority."""
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"{_money('o_totalprice')} as amount", "cast(o_orderdate as timestamp) as day", "o_orderpriority as priority")


def _by_time(spark: SparkSession, sf_dir: str, versions: tuple[int, ...] = (1, 1, 1)) -> Table:
    """Orders in three shards of ``day``; the shard follows from the row, so one scan serves all."""
    cut = F.lit("S1")
    for name, low, _ in SPANS[1:]:
        cut = F.when(F.col("day") >= F.lit(low).cast("timestamp"), F.lit(name)).otherwise(cut)
    rows = [DirectoryRow(name, low, high, schema_version=v) for (name, low, high), v in zip(SPANS, versions)]
    return Table("orders", {}, ORDER_TYPES, orders(spark, sf_dir).withColumn(SHARD, cut), rows, ShardKey("time", "day", TIME))


def _by_slot(spark: SparkSession, sf_dir: str) -> Table:
    rows = [DirectoryRow(f"H{i}", hash_slot=i) for i in range(HASH_SLOTS)]
    frame = orders(spark, sf_dir).withColumn(SHARD, F.concat(F.lit("H"), F.pmod("id", F.lit(HASH_SLOTS)).cast("string")))
    return Table("orders", {}, ORDER_TYPES, frame, rows, ShardKey("hash", "id", INT8, lambda v: INT8.parse(v) % HASH_SLOTS))


def _by_range(spark: SparkSession, sf_dir: str) -> Table:
    cuts = [("R1", None, "5000"), ("R2", "5000", "30000"), ("R3", "30000", None)]
    cut = F.when(F.col("id") < 5000, F.lit("R1")).when(F.col("id") < 30000, F.lit("R2")).otherwise(F.lit("R3"))
    return Table("orders", {}, ORDER_TYPES, orders(spark, sf_dir).withColumn(SHARD, cut), [DirectoryRow(*c) for c in cuts], ShardKey("range", "id", INT8))


def _sharded(name: str, table: Callable[[SparkSession, str], Table], where: list[dict], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, execute(request(SUM_COUNT, table="orders", where=where, groupBy=["priority"]), {"orders": table(spark, sf_dir)}))

    _queries[name] = run
    _oracles[name] = f"WITH {ORDERS_SQL} SELECT priority, {_aggregates(SUM_COUNT)} FROM o WHERE {sql} GROUP BY priority"


_sharded("prune_range_shards", _by_range, [_p("id", "between", [100, 6000])], "id BETWEEN 100 AND 6000")
_sharded("prune_time_shards", _by_time, [_p("day", "gte", "1996-03-01"), _p("day", "lt", "1997-01-01")], "day >= TIMESTAMP '1996-03-01' AND day < TIMESTAMP '1997-01-01'")
_sharded("prune_hash_shards", _by_slot, [_p("id", "eq", 65)], "id = 65")
_sharded("two_level_merge", _by_time, [], "true")
_sharded("coverage_excluded_shard", lambda s, d: _by_time(s, d, (1, 2, 1)), [], "day < TIMESTAMP '1994-01-01' OR day >= TIMESTAMP '1996-01-01'")


def _delisted(spark: SparkSession, sf_dir: str) -> Table:
    """The frame still holds the rows of a shard that the directory no longer lists."""
    table = _by_time(spark, sf_dir)
    return Table("orders", {}, ORDER_TYPES, table.frame, table.directory[:2], table.key)


_sharded("delisted_shard", _delisted, [], "day < TIMESTAMP '1996-01-01'")


def _partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial rows that each shard gives."""
    answer = execute(request(SUM_COUNT, table="orders", groupBy=["priority"]), {"orders": _by_time(spark, sf_dir)})
    answer.close()
    return spark.createDataFrame([(e["shard"], e["partial_rows"]) for e in answer.per_shard], "shard string, partial_rows bigint")


_queries["per_shard_partials"] = _partial_rows
_oracles["per_shard_partials"] = f"""WITH {ORDERS_SQL}, s AS (SELECT CASE WHEN day < TIMESTAMP '1994-01-01' THEN 'S1' WHEN day < TIMESTAMP '1996-01-01' THEN 'S2' ELSE 'S3' END AS shard, priority FROM o)
SELECT shard, count(DISTINCT s.priority) AS partial_rows FROM (VALUES ('S1'), ('S2'), ('S3')) v(shard) LEFT JOIN s USING (shard) GROUP BY shard"""


# Averages of more rows than any table here has: two shards give partials of them.
_HUGE = ["('a', 30000000000000000000000000001, 60000000000000000)", "('b', 10000000000000000000000000000, 20000000000000001)", "('c', 10000000000000000000000000000, 20000000000000000)",
         "('d', -7, 9000000000000000000)", "('e', -8, 9000000000000000000)", "('f', NULL, 0)", "('g', 499999999999, 999999999999)", "('h', 1, 2)"]


def _rank_huge(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.sql(f"SELECT g, cast(s AS decimal(38,0)) AS m_sum, cast(c AS bigint) AS m_count FROM VALUES {', '.join(_HUGE)} AS x(g, s, c)")
    table = Table("t", {"A": Partials(given.where("g < 'd'")), "B": Partials(given.where("g >= 'd'"))}, {"g": TEXT, "x": INT8}, None, (DirectoryRow("A"), DirectoryRow("B")))
    answer = execute(request([("avg", "x", "m")], "t", groupBy=["g"], rank_by={"agg": "m"}), {"t": table})
    try:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(collect_groups(answer))], "place bigint, g string, m_num decimal(38,0), m_den bigint")
    finally:
        answer.close()


_queries["rank_avg_huge"] = _rank_huge
_oracles["rank_avg_huge"] = f"""WITH x(g, s, c) AS (SELECT g, s::HUGEINT, c::HUGEINT FROM (VALUES {', '.join(_HUGE)}) v(g, s, c)),
d AS (SELECT *, nullif(c, 0) AS den, ((s % c) + c) % c AS r0 FROM x),
e AS (SELECT *, (s - r0) // den AS q, r0 * 1000000000000000000 // den AS d1, r0 * 1000000000000000000 % den AS r1 FROM d),
f AS (SELECT *, r1 * 1000000000000000000 // den AS d2, r1 * 1000000000000000000 % den AS r2 FROM e)
SELECT row_number() OVER (ORDER BY q DESC NULLS LAST, d1 DESC NULLS LAST, d2 DESC NULLS LAST, r2 * 1000000000000000000 // den DESC NULLS LAST, g) - 1 AS place, g, CAST(s AS DECIMAL(38,0)) AS m_num, CAST(den AS BIGINT) AS m_den FROM f"""

# Cold tier.
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("event_id as id", "cast(ts as timestamp) as ts", "cast(user_id as int) as device_id", "event_type as metric", "value")


def _cold_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count by metric over unpacked blocks; floats are summed as decimals, so order does not matter."""
    rows = cold.cold_scan(cold.pack(events(spark, sf_dir)), cold.DATASET)
    return rows.groupBy("metric").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(38,4)").alias("x"), F.count("value").alias("c"))


_queries["w5_cold_agg"] = _cold_agg
_oracles["w5_cold_agg"] = "SELECT event_type AS metric, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS x, count(value) AS c FROM events GROUP BY event_type"
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = cold.pack(events(spark, sf_dir))
    return packed.select(F.col("day").cast("string").alias("day"), "chunk", "n_rows", F.date_format("ts_min", _STAMP).alias("ts_min"), F.date_format("ts_max", _STAMP).alias("ts_max"), "dev_min", "dev_max")


_queries["pack_blocks_stats"] = _pack_stats
_oracles["pack_blocks_stats"] = f"""WITH e AS (
  SELECT CAST(ts AS DATE) AS d, (row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1) // {cold.BLOCK_ROWS} + 1 AS chunk, ts, CAST(user_id AS INTEGER) AS dev FROM events)
SELECT CAST(d AS VARCHAR) AS day, chunk, CAST(count(*) AS INTEGER) AS n_rows, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS ts_min, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS ts_max, min(dev) AS dev_min, max(dev) AS dev_max
FROM e GROUP BY d, chunk"""
_queries["unpack_roundtrip"] = lambda spark, sf_dir: cold.unpack(cold.pack(events(spark, sf_dir))).select("id", F.date_format("ts", _STAMP).alias("ts"), "device_id", "metric", "value")
_oracles["unpack_roundtrip"] = "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CAST(user_id AS INTEGER) AS device_id, event_type AS metric, value FROM events"
_queries["blocks_checksum"] = lambda spark, sf_dir: cold.blocks_checksum(cold.pack(events(spark, sf_dir))).select(F.col("day").cast("string").alias("day"), "checksum")
_oracles["blocks_checksum"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS checksum FROM events GROUP BY CAST(ts AS DATE)"


def _cold_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cold template between two days."""
    source = events(spark, sf_dir)
    first = source.agg(F.min(F.to_date("ts")).alias("d")).first()["d"].toordinal()
    days = {k: str(datetime.fromordinal(first + n).date()) for k, n in (("day_from", 3), ("day_to", 9))}
    return templates.call("W5", {"blocks": cold.pack(source)}, {"dataset": cold.DATASET, **days}).rows


_queries["w5_cold_days"] = _cold_days
_oracles["w5_cold_days"] = """WITH f AS (SELECT min(CAST(ts AS DATE)) AS d FROM events)
SELECT CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS x, count(value) AS c FROM events, f WHERE CAST(ts AS DATE) >= d + 3 AND CAST(ts AS DATE) < d + 9"""


def _pack_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of events some of which have no id or no time; none may vanish."""
    holes = events(spark, sf_dir).withColumn("ts", F.when(F.col("id") % 11 != 0, F.col("ts"))).withColumn("id", F.when(F.col("id") % 7 != 0, F.col("id")))
    packed = cold.pack(holes).groupBy("day").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("blocks"), F.sum(F.size(F.filter("id", lambda i: i.isNull()))).alias("without_id"))
    return packed.select(F.col("day").cast("string").alias("day"), "n_rows", "blocks", "without_id")


_queries["pack_nulls"] = _pack_nulls
_oracles["pack_nulls"] = f"""SELECT CAST(d AS VARCHAR) AS day, count(*) AS n_rows, CAST((count(*) + {cold.BLOCK_ROWS - 1}) // {cold.BLOCK_ROWS} AS BIGINT) AS blocks, CAST(count(*) FILTER (event_id % 7 = 0) AS BIGINT) AS without_id
FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END AS d FROM events) GROUP BY d"""


def _late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after the first day was packed without the events that came later."""
    source = events(spark, sf_dir)
    day = str(source.agg(F.min(F.to_date("ts")).alias("d")).first()["d"])
    packed = cold.pack(source.where((F.to_date("ts") == F.lit(day).cast("date")) & (F.col("id") % 5 != 0)))
    left = cold.remaining(source, packed, day)
    return left.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


_queries["rolloff_late_rows"] = _late_rows
_oracles["rolloff_late_rows"] = """WITH f AS (SELECT min(CAST(ts AS DATE)) AS d FROM events)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, min(event_id) AS first_id FROM events, f WHERE CAST(ts AS DATE) <> d OR event_id % 5 = 0 GROUP BY 1"""

# Templates, called by name with their parameters.


def _template(name: str, sql: str, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = facts(spark, sf_dir).select("id", "region", F.col("sparse").alias("amount"))
        return templates.call(name, {"fact": fact, "dim": dimension(spark, sf_dir)}, params).rows

    _queries[f"template_{name.lower()}"] = run
    _oracles[f"template_{name.lower()}"] = f"WITH {WITH_DIM} SELECT {sql}"


_SUM = "CAST(sum(fact.sparse) AS DECIMAL(38,2))"
_ID_SPAN = "FROM fact WHERE id >= 2000 AND id < 40000"
_template("W1", f"fact.region, {_SUM} AS x, count(*) AS c {_ID_SPAN} GROUP BY fact.region ORDER BY fact.region LIMIT 9", id_min=2000, id_max=40000, limit=9)
_template("W2", f"min(sparse) AS lo, max(sparse) AS hi, count(sparse) AS c {_ID_SPAN}", id_min=2000, id_max=40000)
_template("W3", f"{_SUM} AS s, count(sparse) AS c FROM fact WHERE id < 40000", id_max=40000)
_template("W4", "id, region, sparse AS amount FROM fact ORDER BY sparse DESC NULLS LAST, id LIMIT 12", limit=12)
_template("W6", f"fact.region, {_SUM} AS x, count(fact.sparse) AS c, count(*) AS n FROM {JOIN_SQL} GROUP BY fact.region ORDER BY 1 LIMIT 20", limit=20)
_template("W7", f"fact.region, {_SUM} AS x, count(fact.sparse) AS c, count(*) AS n FROM {TIER2_SQL} GROUP BY fact.region")
_template("W8", f"fact.region, {_SUM} AS s, count(fact.sparse) AS c, count(*) AS n FROM {TIER2_SQL} GROUP BY fact.region")

# Catalogue, over the same small tables in both engines.
NOW = datetime(2026, 3, 1, 12, 0, 0, tzinfo=timezone.utc)
_T = "VALUES (1, 'orders', 'time', false, 3), (2, 'dims', 'none', true, 1), (3, 'hits', 'range', false, 2)"
_P = """VALUES (11, 1, 101, '1992', '1994', 'serving', 3, 1000, 361000000, '2026-03-01 11:59:30'), (12, 1, 102, '1994', '1996', 'draining', 3, 900, 370000000, '2026-03-01 11:59:50'),
  (13, 1, 103, '1996', NULL, 'serving', 2, 800, 380000000, '2026-03-01 11:59:50'), (14, 1, 104, '1995', '1997', 'copying', 3, 700, 10, '2026-03-01 11:59:50'),
  (15, 2, 101, NULL, NULL, 'serving', 1, 25, 5000, '2026-03-01 11:59:40'), (16, 2, 102, NULL, NULL, 'serving', 1, 25, 360000000, '2026-03-01 11:58:00'),
  (17, 3, 105, '0', '50', 'serving', 2, 10, 400000000, '2026-03-01 11:59:45'), (18, 3, 106, '40', '90', 'serving', 2, 20, 360000000, '2026-03-01 11:59:59'),
  (19, 3, 104, '90', NULL, 'serving', 2, 30, 420000000, '2026-03-01 11:59:59'), (20, 3, 107, '50', '90', 'failed', 2, 30, 420000000, '2026-03-01 11:59:59')"""
_PR = "VALUES (101, 'a', 'ACTIVE_HEALTHY'), (102, 'b', 'ACTIVE_HEALTHY'), (103, 'c', 'ACTIVE_HEALTHY'), (104, 'd', 'ACTIVE_HEALTHY'), (105, 'e', 'PAUSED'), (106, 'f', 'ACTIVE_HEALTHY'), (107, 'g', 'ACTIVE_HEALTHY')"
_T_COLS, _PR_COLS = "id, logical_name, shard_key_type, is_reference, schema_version", "id, ref, status"
_P_COLS = "id, table_id, project_id, key_min, key_max, state, schema_version, row_estimate, bytes_used, last_health_at"
CATALOG_SQL = f"t({_T_COLS}) AS ({_T}), p({_P_COLS}) AS ({_P}), pr({_PR_COLS}) AS ({_PR})"
_LIVE_SQL = "pr.status = 'ACTIVE_HEALTHY' AND p.schema_version = t.schema_version AND CAST(p.last_health_at AS TIMESTAMP) > TIMESTAMP '2026-03-01 11:58:30'"
_JOINED_SQL = "FROM t JOIN p ON p.table_id = t.id JOIN pr ON pr.id = p.project_id"


def _catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = lambda values, columns: spark.sql(f"SELECT * FROM {values} AS x({columns})")
    placements = rows(_P, _P_COLS).withColumn("last_health_at", F.col("last_health_at").cast("timestamp")).withColumn("hash_slot", F.lit(None).cast("int"))
    return rows(_T, _T_COLS), placements, rows(_PR, _PR_COLS)


def _now():
    return F.lit(NOW.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


_queries["directory_view"] = lambda spark, sf_dir: catalog.directory(*_catalog(spark), now=_now()).select("logical_name", "shard", "key_min", "key_max", "state", "row_estimate", "is_reference")
_oracles["directory_view"] = f"WITH {CATALOG_SQL} SELECT t.logical_name, pr.ref AS shard, p.key_min, p.key_max, p.state, p.row_estimate, t.is_reference {_JOINED_SQL} WHERE p.state IN ('serving', 'draining') AND {_LIVE_SQL}"
_queries["rolloff_candidates"] = lambda spark, sf_dir: catalog.roll_off_candidates(*_catalog(spark), now=_now())
_oracles["rolloff_candidates"] = f"""WITH {CATALOG_SQL} SELECT t.logical_name, p.id AS placement_id, p.project_id, pr.ref AS shard, p.bytes_used {_JOINED_SQL}
WHERE p.state = 'serving' AND {_LIVE_SQL} AND p.bytes_used >= 360000000
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.project_id = p.project_id AND q.state IN ('copying', 'draining', 'loading'))"""
_queries["span_overlap"] = lambda spark, sf_dir: catalog.span_overlaps(_catalog(spark)[1])
_oracles["span_overlap"] = f"""WITH {CATALOG_SQL}, live AS (SELECT * FROM p WHERE state IN ('serving', 'draining'))
SELECT a.table_id, a.id AS first, b.id AS second FROM live a JOIN live b ON a.table_id = b.table_id AND a.id < b.id
  AND (a.key_min IS NULL OR b.key_max IS NULL OR a.key_min < b.key_max) AND (b.key_min IS NULL OR a.key_max IS NULL OR b.key_min < a.key_max)"""
_BROKEN = """(21, 1, 108, '1992', '1994', 'draining', 3, 5, 5, '2026-03-01 11:59:59'), (22, 2, 101, NULL, NULL, 'draining', 1, 5, 5, '2026-03-01 11:59:59'),
  (23, 3, 108, NULL, '0', 'serving', 2, 5, 5, '2026-03-01 11:59:59'), (24, 3, 109, NULL, '0', 'serving', 2, 5, 5, '2026-03-01 11:59:59'), (25, 3, 109, NULL, '0', 'retired', 2, 5, 5, '2026-03-01 11:59:59')"""


def _invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span served twice, one without a lower bound too, and a project with two copies of a reference."""
    tables, placements, _ = _catalog(spark)
    more = spark.sql(f"SELECT * FROM VALUES {_BROKEN} AS x({_P_COLS})").withColumn("last_health_at", F.col("last_health_at").cast("timestamp")).withColumn("hash_slot", F.lit(None).cast("int"))
    return catalog.broken_invariants(tables, placements.unionByName(more))


_queries["catalog_invariants"] = _invariants
_oracles["catalog_invariants"] = f"""WITH t({_T_COLS}) AS ({_T}), p({_P_COLS}) AS ({_P}, {_BROKEN}), live AS (SELECT p.*, t.is_reference FROM p JOIN t ON p.table_id = t.id WHERE state IN ('serving', 'draining'))
SELECT table_id, 'span' AS kind, count(*) AS n FROM live WHERE NOT is_reference GROUP BY table_id, key_min, key_max HAVING count(*) > 1
UNION ALL SELECT table_id, 'reference', count(*) FROM live WHERE is_reference GROUP BY table_id, project_id HAVING count(*) > 1"""
_DAYS = "VALUES (1, '2026-01-01', '2026-01-02'), (2, '2026-01-02', '2026-01-04'), (3, '2026-01-03', '2026-01-05'), (4, '2026-01-05', '2026-01-06'), (5, '2025-12-31', '2026-01-06')"


def _day_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql(f"SELECT id, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi FROM {_DAYS} AS x(id, lo, hi)")
    return overlapping(days, days, "lo", "hi", F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("first"), F.col("b.id").alias("second"))


_queries["daterange_overlap"] = _day_overlaps
_oracles["daterange_overlap"] = f"WITH x(id, lo, hi) AS ({_DAYS}) SELECT a.id AS first, b.id AS second FROM x a JOIN x b ON a.id < b.id AND a.lo < b.hi AND b.lo < a.hi"
_LEDGER = "VALUES (1, 'p1', 'pending', NULL), (1, 'p2', 'loading', '2026-03-01 11:59:59'), (1, 'p3', 'loading', '2026-03-01 12:05:00'), (1, 'p4', 'loaded', NULL), (1, 'p5', 'verified', NULL), (2, 'p1', 'pending', NULL)"


def _resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions that a loader may take up, as the ledger gives them."""
    rows = spark.sql(f"SELECT CAST(job AS string) AS job, partition_id, state, CAST(lease_until AS TIMESTAMP) AS lease_until FROM {_LEDGER} AS x(job, partition_id, state, lease_until)").collect()
    at = lambda t: t and t.replace(tzinfo=timezone.utc)
    book = Ledger({"t": LoadTable("t", 1)}, {}, partitions={(r.job, "p", r.partition_id): Partition("p", r.partition_id, r.state, at(r.lease_until)) for r in rows})
    free = [(int(job), p.partition_id, p.state) for job in sorted({r.job for r in rows}) for p in book.resumable(job, NOW)]
    return spark.createDataFrame(free, "job int, partition_id string, state string")


_queries["loader_resume_set"] = _resumable
_oracles["loader_resume_set"] = f"WITH x(job, partition_id, state, lease_until) AS ({_LEDGER}) SELECT job, partition_id, state FROM x WHERE state = 'pending' OR state = 'loading' AND CAST(lease_until AS TIMESTAMP) < TIMESTAMP '2026-03-01 12:00:00'"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to ``f(spark, sf_dir) -> DataFrame``."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL over the same tables."""
    return dict(_oracles)
