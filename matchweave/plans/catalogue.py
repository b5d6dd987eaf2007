"""Registered queries, each with the SQL that must give the same rows.

The SQL is one statement over the raw tables, built from the shared CTEs below.
Model and storage queries have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions.exprs import hash_bucket, hash_order
from matchweave.operators import (
    cases,
    controls,
    evaluate,
    features,
    matching,
    models,
    quality,
    trees,
    wide,
)
from matchweave.plans.retail import (
    CONTROLS_PER_CASE,
    FIRST_YEAR,
    GAP_DAYS,
    LAST_YEAR,
    SEED,
    STRATA,
    RetailStudy,
)
from matchweave.sources import store

STEPS: dict[str, Callable[[RetailStudy], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[RetailStudy], DataFrame]):
        STEPS[fn.__name__] = fn
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(RetailStudy(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- shared CTEs -----------------------------------------------------------------------

_CTE = {
    "codes": ((), "SELECT p_partkey AS code FROM part WHERE p_name LIKE '%gizmo' AND (p_size > 5) IS NOT TRUE"),
    "codes_b": ((), "SELECT p_partkey AS code FROM part WHERE p_name LIKE '%gizmo' AND (p_size > 12) IS NOT TRUE"),
    "persons": (
        (),
        """SELECT c_custkey AS person, c_mktsegment AS segment, c_nationkey % 5 AS area,
           DATE '1940-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS born FROM customer""",
    ),
    "ev": (
        (),
        """SELECT o_custkey AS person, CAST(o_orderdate AS DATE) AS event_date, o_orderkey, l_linenumber,
           l_partkey AS code, l_suppkey, l_quantity AS value
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "bev": (
        ("ev",),
        "SELECT person, event_date, p_brand AS brand, value FROM ev JOIN part ON code = p_partkey",
    ),
    "idx": (
        ("ev", "codes"),
        """SELECT person, event_date AS index_date, code FROM (
             SELECT ev.*, row_number() OVER (PARTITION BY person ORDER BY event_date, o_orderkey,
                    l_linenumber, code, l_suppkey, value) AS rn
             FROM ev WHERE code IN (SELECT code FROM codes)) WHERE rn = 1""",
    ),
    "aged": (
        ("idx", "persons"),
        """SELECT idx.person, index_date, code, segment, area, born,
           CAST(((year(index_date) - year(born)) * 365 + (month(index_date) - month(born)) * 30
                 + (day(index_date) - day(born))) // 365 AS INTEGER) AS age
           FROM idx JOIN persons USING (person)""",
    ),
    "elig": (
        ("aged",),
        f"""SELECT * FROM aged WHERE (year(index_date) < {FIRST_YEAR} OR year(index_date) > {LAST_YEAR}) IS NOT TRUE
            AND (year(born) < 1941 OR year(born) > 1990) IS NOT TRUE AND (age < 18) IS NOT TRUE""",
    ),
    "hosp": (
        ("codes_b",),
        """SELECT * FROM (
             SELECT o_custkey AS person, spell, episode, code, diag_num, episode_start, o_orderstatus AS status,
                    row_number() OVER (PARTITION BY o_custkey ORDER BY episode_start, episode, diag_num, code, spell) AS rn
             FROM (SELECT l_orderkey AS spell, l_linenumber AS episode, l_partkey AS code, l_suppkey AS diag_num
                   FROM lineitem) d
             JOIN codes_b USING (code)
             JOIN (SELECT l_orderkey AS spell, l_linenumber AS episode,
                          CAST(min(l_shipdate) AS DATE) AS episode_start
                   FROM lineitem GROUP BY 1, 2) e USING (spell, episode)
             JOIN orders ON spell = o_orderkey) WHERE rn = 1""",
    ),
    "spans": (
        (),
        """SELECT o_custkey AS person, o_orderkey, CAST(o_orderdate AS DATE) AS start_date, o_orderpriority AS priority,
           COALESCE(CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) - 1,
                    DATE '9999-01-01') AS end_date FROM orders""",
    ),
    "cases": (
        ("idx", "persons"),
        f"""SELECT person, index_date, code, segment, area FROM idx JOIN persons USING (person)
            WHERE year(index_date) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}""",
    ),
    "pool": (
        ("idx", "persons"),
        "SELECT person, segment, area FROM persons WHERE person NOT IN (SELECT person FROM idx)",
    ),
    "pairs": (
        ("cases", "pool"),
        f"""SELECT c.person AS case_person, p.person AS control_person, index_date, c.segment, c.area
            FROM (SELECT *, row_number() OVER (PARTITION BY segment, area
                         ORDER BY md5('{SEED}|' || person), person) AS slot FROM cases) c
            JOIN (SELECT *, (row_number() OVER (PARTITION BY segment, area
                         ORDER BY md5('{SEED}|' || person), person) - 1) // {CONTROLS_PER_CASE} + 1 AS slot FROM pool) p
            ON c.segment = p.segment AND c.area = p.area AND c.slot = p.slot""",
    ),
    "sets": (
        ("pairs",),
        f"""SELECT * FROM pairs WHERE case_person IN
            (SELECT case_person FROM pairs GROUP BY 1 HAVING count(*) = {CONTROLS_PER_CASE})""",
    ),
    "grouped": (
        ("sets",),
        "SELECT *, dense_rank() OVER (ORDER BY case_person) AS group_id FROM sets",
    ),
    "members": (
        ("grouped",),
        """SELECT DISTINCT case_person AS person, index_date, segment, area, group_id, 1 AS label FROM grouped
           UNION ALL
           SELECT control_person, index_date, segment, area, group_id, 0 FROM grouped""",
    ),
    "old": (
        ("members", "bev"),
        f"""SELECT m.*, brand, event_date, value FROM members m JOIN bev USING (person)
            WHERE (year(index_date) - year(event_date)) * 365 + (month(index_date) - month(event_date)) * 30
                  + (day(index_date) - day(event_date)) >= {GAP_DAYS}""",
    ),
    "found": (
        ("old",),
        """SELECT person, segment, area, group_id, label, brand, avg(value) AS mean_value,
           count(*) FILTER (WHERE event_date > first_day) + 1 AS n_events
           FROM (SELECT *, min(event_date) OVER (PARTITION BY person, brand) AS first_day FROM old)
           GROUP BY person, segment, area, group_id, label, brand""",
    ),
    "feats": (
        ("found", "members"),
        """SELECT * FROM found UNION ALL
           SELECT person, segment, area, group_id, label, 'Z', CAST(NULL AS DOUBLE), 0
           FROM members WHERE person NOT IN (SELECT person FROM found)""",
    ),
    "grid": (
        ("members", "feats"),
        """SELECT m.person, m.group_id, m.label, b.brand, f.n_events, f.mean_value
           FROM members m CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part) b
           LEFT JOIN feats f ON f.person = m.person AND f.brand = b.brand""",
    ),
    "miss": (
        ("grid",),
        """SELECT label, brand, count(*) AS n_rows, count(*) FILTER (WHERE mean_value IS NULL) AS n_missing,
           median(mean_value) AS med FROM grid GROUP BY 1, 2""",
    ),
    "scored": (
        (),
        """SELECT quality AS truth, toxic AS prediction, CAST(n_chars AS DOUBLE) AS score
           FROM labels JOIN documents USING (doc_id)""",
    ),
    "by_score": (
        ("scored",),
        """SELECT score AS threshold, count(*) FILTER (WHERE truth = 1) AS pos,
           count(*) FILTER (WHERE truth <> 1) AS neg FROM scored WHERE truth IS NOT NULL GROUP BY 1""",
    ),
    "curve": (
        ("by_score",),
        """SELECT threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
           CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n
           FROM by_score WINDOW w AS (ORDER BY threshold DESC)""",
    ),
}


def _with(*names: str) -> str:
    """WITH clause of the named CTEs and everything they are built from."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for parent in _CTE[name][0]:
                add(parent)
            ordered.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in ordered) + "\n"


# --- raw-table checks and repairs ------------------------------------------------------


@query(
    """SELECT o_orderkey AS spell, o_custkey AS person, CAST(o_orderdate AS DATE) AS admitted,
       o_orderstatus AS status FROM orders"""
)
def cutdown_projection(s: RetailStudy) -> DataFrame:
    return quality.cutdown(
        s.table("orders"),
        {
            "spell": "o_orderkey",
            "person": "o_custkey",
            "admitted": F.col("o_orderdate").cast("date"),
            "status": "o_orderstatus",
        },
    )


@query(
    """WITH t AS (SELECT c_custkey, o_orderkey, o_orderdate, o_orderstatus
                  FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
       SELECT 'c_custkey' AS column_name, count(*) AS n_rows, count(c_custkey) AS n_present,
              count(*) - count(c_custkey) AS n_null FROM t
       UNION ALL SELECT 'o_orderkey', count(*), count(o_orderkey), count(*) - count(o_orderkey) FROM t
       UNION ALL SELECT 'o_orderdate', count(*), count(o_orderdate), count(*) - count(o_orderdate) FROM t
       UNION ALL SELECT 'o_orderstatus', count(*), count(o_orderstatus), count(*) - count(o_orderstatus) FROM t"""
)
def null_profile(s: RetailStudy) -> DataFrame:
    # The outer join as matches plus customers without orders: unlike an outer join, the
    # matches of one very large customer can be split over tasks.
    orders = s.table("orders").withColumn("c_custkey", F.col("o_custkey"))
    persons = s.table("customer").select("c_custkey")
    without = persons.join(orders.select("c_custkey").distinct(), "c_custkey", "left_anti")
    joined = persons.join(orders, "c_custkey").unionByName(without, allowMissingColumns=True)
    return quality.null_profile(joined, ["c_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"])


@query(
    """SELECT 'l_quantity' AS column_name, count(*) FILTER (WHERE l_quantity < 5) AS n_below,
              count(*) FILTER (WHERE l_quantity > 45) AS n_above FROM lineitem
       UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE l_discount < 0.01),
              count(*) FILTER (WHERE l_discount > 0.09) FROM lineitem
       UNION ALL SELECT 'l_tax', 0, count(*) FILTER (WHERE l_tax > 0.05) FROM lineitem"""
)
def range_violations(s: RetailStudy) -> DataFrame:
    return quality.range_violations(
        s.table("lineitem"),
        {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09), "l_tax": (None, 0.05)},
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 1) AS quantity
       FROM lineitem WHERE (nullif(l_quantity, 1) > 40 OR l_discount > 0.09) IS NOT TRUE"""
)
def drop_invalid_rows(s: RetailStudy) -> DataFrame:
    lines = s.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("quantity"),
        "l_discount",
    )
    return quality.drop_where(lines, (F.col("quantity") > 40) | (F.col("l_discount") > 0.09)).drop("l_discount")


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_nationkey > 20 OR c_nationkey < 1 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer"""
)
def null_out_invalid(s: RetailStudy) -> DataFrame:
    df = s.table("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    df = quality.null_where(df, "c_acctbal", F.col("c_acctbal") < 0)
    return quality.null_where(df, "c_nationkey", (F.col("c_nationkey") > 20) | (F.col("c_nationkey") < 1))


@query(
    """SELECT l_orderkey, count(l_linenumber) AS n_values, count(DISTINCT l_linenumber) AS n_distinct
       FROM lineitem GROUP BY 1 HAVING count(l_linenumber) <> count(DISTINCT l_linenumber)"""
)
def duplicate_keys(s: RetailStudy) -> DataFrame:
    return quality.duplicate_keys(s.table("lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS ordered,
       CAST(l_shipdate AS DATE) AS shipped
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate"""
)
def date_order_violations(s: RetailStudy) -> DataFrame:
    lines = s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    dated = lines.join(orders, "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("o_orderdate").cast("date").alias("ordered"),
        F.col("l_shipdate").cast("date").alias("shipped"),
    )
    return quality.date_order_violations(dated, "ordered", "shipped")


_SPAN_90 = "CAST(o_orderdate AS DATE) + 90"


@query(
    f"""SELECT * FROM (
          SELECT o_custkey AS person, o_orderkey, CAST(o_orderdate AS DATE) AS start_date, {_SPAN_90} AS end_date,
                 lag({_SPAN_90}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_end_date
          FROM orders) WHERE start_date <= previous_end_date"""
)
def interval_overlaps(s: RetailStudy) -> DataFrame:
    spans = s.table("orders").select(
        F.col("o_custkey").alias("person"),
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 90).alias("end_date"),
    )
    return quality.overlaps(spans, ["person"], "start_date", "end_date", ["o_orderkey"])


@query(
    """SELECT * FROM (
         SELECT l_orderkey AS spell, l_linenumber AS episode, l_partkey, l_suppkey,
                CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS end_date,
                lead(l_linenumber) OVER w AS next_episode, lead(CAST(l_shipdate AS DATE)) OVER w AS next_start_date
         FROM lineitem
         WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity))
       WHERE next_episode > episode AND next_start_date < end_date"""
)
def episode_sequence_overlap(s: RetailStudy) -> DataFrame:
    episodes = s.table("lineitem").select(
        F.col("l_orderkey").alias("spell"),
        F.col("l_linenumber").alias("episode"),
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("start_date"),
        F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("end_date"),
    )
    return quality.sequence_overlaps(
        episodes, ["spell"], "episode", "start_date", "end_date",
        ["l_partkey", "l_suppkey", "end_date"],
    )


@query(
    """SELECT user_id, count(DISTINCT event_type) AS n_distinct FROM events WHERE user_id IS NOT NULL
       GROUP BY 1 HAVING count(DISTINCT event_type) > 1"""
)
def inconsistent_within_key(s: RetailStudy) -> DataFrame:
    return quality.inconsistent_within(s.table("events"), ["user_id"], "event_type")


@query(
    """SELECT * FROM (
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_partkey, l_suppkey, l_quantity) AS seq
         FROM lineitem) WHERE seq > 1"""
)
def duplicate_sequence(s: RetailStudy) -> DataFrame:
    lines = s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return quality.duplicate_sequence(
        lines,
        ["l_orderkey", "l_linenumber"],
        ["l_partkey", "l_suppkey", "l_quantity"],
        [F.call_function("div", F.col("l_partkey"), F.lit(1000))],
    )


@query(
    """WITH t AS (SELECT o_custkey, o_orderdate, o_totalprice, c_acctbal
                  FROM orders JOIN customer ON o_custkey = c_custkey),
       a AS (SELECT * FROM t WHERE (year(o_orderdate) < 1996) IS NOT TRUE),
       b AS (SELECT * FROM a WHERE (nullif(c_acctbal, 0) < 0) IS NOT TRUE),
       c AS (SELECT * FROM b WHERE (o_totalprice > 400000) IS NOT TRUE)
       SELECT 0 AS step, 'start' AS step_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_persons FROM t
       UNION ALL SELECT 1, 'early orders', count(*), count(DISTINCT o_custkey) FROM a
       UNION ALL SELECT 2, 'in debt', count(*), count(DISTINCT o_custkey) FROM b
       UNION ALL SELECT 3, 'large orders', count(*), count(DISTINCT o_custkey) FROM c"""
)
def attrition_ledger(s: RetailStudy) -> DataFrame:
    linked = s.table("orders").join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return quality.attrition(
        linked.select("o_custkey", "o_orderdate", "o_totalprice", "c_acctbal"),
        "o_custkey",
        {
            "early orders": F.year("o_orderdate") < 1996,
            "in debt": F.nullif(F.col("c_acctbal"), F.lit(0.0)) < 0,
            "large orders": F.col("o_totalprice") > 400000,
        },
    )


@query("SELECT DISTINCT c_custkey AS person FROM customer WHERE c_acctbal < 0 AND c_custkey IS NOT NULL")
def optout_list(s: RetailStudy) -> DataFrame:
    flagged = s.table("customer").select(
        F.col("c_custkey").alias("person"), F.when(F.col("c_acctbal") < 0, "Y").alias("opt_out")
    )
    return quality.optout_list(flagged, "opt_out", "person")


# --- cases -----------------------------------------------------------------------------


@query(
    """SELECT p_partkey, p_name, p_size FROM part WHERE (p_name LIKE '%gizmo' OR p_name LIKE 'red%')
       AND p_name NOT IN ('red ring', 'red widget') AND (p_size > 20) IS NOT TRUE"""
)
def code_list(s: RetailStudy) -> DataFrame:
    dictionary = s.table("part").select("p_partkey", "p_name", "p_size")
    found = cases.code_list(
        dictionary, "p_name", "p_name", ["%gizmo", "red%"], exclude=["red ring", "red widget"],
        drop=F.col("p_size") > 20,
    )
    return found


@query(_with("aged") + "SELECT person, index_date, code, segment, area, born, age FROM aged")
def index_event(s: RetailStudy) -> DataFrame:
    return s.aged_index()


@query(_with("hosp") + "SELECT person, spell, episode, code, diag_num, episode_start, status FROM hosp")
def index_event_hier(s: RetailStudy) -> DataFrame:
    return s.hospital_index()


@query(_with("elig") + "SELECT person, index_date, code, segment, area, born, age FROM elig")
def eligible_window(s: RetailStudy) -> DataFrame:
    return s.eligible()


@query(
    _with("elig", "hosp", "persons")
    + """, b AS (SELECT hosp.person, episode_start AS index_date, code,
                CASE WHEN status = 'F' THEN NULL ELSE segment END AS segment,
                CASE WHEN status = 'P' THEN NULL ELSE year(episode_start) - year(born) END AS age
                FROM hosp JOIN persons USING (person))
       , least_of AS (SELECT person, min(index_date) AS index_date, min(age) AS age
                      FROM (SELECT person, index_date, age FROM elig UNION ALL SELECT person, index_date, age FROM b)
                      GROUP BY person)
       SELECT m.person, COALESCE(a.segment, b.segment) AS segment, m.index_date, CAST(m.age AS INTEGER) AS age,
              a.code AS primary_code, b.code AS hospital_code
       FROM least_of m LEFT JOIN elig a ON a.person = m.person LEFT JOIN b ON b.person = m.person"""
)
def reconcile_sources(s: RetailStudy) -> DataFrame:
    hospital = s.hospital_index().join(s.persons, "person").select(
        "person",
        F.col("episode_start").alias("index_date"),
        "code",
        F.when(F.col("status") != "F", F.col("segment")).alias("segment"),
        F.when(F.col("status") != "P", F.year("episode_start") - F.year("born")).alias("age"),
    )
    return cases.reconcile(
        s.eligible(),
        hospital,
        "person",
        prefer=["segment"],
        earliest=["index_date", "age"],
        keep={"code": "primary_code"},
        keep_secondary={"code": "hospital_code"},
    )


_ASOF_DAY = "index_date - 365"


@query(
    _with("cases", "spans")
    + f"""SELECT c.person, c.index_date, {_ASOF_DAY} AS at_date, priority
          FROM cases c LEFT JOIN spans h ON c.person = h.person
               AND {_ASOF_DAY} >= start_date AND {_ASOF_DAY} <= end_date
          WHERE priority IS NOT NULL"""
)
def asof_attribute(s: RetailStudy) -> DataFrame:
    dated = s.cases.select("person", "index_date", F.date_sub("index_date", 365).alias("at_date"))
    return cases.asof_attribute(dated, s.intervals(of=dated), "person", "at_date", "start", "end", "priority", "priority")


@query(
    _with("cases")
    + """SELECT person, index_date, died FROM cases JOIN (
           SELECT c_custkey AS person, CAST(max(o_orderdate) AS DATE) AS died
           FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 GROUP BY 1) USING (person)
         WHERE year(died) < 2001"""
)
def case_death_check(s: RetailStudy) -> DataFrame:
    dead = s.table("customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("person"))
    last = (
        s.table("orders")
        .groupBy(F.col("o_custkey").alias("person"))
        .agg(F.max("o_orderdate").cast("date").alias("died"))
        .join(dead, "person", "left_semi")
    )
    return cases.deaths_before(s.cases.select("person", "index_date"), last, "person", "died", 2001)


# --- codes -----------------------------------------------------------------------------

_CHOSEN = f""", counted AS (
         SELECT brand, count(*) AS n FROM cases c JOIN (bev JOIN persons USING (person)) e
           ON c.person = e.person AND c.segment = e.segment
         WHERE (year(index_date) - year(event_date)) * 365 + (month(index_date) - month(event_date)) * 30
               + (day(index_date) - month(event_date)) > {GAP_DAYS}
         GROUP BY 1 ORDER BY n DESC, brand LIMIT 15),
       chosen AS (SELECT * FROM counted WHERE brand NOT IN ('Brand#3', 'Brand#7')
                  ORDER BY n DESC, brand LIMIT 10)
    """
_FREQUENT = _with("cases", "bev", "persons") + _CHOSEN


def _frequent(s: RetailStudy) -> DataFrame:
    events = s.brand_events_of(s.cases).join(s.persons.select("person", "segment"), "person")
    return features.frequent_codes(
        s.cases, events, ["person", "segment"], "brand", "index_date", "event_date", GAP_DAYS,
        k=15, exclude=["Brand#3", "Brand#7"], keep=10,
    )


@query(_FREQUENT + "SELECT brand, n FROM chosen")
def frequent_codes(s: RetailStudy) -> DataFrame:
    return _frequent(s)


@query(
    _with("codes")
    + """SELECT DISTINCT p_brand AS brand FROM part WHERE p_size > 40 AND p_brand IN
         (SELECT p_brand FROM part JOIN codes ON p_partkey = code)"""
)
def leak_check(s: RetailStudy) -> DataFrame:
    part = s.table("part")
    selected = part.where(F.col("p_size") > 40).select(F.col("p_brand").alias("brand"))
    outcome = (
        part.join(s.codes().select(F.col("code").alias("p_partkey")), "p_partkey", "left_semi")
        .select(F.col("p_brand").alias("brand"))
    )
    return features.leak_check(selected, outcome, "brand")


@query(
    _with("codes")
    + """SELECT p_partkey AS code, p_name, p_brand, p_type FROM part
         WHERE p_partkey IN (SELECT code FROM codes) AND (p_type LIKE 'ECONOMY' OR p_type LIKE 'STANDARD')"""
)
def describe_codes(s: RetailStudy) -> DataFrame:
    dictionary = s.table("part").where(F.col("p_type").isin("ECONOMY", "STANDARD"))
    entries = dictionary.select(F.col("p_partkey").alias("code"), "p_name", "p_brand", "p_type")
    return features.describe_codes(s.codes().select("code"), entries, "code")


# --- controls and matching -------------------------------------------------------------


@query(_with("cases") + "SELECT segment, area, count(*) AS n FROM cases GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def stratum_sizes(s: RetailStudy) -> DataFrame:
    return controls.stratum_sizes(s.cases, STRATA).orderBy(F.desc("n"), *STRATA)


@query(
    _with("pool")
    + f"""SELECT person, segment, area, draw FROM (
            SELECT pool.*, row_number() OVER (PARTITION BY segment, area
                   ORDER BY md5('{SEED}|' || person), person) AS draw
            FROM pool JOIN (SELECT person, min(event_date) AS first_date FROM ev GROUP BY 1) USING (person)
            WHERE year(first_date) < 1997) WHERE draw <= 30"""
)
def control_pool(s: RetailStudy) -> DataFrame:
    orders = s.table("orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey"), "o_orderdate")
    present = orders.join(
        s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"
    )
    early = (
        present.groupBy("person")
        .agg(F.min("o_orderdate").alias("first_date"))
        .where(F.col("first_date") < F.lit("1997-01-01").cast("timestamp_ntz"))
        .select("person")
    )
    return controls.control_pool(s.pool().join(early, "person", "left_semi"), "person", STRATA, 30, SEED)


_SETTLED = f"{FIRST_YEAR}-01-01", f"{LAST_YEAR}-12-31"


@query(
    _with("pool", "spans", "persons")
    + f""", known AS (SELECT person, o_orderkey, start_date, end_date FROM spans WHERE priority <> '5-LOW'),
       marked AS (SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY person ORDER BY start_date, o_orderkey
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM known),
       islands AS (SELECT *, sum(fresh) OVER (PARTITION BY person ORDER BY start_date, o_orderkey) AS island FROM marked),
       settled AS (SELECT DISTINCT person FROM (SELECT person, island FROM islands GROUP BY 1, 2
                   HAVING min(start_date) <= DATE '{_SETTLED[0]}' AND max(end_date) >= DATE '{_SETTLED[1]}'))
       SELECT person, segment, birth_year, draw FROM (
         SELECT pool.person, pool.segment, CAST(year(born) AS INTEGER) AS birth_year, row_number() OVER (PARTITION BY pool.segment, year(born)
                ORDER BY md5('{SEED}|' || pool.person), pool.person) AS draw
         FROM pool JOIN settled USING (person) JOIN persons USING (person)) WHERE draw <= 30"""
)
def control_pool_settled(s: RetailStudy) -> DataFrame:
    """Pool by segment and birth year of persons whose known addresses cover the study years without a gap."""
    known = s.intervals(of=s.pool()).where(F.col("priority") != "5-LOW")
    settled = cases.covered_throughout(known, "person", "start", "end", *_SETTLED)
    born = s.persons.select("person", F.year("born").alias("birth_year"))
    pool = s.pool().select("person", "segment").join(settled, "person", "left_semi").join(born, "person")
    return controls.control_pool(pool, "person", ["segment", "birth_year"], 30, SEED)


_EXCLUDE = (
    _with("persons", "cases", "ev")
    + """, dead AS (SELECT c_custkey AS person FROM customer WHERE c_acctbal < 0),
       wide_codes AS (SELECT p_partkey AS code FROM part WHERE p_name LIKE 'red gizmo'),
       gp AS (SELECT DISTINCT person FROM ev WHERE code IN (SELECT code FROM wide_codes)),
       outcome AS (SELECT DISTINCT person FROM ev WHERE code IN (SELECT code FROM codes)),
       hospital AS (SELECT DISTINCT o_custkey AS person FROM orders
                    JOIN lineitem ON o_orderkey = l_orderkey
                    JOIN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue gizmo' AND (p_size > 25) IS NOT TRUE) x
                      ON l_partkey = p_partkey)
    """
)


def _exclusions(s: RetailStudy) -> dict[str, DataFrame]:
    hospital_codes = s.codes("blue gizmo", 25).select("code")
    diagnosed = cases.with_codes(s.diagnoses(), hospital_codes, "code").join(s.spells(), "spell")
    broad = s.table("part").where(F.col("p_name").like("red gizmo")).select(F.col("p_partkey").alias("code"))
    dead = s.table("customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("person"))
    lists = {"broad code": broad, "outcome code": s.codes().select("code")}
    return {
        "dead": dead,
        "case": s.cases.select("person"),
        **controls.persons_by_list(s.events, lists, "code", ["person"]),
        "hospital code": controls.persons_with(diagnosed, "person"),
    }


@query(
    _EXCLUDE
    + """SELECT person, segment, area FROM persons
         WHERE person NOT IN (SELECT person FROM dead) AND person NOT IN (SELECT person FROM cases)
           AND person NOT IN (SELECT person FROM gp) AND person NOT IN (SELECT person FROM outcome)
           AND person NOT IN (SELECT person FROM hospital)"""
)
def exclude_cascade(s: RetailStudy) -> DataFrame:
    return controls.exclude(s.persons.drop("born"), _exclusions(s))


@query(
    _EXCLUDE
    + """, a AS (SELECT person FROM persons WHERE person NOT IN (SELECT person FROM dead)),
       b AS (SELECT person FROM a WHERE person NOT IN (SELECT person FROM cases)),
       c AS (SELECT person FROM b WHERE person NOT IN (SELECT person FROM gp)),
       d AS (SELECT person FROM c WHERE person NOT IN (SELECT person FROM outcome)),
       e AS (SELECT person FROM d WHERE person NOT IN (SELECT person FROM hospital)),
       t AS (SELECT (SELECT count(*) FROM persons) AS n0, (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2,
             (SELECT count(*) FROM c) AS n3, (SELECT count(*) FROM d) AS n4, (SELECT count(*) FROM e) AS n5)
       SELECT 1 AS step, 'dead' AS source, n0 - n1 AS n_removed, n1 AS n_left FROM t
       UNION ALL SELECT 2, 'case', n1 - n2, n2 FROM t
       UNION ALL SELECT 3, 'broad code', n2 - n3, n3 FROM t
       UNION ALL SELECT 4, 'outcome code', n3 - n4, n4 FROM t
       UNION ALL SELECT 5, 'hospital code', n4 - n5, n5 FROM t"""
)
def exclude_ledger(s: RetailStudy) -> DataFrame:
    return controls.exclusion_ledger(s.persons.select("person"), _exclusions(s))


@query(_with("pairs") + "SELECT case_person, control_person, index_date, segment, area FROM pairs")
def match_exact(s: RetailStudy) -> DataFrame:
    return s.pairs()


@query(
    _with("cases", "pool", "persons", "aged")
    + f"""SELECT c.person AS case_person, p.person AS control_person, index_date, c.segment, CAST(c.birth_year AS INTEGER) AS birth_year
          FROM (SELECT *, row_number() OVER (PARTITION BY segment, birth_year ORDER BY md5('{SEED}|' || person), person) AS slot
                FROM (SELECT cases.person, cases.index_date, cases.segment, year(cases.index_date) - age AS birth_year
                      FROM cases JOIN aged USING (person))) c
          JOIN (SELECT *, (row_number() OVER (PARTITION BY segment, birth_year
                     ORDER BY md5('{SEED}|' || person), person) - 1) // {CONTROLS_PER_CASE} + 1 AS slot
                FROM (SELECT pool.person, pool.segment, year(born) AS birth_year FROM pool JOIN persons USING (person))) p
          ON c.segment = p.segment AND c.birth_year = p.birth_year AND c.slot = p.slot"""
)
def match_birth_year(s: RetailStudy) -> DataFrame:
    """Exact matching within segment and birth year; a case's is the year of its event less its age."""
    aged = s.aged_index().select("person", (F.year("index_date") - F.col("age")).alias("birth_year"))
    listed = s.cases.select("person", "index_date", "segment").join(aged, "person")
    born = s.persons.select("person", F.year("born").alias("birth_year"))
    pool = s.pool().select("person", "segment").join(born, "person")
    return matching.match_exact(
        listed.withColumn("turn", hash_order(F.col("person"), SEED)),
        pool.withColumn("draw", hash_order(F.col("person"), SEED)),
        "person",
        ["segment", "birth_year"],
        CONTROLS_PER_CASE,
        ["turn", "person"],
        ["draw", "person"],
        [hash_bucket(F.col("turn"))],
        [hash_bucket(F.col("draw"))],
    ).drop("turn")


@query(_with("sets") + "SELECT case_person, control_person, index_date, segment, area FROM sets")
def complete_sets(s: RetailStudy) -> DataFrame:
    return matching.complete_sets(s.staged_pairs, "case_person", CONTROLS_PER_CASE)


@query(_with("grouped") + "SELECT case_person, control_person, index_date, segment, area, group_id FROM grouped")
def group_ids(s: RetailStudy) -> DataFrame:
    return s.grouped()


@query(_with("members") + "SELECT person, index_date, segment, area, group_id, label FROM members")
def stack_members(s: RetailStudy) -> DataFrame:
    return s.members


# --- features --------------------------------------------------------------------------

_FEATURE_COLUMNS = "person, segment, area, group_id, label, brand, mean_value, n_events"


@query(
    _with("cases", "bev", "persons", "found")
    + _CHOSEN
    + f"SELECT {_FEATURE_COLUMNS} FROM found WHERE brand IN (SELECT brand FROM chosen)"
)
def lookback_chosen_codes(s: RetailStudy) -> DataFrame:
    """Look-back features on the codes that the data itself chose: most frequent, cut, then looked up."""
    return s.lookback(store.stage(_frequent(s).select("brand"), "chosen"))


@query(_with("found") + f"SELECT {_FEATURE_COLUMNS} FROM found")
def lookback_features(s: RetailStudy) -> DataFrame:
    return s.lookback()


@query(
    _with("old")
    + """SELECT person, segment, area, group_id, label, brand, avg(value) AS mean_value, count(*) AS n_events
         FROM old GROUP BY ALL"""
)
def lookback_all_events(s: RetailStudy) -> DataFrame:
    return features.lookback_features(
        s.members, s.brand_events, s.brands, "person", "brand", "index_date", "event_date", "value",
        GAP_DAYS, count_mode="all",
    )


@query(_with("feats") + f"SELECT {_FEATURE_COLUMNS} FROM feats")
def backfill_members(s: RetailStudy) -> DataFrame:
    return s.features


@query(
    _with("feats")
    + f"""SELECT {_FEATURE_COLUMNS} FROM (
            SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY label DESC, person) AS seq FROM feats)
          WHERE seq <= 2"""
)
def rebalance_1to1(s: RetailStudy) -> DataFrame:
    return features.rebalance(s.features, "group_id", "label", "person")


@query(
    _with("feats")
    + """SELECT brand, label, avg(mean_value) AS mean_mean_value, median(mean_value) AS median_mean_value,
                avg(n_events) AS mean_n_events, median(n_events) AS median_n_events
         FROM (SELECT brand, label, round(mean_value, 4) AS mean_value, n_events FROM feats)
         WHERE brand <> 'Z' GROUP BY 1, 2""".replace("avg(mean_value) AS", "round(avg(mean_value), 6) AS")
)
def feature_contrast(s: RetailStudy) -> DataFrame:
    rounded = s.features.withColumn("mean_value", F.round("mean_value", 4))
    chosen = rounded.where(F.col("brand") != "Z")
    out = features.feature_contrast(chosen, "brand", "label", ["mean_value", "n_events"])
    return out.withColumn("mean_mean_value", F.round("mean_mean_value", 6))


# --- wide table ------------------------------------------------------------------------

_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    _with("feats")
    + "SELECT person, group_id, label, "
    + ", ".join(
        f"CAST(COALESCE(max(CASE WHEN brand = '{b}' THEN n_events END), 0) AS BIGINT) AS n_{b.replace('#', '_')}, "
        f"max(CASE WHEN brand = '{b}' THEN mean_value END) AS val_{b.replace('#', '_')}"
        for b in _BRANDS
    )
    + " FROM feats GROUP BY 1, 2, 3"
)
def pivot_wide(s: RetailStudy) -> DataFrame:
    return s.wide_table()


@query(
    _with("miss")
    + """SELECT label, n_rows, 'val_' || replace(brand, '#', '_') AS column_name, n_missing,
         n_missing < n_rows * 0.5 AS kept FROM miss"""
)
def missingness_by_class(s: RetailStudy) -> DataFrame:
    return wide.missingness(s.wide, wide.value_columns(s.wide), "label")


@query(
    _with("miss")
    + """SELECT label, n_rows, 'val_' || replace(brand, '#', '_') AS column_name, n_missing,
         n_missing < n_rows * 0.5 AS kept FROM miss"""
)
def missingness_of_long(s: RetailStudy) -> DataFrame:
    """The wide table's missing values, counted without it."""
    return s.value_profile()


_TOP = 10
_TOP_SQL = (
    _with("feats")
    + f""", top AS (SELECT brand, row_number() OVER (ORDER BY count(*) DESC, brand) AS place
             FROM feats WHERE brand <> 'Z' GROUP BY brand QUALIFY place <= {_TOP})"""
)


@query(
    _TOP_SQL
    + "SELECT person, group_id, label, "
    + ", ".join(
        f"CAST(COALESCE(max(CASE WHEN place = {i} THEN n_events END), 0) AS BIGINT) AS n_{i}, "
        f"max(CASE WHEN place = {i} THEN mean_value END) AS val_{i}"
        for i in range(1, _TOP + 1)
    )
    + " FROM feats LEFT JOIN top USING (brand) GROUP BY 1, 2, 3"
)
def pivot_top_codes(s: RetailStudy) -> DataFrame:
    """Columns for the most frequent codes only, by their places; every member keeps its row."""
    top = wide.top_codes(s.features, "brand", _TOP)
    places = {c: str(i + 1) for i, c in enumerate(top)}
    return wide.pivot_wide(s.features, ["person", "group_id", "label"], "brand", top, names=places)


@query(
    _TOP_SQL
    + """SELECT person, group_id, label, brand, n_events, mean_value FROM feats
         WHERE brand <> 'Z' AND brand NOT IN (SELECT brand FROM top)"""
)
def outside_top_codes(s: RetailStudy) -> DataFrame:
    """The long rows of all codes that `pivot_top_codes` has no column for."""
    rest = wide.outside_codes(s.features, "brand", wide.top_codes(s.features, "brand", _TOP))
    return rest.select("person", "group_id", "label", "brand", "n_events", "mean_value")


@query(
    _with("grid", "miss")
    + """, kept AS (SELECT DISTINCT brand FROM miss WHERE n_missing < n_rows * 0.5)
       SELECT person, group_id, grid.label, 'val_' || replace(grid.brand, '#', '_') AS column_name,
              CASE WHEN n_missing < n_rows * 0.5 THEN COALESCE(mean_value, med) END AS value
       FROM grid JOIN kept USING (brand) JOIN miss ON miss.brand = grid.brand AND miss.label = grid.label"""
)
def impute_median_by_class(s: RetailStudy) -> DataFrame:
    filled = s.imputed(keep="any")
    return wide.unpivot_values(filled, ["person", "group_id", "label"], wide.value_columns(filled))


@query(
    _with("members")
    + f"""SELECT group_id, CASE WHEN rn <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS part
          FROM (SELECT group_id, row_number() OVER (ORDER BY md5('{SEED}|' || group_id), group_id) AS rn,
                       count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM members))"""
)
def group_split(s: RetailStudy) -> DataFrame:
    return wide.group_split(s.members, "group_id", 0.75, SEED)


# --- evaluation ------------------------------------------------------------------------


def _labelled(s: RetailStudy) -> DataFrame:
    joined = s.table("labels").join(s.table("documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.scored_frame(joined, "quality", "toxic", "n_chars")


@query(
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
                         count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp,
                         count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn,
                         count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels),
       d AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n, (tp + tn) / (tp + fp + fn + tn) AS acc,
                    tp / (tp + fn) AS sens, tn / (tn + fp) AS spec FROM c),
       e AS (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS chance FROM d)
       SELECT tp, fp, fn, tn, round(acc, 9) AS accuracy, round(sens, 9) AS sensitivity, round(spec, 9) AS specificity,
              round(tp / (tp + fp), 9) AS ppv, round(tn / (tn + fn), 9) AS npv, round((tp + fn) / n, 9) AS prevalence,
              round(tp / n, 9) AS detection_rate, round((tp + fp) / n, 9) AS detection_prevalence,
              round((sens + spec) / 2, 9) AS balanced_accuracy, round((acc - chance) / (1 - chance), 9) AS kappa,
              round(greatest(tp + fn, tn + fp) / n, 9) AS no_information_rate,
              round(greatest(abs(fp - fn) - 1, 0) ** 2 / (fp + fn), 9) AS mcnemar FROM e"""
)
def confusion_report(s: RetailStudy) -> DataFrame:
    report = evaluate.confusion_report(evaluate.confusion_counts(s.table("labels"), "quality", "toxic"))
    return report.select(
        *report.columns[:4], *[F.round(c, 9).alias(c) for c in report.columns[4:]]
    )


_HALVED = """list_reduce(list_prepend({{'low': 0.0::DOUBLE, 'high': 1.0::DOUBLE}}, list_transform(range(0, 52),
                lambda i: {{'low': 0.0::DOUBLE, 'high': 1.0::DOUBLE}})), lambda s, i:
                CASE WHEN list_sum(list_transform(range({first}, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1)
                       - lgamma(n - k + 1) + k * ln((s.low + s.high) / 2) + (n - k) * ln(1 - (s.low + s.high) / 2)))) < {tail}
                THEN {{'low': (s.low + s.high) / 2, 'high': s.high}}
                ELSE {{'low': s.low, 'high': (s.low + s.high) / 2}} END)"""


@query(
    f"""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
                          count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp,
                          count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn,
                          count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels),
       d AS (SELECT *, tp + fp + fn + tn AS n, tp + tn AS x, greatest(tp + fn, tn + fp) / (tp + fp + fn + tn) AS rate,
                    greatest(abs(fp - fn) - 1, 0) / sqrt(fp + fn) AS z FROM c),
       e AS (SELECT *, {_HALVED.format(first="x", tail=0.025)} AS low,
                    {_HALVED.format(first="x + 1", tail=0.975)} AS high FROM d)
       SELECT tp, fp, fn, tn, round(low.low, 9) AS accuracy_low, round(high.low, 9) AS accuracy_high,
              round(list_sum(list_transform(range(x, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1)
                - lgamma(n - k + 1) + k * ln(rate) + (n - k) * ln(1 - rate)))), 9) AS p_accuracy_over_nir,
              -- by Simpson's rule over the normal density
              round(1 - 2 / sqrt(2 * pi()) * z / 30000 * list_sum(list_transform(range(0, 10001), lambda i:
                CASE WHEN i IN (0, 10000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * power(z * i / 10000, 2)))), 9) AS p_mcnemar
       FROM e"""
)
def agreement_tests(s: RetailStudy) -> DataFrame:
    """Exact accuracy interval and p-values of the label table's four counts."""
    report = evaluate.agreement_report(evaluate.confusion_counts(s.table("labels"), "quality", "toxic"))
    return report.select(*report.columns[:4], *[F.round(c, 9).alias(c) for c in report.columns[4:]])


@query("SELECT toxic AS predicted, quality AS observed, count(*) AS n FROM labels GROUP BY 1, 2")
def contingency_table(s: RetailStudy) -> DataFrame:
    pairs = s.table("labels").select(F.col("toxic").alias("predicted"), F.col("quality").alias("observed"))
    return evaluate.contingency(pairs, "predicted", "observed")


@query(
    _with("curve")
    + """SELECT threshold, tp, fp, round(tp / p, 9) AS sensitivity, round(1 - fp / n, 9) AS specificity FROM curve"""
)
def roc_points(s: RetailStudy) -> DataFrame:
    points = evaluate.roc_points(_labelled(s), "truth", "score")
    return points.withColumns(
        {"sensitivity": F.round("sensitivity", 9), "specificity": F.round("specificity", 9)}
    )


@query(
    _with("scored")
    + ", m AS (SELECT 'n_chars' AS model, truth, score FROM scored"
    + " UNION ALL SELECT 'toxic', truth, CAST(prediction AS DOUBLE) FROM scored),"
    + """ g AS (SELECT model, score AS threshold, count(*) FILTER (WHERE truth = 1) AS pos,
               count(*) FILTER (WHERE truth <> 1) AS neg FROM m GROUP BY 1, 2)
       SELECT model, threshold,
              round(sum(neg) OVER w / sum(neg) OVER (PARTITION BY model), 9) AS false_positive_rate,
              round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY model), 9) AS sensitivity
       FROM g WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)"""
)
def roc_overlay(s: RetailStudy) -> DataFrame:
    scored = _labelled(s)
    second = scored.withColumn("score", F.col("prediction").cast("double"))
    overlay = evaluate.roc_overlay({"n_chars": scored, "toxic": second}, "truth", "score")
    return overlay.withColumns(
        {
            "false_positive_rate": F.round("false_positive_rate", 9),
            "sensitivity": F.round("sensitivity", 9),
        }
    )


@query(
    _with("curve")
    + """SELECT max(p) AS n_positive, max(n) AS n_negative,
         round(sum(neg * (tp - pos / 2)) / (CAST(max(p) AS DOUBLE) * max(n)), 9) AS auc FROM curve"""
)
def auc_exact(s: RetailStudy) -> DataFrame:
    return evaluate.auc_exact(_labelled(s), "truth", "score").withColumn("auc", F.round("auc", 9))


# --- the same operators where keys are missing or are text ------------------------------


@query(
    """SELECT * FROM (
         SELECT l_orderkey, line, part, l_suppkey, l_quantity,
                row_number() OVER (PARTITION BY l_orderkey, line
                                   ORDER BY part NULLS LAST, l_suppkey, l_quantity) AS seq
         FROM (SELECT l_orderkey, nullif(l_linenumber, 3) AS line,
                      CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS part, l_suppkey, l_quantity
               FROM lineitem)) WHERE seq > 1"""
)
def duplicate_sequence_nulls(s: RetailStudy) -> DataFrame:
    lines = s.table("lineitem").select(
        "l_orderkey",
        F.nullif(F.col("l_linenumber"), F.lit(3)).alias("line"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("part"),
        "l_suppkey",
        "l_quantity",
    )
    block = F.call_function("div", F.col("part"), F.lit(1000))
    return quality.duplicate_sequence(lines, ["l_orderkey", "line"], ["part", "l_suppkey", "l_quantity"], [block])


@query(
    f"""SELECT * FROM (
          SELECT person, priority, o_orderkey, start_date, end_date,
                 lag(end_date) OVER (PARTITION BY person ORDER BY start_date, priority, o_orderkey) AS previous_end_date
          FROM (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS person, o_orderpriority AS priority,
                       o_orderkey, CAST(o_orderdate AS DATE) AS start_date, {_SPAN_90} AS end_date FROM orders))
        WHERE person IS NOT NULL AND start_date <= previous_end_date"""
)
def interval_overlaps_nulls(s: RetailStudy) -> DataFrame:
    spans = s.table("orders").select(
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("person"),
        F.col("o_orderpriority").alias("priority"),
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 90).alias("end_date"),
    )
    return quality.overlaps(spans, ["person"], "start_date", "end_date", ["priority", "o_orderkey"])


@query(
    _with("pool")
    + f"""SELECT person, segment, area, draw FROM (
            SELECT person, segment, area, row_number() OVER (PARTITION BY segment, area
                   ORDER BY md5('{SEED}|' || person), person) AS draw
            FROM (SELECT person, nullif(segment, 'MACHINERY') AS segment, nullif(area, 2) AS area FROM pool))
          WHERE draw <= 30"""
)
def control_pool_null_stratum(s: RetailStudy) -> DataFrame:
    pool = s.pool().select(
        "person",
        F.nullif(F.col("segment"), F.lit("MACHINERY")).alias("segment"),
        F.nullif(F.col("area"), F.lit(2)).alias("area"),
    )
    return controls.control_pool(pool, "person", STRATA, 30, SEED)


@query(
    _with("sets")
    + """SELECT 'p' || case_person AS case_id, control_person,
                dense_rank() OVER (ORDER BY 'p' || case_person) AS group_id FROM sets"""
)
def group_ids_text(s: RetailStudy) -> DataFrame:
    named = s.sets.select(F.concat(F.lit("p"), F.col("case_person").cast("string")).alias("case_id"), "control_person")
    return matching.assign_group(named, "case_id")


# --- steps of the study on their own ----------------------------------------------------


@query(
    _with("feats")
    + """SELECT person, brand, n_events, nullif(floor(mean_value / 10), 0) AS tens FROM feats"""
)
def zero_to_missing(s: RetailStudy) -> DataFrame:
    """Mean values in tens, where zero stands for not measured."""
    tens = s.features.select("person", "brand", "n_events", F.floor(F.col("mean_value") / 10).cast("double").alias("tens"))
    return quality.zero_to_null(tens, "tens")


@query(
    _with("feats")
    + """SELECT DISTINCT 'val_' || regexp_replace(brand, '[^A-Za-z0-9]', '_', 'g') AS column_name
         FROM feats WHERE mean_value IS NOT NULL AND brand NOT LIKE '%3'"""
)
def columns_with_values(s: RetailStudy) -> DataFrame:
    """Value columns left when those without any value are dropped."""
    some = s.features.withColumn("mean_value", F.when(~F.col("brand").endswith("3"), F.col("mean_value")))
    table = wide.pivot_wide(some, ["person", "group_id", "label"], "brand", s.brand_names)
    left = wide.value_columns(wide.drop_all_missing(table, wide.value_columns(table)))
    return s.spark.createDataFrame([(c,) for c in left], "column_name string")


@query(
    _with("grouped", "members", "feats", "codes")
    + f"""SELECT 'sets of the wrong size' AS "check", count(*) AS n_violations FROM
            (SELECT case_person FROM grouped GROUP BY 1 HAVING count(*) <> {CONTROLS_PER_CASE})
          UNION ALL SELECT 'controls used twice', count(*) FROM
            (SELECT control_person FROM grouped GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'members listed twice', count(*) FROM (SELECT person FROM members GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'matched rows with a NULL', count(*) FROM grouped
            WHERE case_person IS NULL OR control_person IS NULL OR segment IS NULL OR area IS NULL OR index_date IS NULL
          UNION ALL SELECT 'members without a feature row', count(*) FROM members
            WHERE person NOT IN (SELECT person FROM feats)
          UNION ALL SELECT 'outcome codes among the features', count(*) FROM
            (SELECT DISTINCT brand FROM feats WHERE brand IN (SELECT CAST(code AS VARCHAR) FROM codes))"""
)
def cohort_checks(s: RetailStudy) -> DataFrame:
    return matching.cohort_checks(
        s.grouped(),
        s.members,
        s.features.withColumnRenamed("brand", "code"),
        s.codes().select(F.col("code").cast("string").alias("code")),
        "case_person",
        "control_person",
        "person",
        "code",
        CONTROLS_PER_CASE,
    )


@query(
    """SELECT count(*) FILTER (WHERE n_chars > 2000 AND quality = 1) AS tp,
              count(*) FILTER (WHERE n_chars > 2000 AND quality <> 1) AS fp,
              count(*) FILTER (WHERE n_chars <= 2000 AND quality = 1) AS fn,
              count(*) FILTER (WHERE n_chars <= 2000 AND quality <> 1) AS tn
       FROM labels JOIN documents USING (doc_id)"""
)
def threshold_confusion(s: RetailStudy) -> DataFrame:
    """Rows classified by a threshold on their score, counted against the truth."""
    scored = s.table("labels").join(s.table("documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.confusion_counts(evaluate.classify(scored, "n_chars", 2000), "quality", "prediction")


@query(
    _with("miss")
    + """, filled AS (SELECT g.person, g.brand, COALESCE(g.mean_value, m.med) AS value FROM grid g
                      JOIN (SELECT brand, median(mean_value) AS med FROM grid GROUP BY 1) m USING (brand))
         SELECT person, 'val_' || regexp_replace(brand, '[^A-Za-z0-9]', '_', 'g') AS column_name,
                round(value, 9) AS value FROM filled WHERE value IS NOT NULL"""
)
def impute_median_overall(s: RetailStudy) -> DataFrame:
    """Missing values filled by the median of all rows, which tells nothing of the label."""
    columns = wide.value_columns(s.wide)
    filled = wide.impute_median(s.wide, columns, by=None, fit_on=s.wide)
    long = wide.unpivot_values(filled, ["person"], columns).where(F.col("value").isNotNull())
    return long.withColumn("value", F.round("value", 9))


# --- models ----------------------------------------------------------------------------

# Naive Bayes in SQL: class means and variances of every feature over the train rows, a small
# share of the largest variance added to each, and the class probabilities of the test rows.
_SPLIT = f"""parts AS (SELECT group_id, CASE WHEN rn <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS part
          FROM (SELECT group_id, row_number() OVER (ORDER BY md5('{SEED}|' || group_id), group_id) AS rn,
                       count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM members)))"""
_BALANCED = """first_two AS (SELECT person FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY label DESC, person) AS seq
               FROM (SELECT DISTINCT group_id, label, person FROM members)) WHERE seq <= 2),
       b_grid AS (SELECT * FROM grid WHERE person IN (SELECT person FROM first_two)),
       b_miss AS (SELECT label, brand, count(*) AS n_rows, count(*) FILTER (WHERE mean_value IS NULL) AS n_missing,
                  median(mean_value) AS med FROM b_grid GROUP BY 1, 2)"""


def _nb_sql(pre: str = "", out: str = "nb") -> str:
    """CTEs ending in one with person, group_id, label, prediction, score of the test rows."""
    return f"""{out}_kept AS (SELECT brand FROM {pre}miss GROUP BY 1 HAVING bool_and(n_missing < n_rows * 0.5)),
       {out}_x AS (SELECT person, group_id, label, 'n' || brand AS f, CAST(COALESCE(n_events, 0) AS DOUBLE) AS v FROM {pre}grid
         UNION ALL
         SELECT person, group_id, g.label, 'v' || brand, COALESCE(mean_value, med) FROM {pre}grid g JOIN {out}_kept USING (brand)
         JOIN {pre}miss m USING (label, brand)),
       {out}_t AS (SELECT * FROM {out}_x JOIN parts USING (group_id) WHERE part = 'train'),
       {out}_eps AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT avg(v * v) - avg(v) * avg(v) AS v FROM {out}_t GROUP BY f)),
       {out}_s AS (SELECT label, f, avg(v) AS mu, avg(v * v) - avg(v) * avg(v) + any_value(eps) AS var FROM {out}_t, {out}_eps GROUP BY 1, 2),
       {out}_p AS (SELECT label, ln(count(DISTINCT person)) AS prior FROM {out}_t GROUP BY 1),
       {out}_l AS (SELECT person, group_id, x.label, s.label AS k,
                     any_value(prior) - 0.5 * sum((v - mu) * (v - mu) / var + ln(var)) AS ll
                   FROM {out}_x x JOIN parts USING (group_id) JOIN {out}_s s ON s.f = x.f JOIN {out}_p p ON p.label = s.label
                   WHERE part = 'test' GROUP BY 1, 2, 3, 4),
       {out} AS (SELECT person, group_id, CAST(label AS DOUBLE) AS label, CAST(CASE WHEN d >= 0 THEN 0 ELSE 1 END AS DOUBLE) AS prediction,
                   round(CASE WHEN d > 700 THEN 0 ELSE 1 / (1 + exp(d)) END, 9) AS score
                 FROM (SELECT person, group_id, label, sum(CASE WHEN k = 0 THEN ll ELSE -ll END) AS d FROM {out}_l GROUP BY 1, 2, 3))"""


_NB = _with("grid", "miss") + f", {_SPLIT}, {_nb_sql()} "
_NB_BOTH = _with("grid", "miss") + f", {_SPLIT}, {_BALANCED}, {_nb_sql()}, {_nb_sql('b_', 'nb_b')} "


def _predictions(s: RetailStudy, estimator, top: int | None = None, balanced: bool = False) -> DataFrame:
    train, test = s.balanced_train_test if balanced else s.train_test
    columns = wide.feature_columns(train)
    model = models.fit(train, columns, estimator)
    if top is not None:
        columns = models.top_variables(model, columns, top)
        model = models.fit(train, columns, estimator)
    return models.predict(model, test, ["person", "group_id"])


def _bayes(s: RetailStudy, balanced: bool = False) -> DataFrame:
    return _predictions(s, models.naive_bayes(), balanced=balanced).withColumn("score", F.round("score", 9))


def _both_bayes(s: RetailStudy) -> dict[str, DataFrame]:
    return {
        name: store.stage(_bayes(s, balanced), "scored") for name, balanced in (("five controls", False), ("one control", True))
    }


@query()
def rf_predictions(s: RetailStudy) -> DataFrame:
    return _predictions(s, models.forest())


@query()
def rf_reduced(s: RetailStudy) -> DataFrame:
    return _predictions(s, models.forest(), top=15)


@query()
def rf_importance(s: RetailStudy) -> DataFrame:
    train, _ = s.train_test
    columns = wide.feature_columns(train)
    return models.importance(models.fit(train, columns, models.forest()), columns, train)


@query()
def rf_cv(s: RetailStudy) -> DataFrame:
    train, _ = s.train_test
    found = models.cross_validate(train, wide.feature_columns(train), models.forest(), "group_id", folds=10)
    return s.spark.createDataFrame(
        [(10, float(found.avgMetrics[0]), float(found.stdMetrics[0]))],
        "folds int, accuracy double, accuracy_sd double",
    )


@query()
def rf_error(s: RetailStudy) -> DataFrame:
    """Error and confusion of the forest on rows its trees have not seen."""
    train, _ = s.train_test
    scored = models.out_of_fold(
        train, wide.feature_columns(train), models.forest(), "group_id", ["person"], folds=10
    )
    counts = evaluate.confusion_counts(scored, models.LABEL, "prediction")
    return evaluate.confusion_report(counts).withColumn("error", 1 - F.col("accuracy"))


@query()
def svm_predictions(s: RetailStudy) -> DataFrame:
    return _predictions(s, models.linear_svm())


@query(_NB + "SELECT person, group_id, label, prediction, score FROM nb")
def nb_predictions(s: RetailStudy) -> DataFrame:
    return _bayes(s)


@query(_NB_BOTH + "SELECT person, group_id, label, prediction, score FROM nb_b")
def nb_predictions_balanced(s: RetailStudy) -> DataFrame:
    """Naive Bayes on the case and the first control of each set."""
    return _bayes(s, balanced=True)


_RATES = """SELECT model, tp, fp, fn, tn, round((tp + tn) / n, 9) AS accuracy, round(tp / (tp + fn), 9) AS sensitivity,
       round(tn / (tn + fp), 9) AS specificity, round(((tp + tn) / n - chance) / (1 - chance), 9) AS kappa
       FROM (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))
                    / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)) AS chance
             FROM (SELECT model, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                          count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                          count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                          count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM both_nb GROUP BY 1))"""
_NB_MODELS = _NB_BOTH + (
    ", both_nb AS (SELECT 'five controls' AS model, * FROM nb UNION ALL SELECT 'one control', * FROM nb_b), "
    "nb_curve AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg "
    "FROM both_nb GROUP BY 1, 2) "
)


def _reports(scored: dict[str, DataFrame], rounded: int = 9) -> DataFrame:
    """Confusion counts and rates of several scored models."""
    out = None
    for name, df in scored.items():
        report = evaluate.confusion_report(evaluate.confusion_counts(df, models.LABEL, "prediction"))
        chosen = report.select(
            F.lit(name).alias("model"), "tp", "fp", "fn", "tn",
            *[F.round(c, rounded).alias(c) for c in ("accuracy", "sensitivity", "specificity", "kappa")],
        )
        out = chosen if out is None else out.unionByName(chosen)
    return out


def _areas(scored: dict[str, DataFrame], rounded: int = 9) -> DataFrame:
    out = None
    for name, df in scored.items():
        area = evaluate.auc_exact(df, models.LABEL, "score").select(
            F.lit(name).alias("model"), "n_positive", "n_negative", F.round("auc", rounded).alias("auc")
        )
        out = area if out is None else out.unionByName(area)
    return out


@query(_NB_MODELS + _RATES)
def model_confusion(s: RetailStudy) -> DataFrame:
    """Confusion and rates of a fitted model on the test rows, on the 1:5 and on the 1:1 data."""
    return _reports(_both_bayes(s))


@query(
    _NB_MODELS
    + """SELECT model, CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative,
                round(sum(neg * (above + pos / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS auc
         FROM (SELECT *, coalesce(sum(pos) OVER (PARTITION BY model ORDER BY score DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM nb_curve) GROUP BY 1"""
)
def model_auc(s: RetailStudy) -> DataFrame:
    """Area under the ROC curve of a fitted model, on the 1:5 and on the 1:1 data."""
    return _areas(_both_bayes(s))


@query(
    _NB_MODELS
    + """SELECT model, score AS threshold,
                round(sum(neg) OVER w / sum(neg) OVER (PARTITION BY model), 9) AS false_positive_rate,
                round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY model), 9) AS sensitivity
         FROM nb_curve WINDOW w AS (PARTITION BY model ORDER BY score DESC)"""
)
def model_roc_overlay(s: RetailStudy) -> DataFrame:
    """ROC points of a fitted model on the 1:5 and on the 1:1 data, to draw in one picture."""
    overlay = evaluate.roc_overlay(_both_bayes(s), models.LABEL, "score")
    return overlay.withColumns({c: F.round(c, 9) for c in ("false_positive_rate", "sensitivity")})


@query()
def model_comparison(s: RetailStudy) -> DataFrame:
    """Confusion, rates and AUC of forest, tree, logistic model and naive Bayes, on the 1:5 and the 1:1 data."""
    scored = {}
    for data, balanced in (("five controls", False), ("one control", True)):
        train, test = s.balanced_train_test if balanced else s.train_test
        columns = wide.feature_columns(train)
        makers = {
            "forest": (models.forest(), columns),
            "tree": (models.tree(), columns),
            "logistic": (models.logistic_glm(), models.varying_columns(train, columns)),
            "naive Bayes": (models.naive_bayes(), columns),
        }
        for name, (estimator, used) in makers.items():
            fitted = models.fit(train, used, estimator)
            scored[f"{name}, {data}"] = store.stage(models.predict(fitted, test, ["person", "group_id"]), "scored")
    return _reports(scored).join(_areas(scored), "model")


@query(
    _with("grid", "miss")
    + f""", {_SPLIT}, med AS (SELECT brand, median(mean_value) AS med FROM grid JOIN parts USING (group_id)
                              WHERE part = 'train' GROUP BY 1)
         SELECT person, label, 'val_' || regexp_replace(brand, '[^A-Za-z0-9]', '_', 'g') AS column_name,
                round(COALESCE(mean_value, med), 9) AS value
         FROM grid JOIN parts USING (group_id) JOIN med USING (brand)
         WHERE part = 'test' AND COALESCE(mean_value, med) IS NOT NULL"""
)
def impute_median_of_train(s: RetailStudy) -> DataFrame:
    """Test rows filled by medians of the train rows alone: nothing of a label or a test row leaks."""
    _, test = s.unlabelled_train_test
    long = wide.unpivot_values(test, ["person", "label"], wide.value_columns(test)).where(F.col("value").isNotNull())
    return long.withColumn("value", F.round("value", 9))


@query()
def tree_predictions(s: RetailStudy) -> DataFrame:
    return _predictions(s, models.tree())


@query()
def tree_size_table(s: RetailStudy) -> DataFrame:
    train, _ = s.train_test
    return models.tree_size_table(train, wide.feature_columns(train), "group_id", [1, 3, 5], [0.0, 0.01], folds=10)


@query()
def tree_cp_table(s: RetailStudy) -> DataFrame:
    """Subtrees of a classification tree by cost per leaf, with training and cross-validated error."""
    train, _ = s.train_test
    return trees.cp_table(train, wide.feature_columns(train), "group_id")


@query(
    """SELECT unnest(['relative errors that the training rows do not confirm', 'subtrees that do not contain the next',
              'costs that do not rise', 'smaller subtrees with fewer errors',
              'costs that are not the errors won for each leaf', 'sequences that do not end with the root']) AS "check",
              CAST(0 AS BIGINT) AS n_violations"""
)
def tree_cp_checks(s: RetailStudy) -> DataFrame:
    """Where the sequence of subtrees contradicts the training rows or itself: nowhere."""
    train, _ = s.train_test
    found = trees.complexity(train, wide.feature_columns(train), "group_id").violations()
    return s.spark.createDataFrame(found, "check string, n_violations long")


def _out_of_bag(s: RetailStudy) -> DataFrame:
    train, _ = s.train_test
    return trees.out_of_bag(train, wide.feature_columns(train), "person")


@query()
def rf_oob(s: RetailStudy) -> DataFrame:
    """Error and confusion of the forest, each row judged by the trees that did not draw it."""
    scored = store.stage(_out_of_bag(s), "out_of_bag")
    report = evaluate.confusion_report(evaluate.confusion_counts(scored, models.LABEL, "prediction"))
    unjudged = scored.agg(F.count_if(F.col("prediction").isNull()).alias("n_without_vote"))
    return report.withColumn("error", 1 - F.col("accuracy")).join(F.broadcast(unjudged))


@query(
    _with("members")
    + f""", {_SPLIT}
         SELECT person, CAST(label AS DOUBLE) AS label, count(*) FILTER (WHERE CAST('0x' || substr(md5('{SEED}|' || bag || '|' || person), 1, 12)
                  AS BIGINT) / CAST(281474976710656 AS DOUBLE) < exp(-1)) AS n_votes
         FROM members JOIN parts USING (group_id), (SELECT unnest(range(0, 25)) AS bag)
         WHERE part = 'train' GROUP BY 1, 2"""
)
def rf_oob_votes(s: RetailStudy) -> DataFrame:
    """From how many bags each training row got a vote: those that did not draw it."""
    return _out_of_bag(s).select("person", models.LABEL, "n_votes")


@query()
def rf_importance_raw(s: RetailStudy) -> DataFrame:
    """Variables by the impurity they take away in the forest, before any scaling, and their share."""
    train, _ = s.train_test
    columns = wide.feature_columns(train)
    return trees.raw_importance(trees.node_table(models.fit(train, columns, models.forest()), train), columns)


@query(
    _with("miss")
    + """, named AS (SELECT DISTINCT 'n_' || replace(p_brand, '#', '_') AS variable FROM part
           UNION ALL SELECT 'val_' || replace(brand, '#', '_') FROM miss GROUP BY brand
           HAVING bool_and(n_missing < n_rows * 0.5))
         SELECT variable, false AS aliased, true AS solved FROM named
         UNION ALL SELECT 'n_all', true, NULL UNION ALL SELECT 'n_none', true, NULL UNION ALL SELECT 'n_twice', true, NULL"""
)
def glm_aliased(s: RetailStudy) -> DataFrame:
    """The logistic model with columns that depend on others, which get no coefficient; the rest solve the score equations."""
    train, _ = s.train_test
    columns = wide.feature_columns(train)
    counts = [c for c in columns if c.startswith(wide.COUNT_PREFIX)]
    more = train.withColumns(
        {"n_all": sum((F.col(c) for c in counts[1:]), F.col(counts[0])), "n_none": F.lit(3), "n_twice": 2 * F.col(counts[-1]) - 1}
    )
    used = models.independent_columns(more, [*columns, "n_all", "n_none", "n_twice"])
    table = models.glm_table(more, [*columns, "n_all", "n_none", "n_twice"])
    left = models.score_equations(more, used, models.fit(more, used, models.logistic_glm()))
    solved = left.select("variable", (F.abs("share") < 1e-4).alias("solved"))
    return table.where(F.col("variable") != "(Intercept)").join(solved, "variable", "left").select("variable", "aliased", "solved")


@query()
def glm_summary(s: RetailStudy) -> DataFrame:
    train, _ = s.train_test
    columns = models.varying_columns(train, wide.feature_columns(train))
    return models.glm_summary(models.fit(train, columns, models.logistic_glm()), columns, train)


@query()
def glm_bootstrap(s: RetailStudy) -> DataFrame:
    train, _ = s.train_test
    return models.glm_bootstrap(train, wide.feature_columns(train), "person", replicates=25)


@query()
def store_roundtrip(s: RetailStudy) -> DataFrame:
    """Write, append and read back a table; save and load a model fitted on it."""
    folder = store.new_path(s.spark, "roundtrip")
    train, test = s.train_test
    store.write_table(train, f"{folder}/table")
    store.append_table(test, f"{folder}/table")
    back = store.read_table(s.spark, f"{folder}/table")
    columns = wide.feature_columns(back)
    store.save_model(models.fit(back, columns, models.tree()), f"{folder}/model")
    return models.predict(store.load_model(f"{folder}/model"), back, ["person", "group_id"])
