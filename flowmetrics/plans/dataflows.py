"""Catalogue: industry meter readings, settlement sums and supplier switches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.health import timeline
from ..operators.temporal import trend
from ..sources.standins import elec_readings, gas_meters, gas_rejections, settlement, supplier_switches
from .common import HISTORY, with_views


def _since(df, column):
    return HISTORY.rows(df, column)


def readings_by_validation(spark, sf_dir):
    """readings and distinct supply points per day and validation status."""
    r = _since(elec_readings(spark, sf_dir), "received_date")
    return trend(
        r, "received_date", "day",
        [F.count(F.lit(1)).alias("readings"), F.count_distinct("mpan").alias("unique_mpans")],
        by=["validation_status"], name="date",
    ).orderBy(F.col("date").desc(), F.col("readings").desc())


def failed_read_reasons(spark, sf_dir):
    """failed reads per reason."""
    r = _since(elec_readings(spark, sf_dir), "received_date").where(F.col("failed_read_reason").isNotNull())
    return r.groupBy("failed_read_reason").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc())


def settlement_sums(spark, sf_dir):
    """F6 (AG7): settlement records and exact decimal sums per date and code."""
    s = _since(settlement(spark, sf_dir), "inserted_ts")
    return (
        s.groupBy("settlement_date", "settlement_code")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("total").cast("decimal(38,2)").alias("total_consumption"),
            F.sum("aa").cast("decimal(38,2)").alias("total_aa"),
            F.sum("eac").cast("decimal(38,2)").alias("total_eac"),
        )
        .orderBy(F.col("settlement_date").desc(), "settlement_code")
    )


def settlement_by_gsp(spark, sf_dir):
    """records and consumption per grid supply point and its name."""
    s = _since(settlement(spark, sf_dir), "inserted_ts")
    return s.groupBy("gsp", "gsp_name").agg(F.count(F.lit(1)).alias("records"), F.sum("total").cast("decimal(38,2)").alias("total_kwh")).orderBy(
        F.col("total_kwh").desc(), "gsp"
    )


def supplier_switch_counts(spark, sf_dir):
    """F8: switches per day and supplier pair."""
    s = _since(supplier_switches(spark, sf_dir), "received_date")
    return trend(s, "received_date", "day", [F.count(F.lit(1)).alias("switches")], by=["from_supplier", "to_supplier"], name="date").orderBy(
        F.col("date").desc(), F.col("switches").desc()
    )


def switch_rejections(spark, sf_dir):
    """switch rejections per code."""
    s = _since(supplier_switches(spark, sf_dir), "received_date").where(F.col("rejection_code").isNotNull())
    return s.groupBy("rejection_code").agg(F.count(F.lit(1)).alias("rejections")).orderBy(F.col("rejections").desc())


def gas_meters_by_status(spark, sf_dir):
    """gas meters per status."""
    return gas_meters(spark, sf_dir).groupBy("meter_status").agg(F.count(F.lit(1)).alias("meters")).orderBy(F.col("meters").desc())


def gas_rejections_by_reason(spark, sf_dir):
    """gas rejections per day, reason and acceptance code."""
    r = _since(gas_rejections(spark, sf_dir), "received_date")
    return trend(
        r, "received_date", "day", [F.count(F.lit(1)).alias("rejections")], by=["reason_for_return", "acceptance_code"], name="date"
    ).orderBy(F.col("date").desc(), F.col("rejections").desc())


def gas_rejection_trend(spark, sf_dir):
    """F12 (A16): gas rejections per day."""
    r = _since(gas_rejections(spark, sf_dir), "received_date")
    return trend(r, "received_date", "day", [F.count(F.lit(1)).alias("total_rejections")], name="date").orderBy(F.col("date").desc())


#: Default keys of the lookups; callers pass their own.
ELEC_POINT, GAS_POINT = 1, 1


def meter_point_timeline(spark, sf_dir, point_id=ELEC_POINT):
    """F16 (A35): readings and supplier switches of one electricity supply point, newest first."""
    r = elec_readings(spark, sf_dir).withColumnsRenamed({"validation_status": "status", "reading_no": "row_no"})
    s = supplier_switches(spark, sf_dir).withColumnRenamed("rejection_code", "status").withColumn("row_no", F.lit(0))
    sources = [("D0010", r), ("D0300", s)]
    return timeline(sources, "point_id", "received_date", ["status", "meter_reading"], "row_no", point_id)


def gas_point_returns(spark, sf_dir, point_id=GAS_POINT):
    """F17 (A35): rejected flows of one gas supply point, newest first."""
    r = gas_rejections(spark, sf_dir)
    return timeline([("RET", r)], "point_id", "received_date", ["reason_for_return", "meter_reading"], "return_id", point_id)


QUERIES = {
    "meter_point_timeline": meter_point_timeline,
    "gas_point_returns": gas_point_returns,
    "gas_meters_by_status": gas_meters_by_status,
    "gas_rejections_by_reason": gas_rejections_by_reason,
    "gas_rejection_trend": gas_rejection_trend,
    "readings_by_validation": readings_by_validation,
    "failed_read_reasons": failed_read_reasons,
    "settlement_sums": settlement_sums,
    "settlement_by_gsp": settlement_by_gsp,
    "supplier_switch_counts": supplier_switch_counts,
    "switch_rejections": switch_rejections,
}

ORACLE = {
    "meter_point_timeline": with_views(
        ["elec_readings", "supplier_switches"],
        f"""
select 'D0010' as source, point_id, received_date, validation_status as status, meter_reading
from elec_readings where point_id = {ELEC_POINT}
union all
select 'D0300', point_id, received_date, rejection_code, meter_reading
from supplier_switches where point_id = {ELEC_POINT}""",
    ),
    "gas_point_returns": with_views(
        ["gas_rejections"],
        f"""
select 'RET' as source, point_id, received_date, reason_for_return, meter_reading
from gas_rejections where point_id = {GAS_POINT}""",
    ),
    "readings_by_validation": with_views(
        ["elec_readings"],
        f"""select cast(received_date as date) as date, validation_status, count(*) as readings, count(distinct mpan) as unique_mpans
from elec_readings where {HISTORY.sql("elec_readings", "received_date")} group by 1, 2""",
    ),
    "failed_read_reasons": with_views(
        ["elec_readings"],
        f"""select failed_read_reason, count(*) as count from elec_readings
where {HISTORY.sql("elec_readings", "received_date")} and failed_read_reason is not null group by 1""",
    ),
    "settlement_sums": with_views(
        ["settlement"],
        f"""select settlement_date, settlement_code, count(*) as records, sum(total) as total_consumption,
       sum(aa) as total_aa, sum(eac) as total_eac
from settlement where {HISTORY.sql("settlement", "inserted_ts")} group by 1, 2""",
    ),
    "settlement_by_gsp": with_views(
        ["settlement"],
        f"select gsp, gsp_name, count(*) as records, sum(total) as total_kwh from settlement where {HISTORY.sql("settlement", "inserted_ts")} group by 1, 2",
    ),
    "supplier_switch_counts": with_views(
        ["supplier_switches"],
        f"""select cast(received_date as date) as date, from_supplier, to_supplier, count(*) as switches
from supplier_switches where {HISTORY.sql("supplier_switches", "received_date")} group by 1, 2, 3""",
    ),
    "switch_rejections": with_views(
        ["supplier_switches"],
        f"""select rejection_code, count(*) as rejections from supplier_switches
where {HISTORY.sql("supplier_switches", "received_date")} and rejection_code is not null group by 1""",
    ),
}

ORACLE["gas_meters_by_status"] = with_views(["gas_meters"], "select meter_status, count(*) as meters from gas_meters group by 1")
ORACLE["gas_rejections_by_reason"] = with_views(
    ["gas_rejections"],
    f"""select cast(received_date as date) as date, reason_for_return, acceptance_code, count(*) as rejections
from gas_rejections where {HISTORY.sql("gas_rejections", "received_date")} group by 1, 2, 3""",
)
ORACLE["gas_rejection_trend"] = with_views(
    ["gas_rejections"],
    f"""select cast(received_date as date) as date, count(*) as total_rejections
from gas_rejections where {HISTORY.sql("gas_rejections", "received_date")} group by 1""",
)
