"""Bill-of-materials rollup: per robot, weight, idle / active current,
power, voltage rails, first battery, battery life and the current limit
check, from a component list joined to the component catalogue.

The catalogue is a fixed 27-row table, broadcast (its size is known); the
rollup is one ``groupBy(robot)`` whose per-robot lists are bounded by the
robot's own component count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import fround

# Component catalogue (type, category, weight_g, voltage_nominal,
# current_idle_ma, current_stall_ma, current_ma, current_max_a, voltage,
# capacity_mah, max_discharge_c); None = spec absent.
CATALOG = [
    ("servo_micro", "actuator", 9.0, 5.0, 10.0, 650.0, None, None, None, None, None),
    ("servo_standard", "actuator", 55.0, 6.0, 20.0, 2500.0, None, None, None, None, None),
    ("servo_high_torque", "actuator", 68.0, 6.0, 30.0, 3000.0, None, None, None, None, None),
    ("dc_motor_small", "actuator", 12.0, 6.0, None, 800.0, None, None, None, None, None),
    ("dc_motor_large", "actuator", 320.0, 12.0, None, 12000.0, None, None, None, None, None),
    ("stepper_nema17", "actuator", 280.0, 12.0, None, None, None, None, None, None, None),
    ("bldc_motor", "actuator", 47.0, 11.1, None, None, None, 15.0, None, None, None),
    ("imu_mpu6050", "sensor", 2.0, 3.3, None, None, 3.9, None, None, None, None),
    ("ultrasonic_hcsr04", "sensor", 9.0, 5.0, None, None, 15.0, None, None, None, None),
    ("lidar_rplidar", "sensor", 170.0, 5.0, None, None, 500.0, None, None, None, None),
    ("camera_module", "sensor", 3.0, 3.3, None, None, 250.0, None, None, None, None),
    ("force_sensor", "sensor", 1.0, 3.3, None, None, 1.0, None, None, None, None),
    ("encoder_rotary", "sensor", 30.0, 5.0, None, None, 10.0, None, None, None, None),
    ("lipo_1s_500", "power", 15.0, None, None, None, None, None, 3.7, 500.0, 25.0),
    ("lipo_2s_2200", "power", 120.0, None, None, None, None, None, 7.4, 2200.0, 30.0),
    ("lipo_3s_5000", "power", 395.0, None, None, None, None, None, 11.1, 5000.0, 50.0),
    ("18650_cell", "power", 45.0, None, None, None, None, None, 3.7, 2600.0, 5.0),
    ("arduino_nano", "controller", 7.0, 5.0, None, None, 50.0, None, None, None, None),
    ("raspberry_pi_4", "controller", 46.0, 5.0, None, None, 3000.0, None, None, None, None),
    ("esp32", "controller", 5.0, 3.3, None, None, 240.0, None, None, None, None),
    ("jetson_nano", "controller", 140.0, 5.0, None, None, 4000.0, None, None, None, None),
    ("frame_plate", "structure", 40.5, None, None, None, None, None, None, None, None),
    ("frame_tube", "structure", 12.0, None, None, None, None, None, None, None, None),
    ("wheel_rubber", "structure", 28.0, None, None, None, None, None, None, None, None),
    ("motor_driver_l298n", "electronics", 30.0, 5.0, None, None, None, None, None, None, None),
    ("voltage_regulator", "electronics", 3.0, None, None, None, None, None, None, None, None),
    ("bec_5v_3a", "electronics", 8.0, None, None, None, None, None, None, None, None),
]
# Fixed value: an actuator draws idle + 30 % of (stall - idle) x duty cycle.
ACTIVE_LOAD_SHARE = 0.3

CATALOG_SCHEMA = ("type string, category string, weight_g double, voltage_nominal double, current_idle_ma double, "
                  "current_stall_ma double, current_ma double, current_max_a double, voltage double, "
                  "capacity_mah double, max_discharge_c double")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CATALOG)], "cat_idx int, " + CATALOG_SCHEMA)


def component_loads(components: DataFrame, cat: DataFrame) -> DataFrame:
    """Per component: weight, idle and average current, voltage and power.
    Unknown types drop out of the inner join with the catalogue."""
    j = components.join(F.broadcast(cat.drop("cat_idx")), "type", "inner")
    q = F.coalesce(F.col("quantity"), F.lit(1)).cast("double")
    duty = F.coalesce(F.col("duty_cycle"), F.lit(1.0))
    zero = F.lit(0.0)
    idle_act = F.coalesce(F.col("current_idle_ma"), F.col("current_ma"), zero)
    stall = F.coalesce(F.col("current_stall_ma"), F.coalesce(F.col("current_max_a"), zero) * 1000)
    cat_ = F.col("category")
    idle = (F.when(cat_ == "actuator", idle_act).when(cat_ == "power", zero)
            .otherwise(F.coalesce(F.col("current_ma"), zero)))
    avg = (F.when(cat_ == "actuator", idle_act + (stall - idle_act) * duty * ACTIVE_LOAD_SHARE)
           .when(cat_ == "power", zero).otherwise(F.coalesce(F.col("current_ma"), zero)))
    v = F.coalesce(F.col("voltage_nominal"), F.col("voltage"), zero)
    return j.select("*", (F.col("weight_g") * q).alias("w"), (idle * q).alias("idle"), (avg * q).alias("avg"),
                    v.alias("v")).withColumn("power_w", fround(F.col("v") * F.col("avg") / 1000, 3))


def bom_rollup(components: DataFrame, robot: str = "robot_id", pos: str = "pos") -> DataFrame:
    """components: robot, pos (order), type, quantity, duty_cycle."""
    spark = components.sparkSession
    c = component_loads(components, catalog(spark))
    rail_item = F.when((F.col("v") > 0) & (F.col("category") != "power"),
                       F.struct(F.col(pos).alias("p"), F.col("v").alias("v"), F.col("type").alias("t")))
    bat = F.when(F.col("category") == "power",
                 F.struct(F.col("type").alias("type"), F.col("capacity_mah").alias("cap"),
                          (F.col("capacity_mah") * F.col("max_discharge_c") / 1000).alias("max_a")))
    exact = "decimal(24,6)"  # exact sums: totals do not depend on summation order
    g = c.groupBy(robot).agg(
        F.sum(F.col("w").cast(exact)).alias("weight"), F.sum(F.col("idle").cast(exact)).alias("idle"),
        F.sum(F.col("avg").cast(exact)).alias("active"), F.sum(F.col("power_w").cast(exact)).alias("power"),
        F.sort_array(F.collect_list(rail_item)).alias("rails"),
        F.min_by(bat, F.when(bat.isNotNull(), F.col(pos))).alias("battery"))
    firsts = F.array_distinct(F.transform("rails", lambda r: r["v"]))
    rails_txt = F.array_join(F.transform(firsts, lambda v: F.concat(
        v.cast("string"), F.lit("="), F.array_join(F.transform(F.filter("rails", lambda r: r["v"] == v), lambda r: r["t"]), ","))), ";")
    act = F.col("active").cast("double")
    life = F.when(F.col("battery").isNotNull() & (act > 0), fround(F.col("battery.cap") / act * 60, 1))
    ok = ~(F.col("battery").isNotNull() & (act / 1000 > F.col("battery.max_a")))
    return g.select(robot, F.round("weight", 1).cast("double").alias("total_weight_g"),
                    F.round("idle", 0).cast("bigint").alias("total_current_idle_ma"),
                    F.round("active", 0).cast("bigint").alias("total_current_active_ma"),
                    F.round("power", 2).cast("double").alias("total_power_w"), rails_txt.alias("voltage_rails"),
                    F.col("battery.type").alias("battery"), life.alias("battery_life_minutes"),
                    ok.alias("current_within_limits"))
