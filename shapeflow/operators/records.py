"""Flow records to segments: only shape and salted ids are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeflow.functions.net import endpoint_id, flow_id, host_id

#: Fields that both ways share: segment column -> record column and type.
SHARED = {
    "first_ms": ("bidirectional_first_seen_ms", "long"), "last_ms": ("bidirectional_last_seen_ms", "long"),
    "mean_ps": ("bidirectional_mean_ps", "double"), "stddev_ps": ("bidirectional_stddev_ps", "double"),
    "min_ps": ("bidirectional_min_ps", "int"), "max_ps": ("bidirectional_max_ps", "int"),
    "mean_piat_ms": ("bidirectional_mean_piat_ms", "double"), "stddev_piat_ms": ("bidirectional_stddev_piat_ms", "double"), "max_piat_ms": ("bidirectional_max_piat_ms", "double"),
    "syn": ("bidirectional_syn_packets", "int"), "fin": ("bidirectional_fin_packets", "int"), "rst": ("bidirectional_rst_packets", "int"),
}
#: Fields of each way: suffix of the segment column -> suffix of the record column and type.
WAYS = {"packets": ("packets", "long"), "bytes": ("bytes", "long"), "mean_piat_ms": ("mean_piat_ms", "double"), "stddev_piat_ms": ("stddev_piat_ms", "double")}


def flipped(directions: Column) -> Column:
    """First packets' directions seen from the other side: 0 and 1 change places, marks of missing packets stay."""
    return F.transform(directions, lambda d: F.when(d.isin(0, 1), 1 - d).otherwise(d))


def _pick(mine: str, other: str) -> Column:
    return F.when(F.col("local_is_src"), F.col(mine)).otherwise(F.col(other))


def flow_key(salt: str) -> Column:
    """The salted id of a record's flow."""
    return flow_id(salt, F.col("protocol"), _pick("src_port", "dst_port"), _pick("dst_ip", "src_ip"), _pick("dst_port", "src_port"))


def to_segments(records: DataFrame, salt: str) -> DataFrame:
    """Segments of flow records with ``local_is_src``, so that up always means from the local side.

    Missing figures count as 0, missing arrays as empty. Addresses and ports end here: the
    flow, endpoint and host ids are salted digests. A flow's id that records have already, as ``key``, stays. A plain select, so it needs no exchange.
    """
    local = F.col("local_is_src")
    key = F.col("key") if "key" in records.columns else flow_key(salt)
    filled = lambda c, t: F.coalesce(c.cast(t), F.lit(0).cast(t))
    ip, remote = _pick("dst_ip", "src_ip"), _pick("dst_port", "src_port")
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    return records.select(
        "iface", "arrival_seq", key.alias("key"), endpoint_id(salt, F.col("protocol"), ip, remote).alias("endpoint"), host_id(salt, ip).alias("host"), "protocol",
        *(filled(F.col(c), t).alias(name) for name, (c, t) in SHARED.items()),
        *(filled(_pick(f"src2dst_{c}", f"dst2src_{c}"), t).alias(f"up_{name}") for name, (c, t) in WAYS.items()),
        *(filled(_pick(f"dst2src_{c}", f"src2dst_{c}"), t).alias(f"down_{name}") for name, (c, t) in WAYS.items()),
        F.when(local, array("splt_direction")).otherwise(flipped(array("splt_direction"))).alias("splt_direction"), array("splt_ps").alias("splt_ps"), array("splt_piat_ms").alias("splt_piat_ms"),
    )
