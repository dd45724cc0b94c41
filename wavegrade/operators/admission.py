"""What is let in and what is doubted: protocol declarations, ids, matched requests, taint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protocols in the order that ALL stands for, and what a doubt says.
PROTOCOLS = ("FIX", "REST", "WS")
UNRELIABLE = "t7 stream unreliable: %d late + %d anomalous of %d orders exceeds rate %.4f"
CAPTURE_LOST = "capture lost the responses for %d of %d orders (%.1f%%): the contestant answered them but no orders.acked record arrived, so they are excluded from grading"


def tidy(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))


def protocols(rows: DataFrame, declared: str = "declared") -> DataFrame:
    """The declaration's protocols in its own order, and problem: '' or the first of invalid and duplicate. ALL alone stands for all;
    case and spaces don't count. Where there is a problem protocols is null; a null or empty declaration is invalid."""
    parts = F.transform(F.split(F.coalesce(F.col(declared), F.lit("")), ","), tidy)
    strange = F.array_position(F.transform(parts, lambda p: ~p.isin(*PROTOCOLS)), True)
    again = F.array_position(F.transform(parts, lambda p, i: F.array_position(parts, p) <= i), True)
    problem = F.when((strange > 0) & ((again == 0) | (strange < again)), "invalid").when(again > 0, "duplicate").otherwise("")
    is_all = F.coalesce(tidy(F.col(declared)) == "ALL", F.lit(False))
    everything = F.array(*(F.lit(p) for p in PROTOCOLS))
    return rows.withColumn("problem", F.when(is_all, "").otherwise(problem)).withColumn("protocols", F.when(is_all, everything).when(problem == "", parts))


def admitted(rows: DataFrame, key: str, by: list[str], most_bytes: int = 64) -> DataFrame:
    """For each `by`, how many rows have an id (null counts as empty) of 1 to most_bytes bytes of UTF-8, a longer one, none."""
    size = F.coalesce(F.octet_length(key), F.lit(0))
    return rows.groupBy(*by).agg(F.count_if((size > 0) & (size <= most_bytes)).alias("admitted"), F.count_if(size > most_bytes).alias("too_long"), F.count_if(size == 0).alias("empty"))


def matched(messages: DataFrame) -> DataFrame:
    """A row for each session_id and cl_ord_id with a request and a response: the nanoseconds between the first of each, repeats of
    the request, and whether a request came out of order. messages: class (request or response), at_ns, reordered; ids that are empty or null are left out."""
    request, response = F.col("class") == "request", F.col("class") == "response"
    told = messages.where("cl_ord_id <> ''").groupBy("session_id", "cl_ord_id").agg(F.count_if(request).alias("requests"), F.min(F.when(request, F.col("at_ns"))).alias("asked"), F.min(F.when(response, F.col("at_ns"))).alias("answered"), F.coalesce(F.max(F.when(request, F.col("reordered"))), F.lit(False)).alias("reordered"))
    return told.where("asked is not null and answered is not null").select("session_id", "cl_ord_id", (F.col("answered") - F.col("asked")).alias("service_ns"), (F.col("requests") - 1).alias("retransmissions"), "reordered")


def taint(counts: DataFrame, late_rate: float = 0.001, gap_rate: float = 0.01) -> DataFrame:
    """Whether a session's grade is to be doubted, and why: too many late or anomalous answers of those applied, or too many capture
    gaps of all orders (this reason stands where both hold). counts: late, anomalies, applied, scored, gaps; a rate of nothing is no doubt."""
    suspect, orders = F.col("late") + F.col("anomalies"), F.col("scored") + F.col("gaps")
    unreliable = (F.col("applied") > 0) & (suspect / F.nullif("applied", F.lit(0)) > late_rate)
    lost = (orders > 0) & (F.col("gaps") / F.nullif(orders, F.lit(0)) > gap_rate)
    share = F.lit(100.0) * F.col("gaps") / F.nullif(orders, F.lit(0))
    reason = F.when(lost, F.format_string(CAPTURE_LOST, "gaps", orders, share)).when(unreliable, F.format_string(UNRELIABLE, "late", "anomalies", "applied", F.lit(late_rate))).otherwise("")
    return counts.withColumn("reason", reason).withColumn("tainted", F.col("reason") != "")
