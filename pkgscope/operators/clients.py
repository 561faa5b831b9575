"""Client selection (C1-C9): which client versions depend on which upstream
versions, as joins and window aggregates over requirements and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.functions import versions as V
from pkgscope.session import share


def release_versions(releases: DataFrame) -> DataFrame:
    """V3/V4: one row per (pkg, ver) with the release time (earliest file
    upload) and the version key; versions without files do not appear."""
    return (
        releases.groupBy("pkg", "ver")
        .agg(F.min("upload_time").alias("time"))
        .withColumn("vkey", V.version_key(F.col("ver")))
    )


def client_requirements(reqs: DataFrame, upstreams: DataFrame) -> DataFrame:
    """Requirements of client versions on the chosen upstream packages.

    reqs: c_pkg, c_ver, dep, spec.  upstreams: pkg (chosen upstream names)."""
    return (
        reqs.select("c_pkg", "c_ver", F.col("dep").alias("u_pkg"), F.col("spec").alias("u_spec"))
        .distinct()
        .join(upstreams.select(F.col("pkg").alias("u_pkg")).distinct(), "u_pkg", "left_semi")
    )


def spec_versions(cr: DataFrame, rel: DataFrame) -> DataFrame:
    """Satisfying versions per distinct (u_pkg, u_spec): dep, spec, ver, time, vkey."""
    sat = V.matching_versions(cr.select(F.col("u_pkg").alias("dep"), F.col("u_spec").alias("spec")),
                              rel.select("pkg", "ver"))
    return sat.join(rel.withColumnRenamed("pkg", "dep"), ["dep", "ver"]).select("dep", "spec", "ver", "time", "vkey")


def spec_summary(sat: DataFrame) -> DataFrame:
    """C2/C4 per distinct (dep, spec): the satisfying versions in release-date
    order and the newest one.  Bounded by the version count of one package."""
    return sat.groupBy("dep", "spec").agg(
        F.max_by("ver", "vkey").alias("u_ver_current"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("time", "vkey", "ver"))), lambda x: x["ver"]), ","
        ).alias("u_vers"),
        F.max("time").alias("_last_time"),
        F.max(F.struct("vkey", "ver"))["ver"].alias("_best_all"),
    )


def asof_newest(rows: DataFrame, sat: DataFrame, time_col: str, bucket_days: int = 30) -> DataFrame:
    """C3 as-of join: for each row (with dep, spec, ``time_col``) the newest
    satisfying version released strictly before ``time_col``.

    The satisfying versions of a (dep, spec) form a staircase: after each
    release time ``t`` the best version so far holds until the next release
    time.  Steps are few (one per release time), so they are exploded over
    fixed time buckets and equi-joined on (dep, spec, bucket) with a range
    filter: each row meets only the steps of its own bucket, a hot (dep,
    spec) is split by bucket and by AQE's skew handling, and no row is ever
    paired with every version.  Rows after the last step take the overall
    best (from :func:`spec_summary`, joined by the caller)."""
    secs = 86400 * bucket_days

    def bucket(c):
        return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / secs)

    w = Window.partitionBy("dep", "spec").orderBy("time")
    steps = (
        sat.groupBy("dep", "spec", "time").agg(F.max(F.struct("vkey", "ver")).alias("_b"))
        .withColumn("_best", F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_t_next", F.lead("time").over(w))
        .where(F.col("_t_next").isNotNull())
        .select("dep", "spec", F.col("time").alias("_t0"), "_t_next", F.col("_best")["ver"].alias("_pub"),
                F.explode(F.sequence(bucket("time"), bucket("_t_next"))).alias("_bucket"))
    )
    keyed = rows.withColumn("_bucket", bucket(time_col))
    cond = [keyed["dep"] == steps["dep"], keyed["spec"] == steps["spec"], keyed["_bucket"] == steps["_bucket"],
            steps["_t0"] < keyed[time_col], keyed[time_col] <= steps["_t_next"]]
    return keyed.join(steps, cond, "left").select(keyed["*"], steps["_pub"]).drop("_bucket")


def find_clients(reqs: DataFrame, client_times: DataFrame, releases: DataFrame, upstreams: DataFrame,
                 drop_failing: bool = True) -> DataFrame:
    """For every client version and upstream requirement, the
    satisfying upstream versions (release-date order), the newest one
    released strictly before the client (``u_ver_published``) and the newest
    one overall (``u_ver_current``).  A client package with any row lacking
    either is dropped whole (C5) unless ``drop_failing`` is False.

    client_times: c_pkg, c_ver, c_time (release time of the client version).
    releases: pkg, ver, upload_time (one row per file).
    """
    # Shared intermediates are kept once (persisted) instead of being
    # re-derived from the scans by each consumer.
    rel = share(release_versions(releases).join(upstreams.select("pkg").distinct(), "pkg", "left_semi"))
    cr = share(client_requirements(reqs, upstreams))
    sat = share(spec_versions(cr, rel))
    summ = share(spec_summary(sat))
    rows = (
        cr.join(client_times, ["c_pkg", "c_ver"])
        .withColumnRenamed("u_pkg", "dep").withColumnRenamed("u_spec", "spec")
        .join(summ.drop("u_vers"), ["dep", "spec"], "left")
    )
    rows = asof_newest(rows, sat, "c_time")
    out = rows.select(
        "c_pkg", "c_ver", "c_time", F.col("dep").alias("u_pkg"), F.col("spec").alias("u_spec"),
        F.when(F.col("c_time") > F.col("_last_time"), F.col("_best_all")).otherwise(F.col("_pub")).alias("u_ver_published"),
        "u_ver_current",
    )
    if drop_failing:
        # C5 with a partial aggregate + anti join rather than a window, so a huge
        # client package is never buffered in one task.
        out = share(out)
        bad = out.where(F.col("u_ver_published").isNull() | F.col("u_ver_current").isNull()).select("c_pkg").distinct()
        out = out.join(bad, "c_pkg", "left_anti")
    # the version lists, by far the widest column, only meet the rows that stay
    lists = summ.select(F.col("dep").alias("u_pkg"), F.col("spec").alias("u_spec"), "u_vers")
    return out.join(lists, ["u_pkg", "u_spec"], "left").select("c_pkg", "c_ver", "c_time", "u_pkg", "u_spec", "u_ver_published", "u_ver_current", F.coalesce("u_vers", F.lit("")).alias("u_vers"))


def sample_clients(clients: DataFrame) -> DataFrame:
    """The newest client version per (u_pkg, u_spec, c_pkg), carrying
    u_ver_current and u_vers of that version's first row for the upstream
    (first = smallest specifier text when one is declared twice)."""
    w = Window.partitionBy("u_pkg", "u_spec", "c_pkg").orderBy(V.version_key(F.col("c_ver")).desc(), F.col("c_ver").desc())
    newest = clients.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("u_pkg", "u_spec", "c_pkg", "c_ver")
    w2 = Window.partitionBy("u_pkg", "c_pkg", "c_ver").orderBy("u_spec")
    first = (
        clients.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") == 1)
        .select("u_pkg", "c_pkg", "c_ver", "u_ver_current", "u_vers")
    )
    return newest.join(first, ["u_pkg", "c_pkg", "c_ver"], "left")


def latest_work(sampled: DataFrame) -> DataFrame:
    """Sampled clients whose u_ver_current is the newest u_ver_current
    of their upstream package -> (u_pkg, u_ver, c_pkg, c_ver)."""
    newest = sampled.groupBy("u_pkg").agg(
        F.max_by("u_ver_current", V.version_key(F.col("u_ver_current"))).alias("_latest"))
    return (
        sampled.join(newest, "u_pkg")
        .where(F.col("u_ver_current") == F.col("_latest"))
        .select("u_pkg", F.col("u_ver_current").alias("u_ver"), "c_pkg", "c_ver")
    )


def all_work(sampled: DataFrame) -> DataFrame:
    """One work item per sampled client and satisfying upstream version."""
    return sampled.select("u_pkg", F.explode(F.split("u_vers", ",")).alias("u_ver"), "c_pkg", "c_ver")
