"""Golden records by lexicographic elimination: one record per cluster, each field from its best source.

A field has candidates (the records that may supply it) and a list of criteria.
A round aggregates, per cluster and field, the best value of the next criterion among the
field's candidates, and a semi-join against these keeps the candidates that have it. A cluster
leaves the rounds when each of its fields has one candidate left or no criterion
more. A field may wait for another one: when the other's candidates agree on a
value, that value is told to the cluster's records and may be used by the waiting
field's criteria, as the segment is by the balance.

Each round is one map-side combined aggregate and one join of the records that still
compete; records out of every field's race, and the values of fields that a record
no longer competes for, are not carried on. Clusters of one record never enter a
round. A cluster with a large share of all records is never gathered: its
aggregate has one row per task and its records are told the bests by
``join_groups``. Each round's records are written to the shared folder, so a lost
executor costs parts of one round.

Defined cases: a text that is empty or blank counts as null, and so does a
balance that is not finite or has more cents than a long holds; unknown and null sources are trusted least; a
null criterion is worse than any other; records without both ids make one
cluster of id null; a null ``client_id`` is the last in a tie; records that
still tie (rows that repeat a ``client_id`` with the same rank) supply the
smallest value, null last; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import Workspace, join_groups

TRUSTED_FIRST = ("crm", "web", "store", "partner")
STALE_MICROS = 60 * 24 * 3600 * 1_000_000


@dataclass(frozen=True)
class Field:
    """What a golden record takes from one source record.

    ``values``: its columns. ``candidate``: SQL for the records that may supply it.
    ``criteria``: SQL of longs, best first, the largest value of each wins and null is
    worst. ``after``: a field of one value that must be settled first; criteria may compare with it as ``chosen_<after>``.
    """

    name: str
    values: Sequence[str]
    candidate: str
    criteria: Sequence[str] = field(default_factory=tuple)
    after: str | None = None


def _micros(column: str, kind: T.DataType) -> Column:
    """Microseconds of a time column, whatever the session's time zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    since = F.col(column).cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def eliminate(work: Workspace, rows: DataFrame, keys: Sequence[str], spread: str, fields: Sequence[Field]) -> DataFrame:
    """``keys``, ``n`` (rows of the cluster) and, for each field, a struct ``<name>`` of its values and the source's ``spread`` (null without candidates).

    ``rows`` is a written table; ``keys`` are never null there, ``spread`` names a column that tells a cluster's rows apart, and
    ``records`` has the number of rows of each row's cluster.
    """
    keys, held, length = list(keys), {f.name: f.values for f in fields}, {f.name: len(f.criteria) for f in fields}
    waits = {f.after for f in fields if f.after}
    open_ = rows
    for f in fields:
        at = F.lit(None).cast("int") if f.after else F.lit(0)  # null: waits
        open_ = open_.withColumns({f"ok_{f.name}": F.coalesce(F.expr(f.candidate), F.lit(False)), f"at_{f.name}": at})
    for name in sorted(waits):
        open_ = open_.withColumn(f"chosen_{name}", F.lit(None).cast(rows.schema[held[name][0]].dataType))
    open_ = open_.withColumn("more", F.col("records") > 1)
    table, step, closed = work.table(open_, "round0"), 0, []
    while True:
        closed.append(table.where("NOT more"))
        racing = table.where("more")
        if racing.isEmpty():
            break
        # the next criterion of every field, and what the candidates of fields that others wait for agree on
        next_ = {f.name: _next(f) for f in fields}
        best = [F.max(F.when(F.col(f"ok_{f.name}"), next_[f.name])).alias(f"best_{f.name}") for f in fields]
        left = [F.sum(F.col(f"ok_{f.name}").cast("long")).alias(f"left_{f.name}") for f in fields]
        among = lambda name: F.when(F.col(f"ok_{name}"), F.col(held[name][0]))
        agreed = [g for name in sorted(waits) for g in (F.min(among(name)).alias(f"lo_{name}"), F.max(among(name)).alias(f"hi_{name}"))]
        bests = work.table(racing.groupBy(*keys).agg(F.count("*").alias("n"), *best, *left, *agreed), f"best{step}")
        met = join_groups(racing, bests, keys, F.col(spread))
        out, more = {}, F.lit(False)
        for f in fields:
            ok, at = F.col(f"ok_{f.name}"), F.col(f"at_{f.name}")
            out[f"ok_{f.name}"] = ok & (at.isNull() | next_[f.name].eqNullSafe(F.col(f"best_{f.name}")))
            settled = F.lit(True)
            if f.after:
                settled = F.coalesce(F.col(f"at_{f.after}") >= length[f.after], F.lit(False)) | F.col(f"lo_{f.after}").eqNullSafe(F.col(f"hi_{f.after}"))
            out[f"at_{f.name}"] = F.when(at.isNotNull(), at + 1).when(settled, F.lit(0)) if f.after else at + 1
            # a field is open while several candidates are left and a criterion too
            more |= (F.col(f"left_{f.name}") > 1) & F.coalesce(at + 1 < len(f.criteria), F.lit(True))
        for name in sorted(waits):
            out[f"chosen_{name}"] = F.coalesce(F.col(f"chosen_{name}"), F.when(F.col(f"lo_{name}").eqNullSafe(F.col(f"hi_{name}")) | (F.col(f"at_{name}") >= length[name]), F.col(f"lo_{name}")))
        out["more"] = more
        met = met.withColumns(out).select(*table.columns)
        kept = {v: F.when(F.greatest(*[F.col(f"ok_{f.name}") for f in fields if v in f.values], F.lit(False)), F.col(v)) for v in {v for f in fields for v in f.values}}
        step += 1
        table = work.table(met.where(F.greatest(*[F.col(f"ok_{f.name}") for f in fields], F.lit(False))).withColumns(kept), f"round{step}")
        work.drop(f"best{step - 1}")
    rest = closed[0]
    for part in closed[1:]:
        rest = rest.unionByName(part)

    def winner(f: Field) -> Column:
        # rows that tie to the end: the smallest values, null last
        ranked = F.struct(*[x for v in (*f.values, spread) for x in (F.col(v).isNull().alias(f"no_{v}"), F.col(v))])
        return F.min(F.when(F.col(f"ok_{f.name}"), ranked)).alias(f.name)

    return rest.groupBy(*keys).agg(F.max("records").alias("n"), *[winner(f) for f in fields])


def _next(f: Field) -> Column:
    at = F.col(f"at_{f.name}")
    found = F.lit(None).cast("long")
    for k, criterion in enumerate(f.criteria):
        found = F.when(at == k, F.expr(criterion).cast("long")).otherwise(found)
    return found


def golden_records(
    clients: DataFrame, *, client_col: str = "client_id", master_col: str = "master_id", source_col: str = "source", time_col: str = "updated_at", name_col: str = "name", email_col: str = "email",
    city_col: str = "city", nation_col: str = "nation_id", segment_col: str = "segment", balance_col: str = "balance", trusted: Sequence[str] = TRUSTED_FIRST, stale_micros: int = STALE_MICROS,
) -> DataFrame:
    """``cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents`` and where each came from (``*_from``)."""
    work = Workspace(clients.sparkSession, "golden")
    said = lambda c: F.when(F.col(c).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.col(c).cast("string"))
    trust = F.lit(0)
    for k, source in enumerate(trusted):
        trust = F.when(said(source_col) == source, len(trusted) - k).otherwise(trust)
    cents = F.floor(100 * F.col(balance_col).cast("double") + F.lit(0.5))
    whole = F.abs(F.col(balance_col).cast("double")) < 9e16  # false for what is not finite
    cluster = F.coalesce(F.col(master_col), F.col(client_col)).cast("long")
    rows = clients.select(
        F.coalesce(cluster, F.lit(0)).alias("key"), cluster.isNull().alias("nameless"), F.col(client_col).cast("long").alias("client"), trust.alias("trust"), _micros(time_col, clients.schema[time_col].dataType).alias("at"),
        said(name_col).alias("name"), said(email_col).alias("email"), said(city_col).alias("city"), F.col(nation_col).alias("nation"), said(segment_col).alias("segment"), F.when(whole, cents).alias("cents"),
    )
    keys = ["key", "nameless"]
    latest = work.table(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("at").alias("latest")), "latest")
    fresh = F.coalesce(F.col("latest") - F.col("at") <= stale_micros, F.lit(False)).cast("long")
    aged = join_groups(rows, latest, keys, F.col("client")).select(*rows.columns, fresh.alias("fresh"), F.col("n").alias("records"))
    aged = work.table(aged, "aged")
    recent = ("at", "trust", "~client")  # ~x falls as x rises, without overflow
    trusting = ("fresh", "trust", *recent)
    fields = (
        Field("segment", ["segment"], "segment IS NOT NULL", recent),
        Field("email", ["email"], "email IS NOT NULL", trusting),
        Field("name", ["name"], "name IS NOT NULL", ("length(name)", *trusting)),
        Field("address", ["city", "nation"], "true", ("int(city IS NOT NULL) + int(nation IS NOT NULL)", *trusting)),
        Field("balance", ["cents"], "cents IS NOT NULL", ("int(coalesce(own = chosen_segment, false))", *recent), after="segment"),
    )
    # the record's own segment stays beside the one it competes with
    found = eliminate(work, aged.withColumn("own", F.col("segment")), keys, "client", fields)
    stale = aged.groupBy(*keys).agg(F.sum(1 - F.col("fresh")).alias("n_stale"))
    out = found.join(stale, keys)
    return out.select(
        F.when(~F.col("nameless"), F.col("key")).alias("cluster_id"), F.col("n").alias("n_records"), "n_stale", "name.name", "email.email", "segment.segment", F.col("address.city").alias("city"), F.col("address.nation").alias("nation_id"), F.col("balance.cents").alias("balance_cents"),
        F.col("name.client").alias("name_from"), F.col("email.client").alias("email_from"), F.col("segment.client").alias("segment_from"), F.col("balance.client").alias("balance_from"),
        F.when(F.col("address.city").isNotNull() | F.col("address.nation").isNotNull(), F.col("address.client")).alias("address_from"),
    )


def op11_golden(spark, sf_dir: str) -> DataFrame:
    return golden_records(spark.read.parquet(f"{sf_dir}/clients.parquet"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at,
         CASE source WHEN 'crm' THEN 4 WHEN 'web' THEN 3 WHEN 'store' THEN 2 WHEN 'partner' THEN 1 ELSE 0 END AS trust,
         CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name,
         CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
         CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city,
         CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment,
         nation_id, CASE WHEN isfinite(balance) THEN floor(100 * balance + 0.5)::BIGINT END AS cents
  FROM clients
), d AS (
  SELECT *, coalesce(epoch_us(max(updated_at) OVER (PARTITION BY cluster_id)) - epoch_us(updated_at) <= 60 * 24 * 3600 * 1000000::BIGINT, false) AS fresh,
         (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS said
  FROM c
), e AS (
  SELECT *,
         row_number() OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, updated_at DESC NULLS LAST, trust DESC, client_id, segment) AS by_segment,
         row_number() OVER (PARTITION BY cluster_id ORDER BY email IS NULL, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id, email) AS by_email,
         row_number() OVER (PARTITION BY cluster_id ORDER BY name IS NULL, length(name) DESC, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id, name) AS by_name,
         row_number() OVER (PARTITION BY cluster_id ORDER BY said DESC, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id, city, nation_id) AS by_address
  FROM d
), f AS (
  SELECT *, first_value(segment) OVER (PARTITION BY cluster_id ORDER BY by_segment) AS chosen FROM e
), g AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cents IS NULL, coalesce(segment = chosen, false) DESC, updated_at DESC NULLS LAST, trust DESC, client_id, cents) AS by_balance FROM f
)
SELECT cluster_id, count(*) AS n_records, count(*) FILTER (NOT fresh) AS n_stale,
       max(name) FILTER (by_name = 1) AS name, max(email) FILTER (by_email = 1) AS email, max(segment) FILTER (by_segment = 1) AS segment,
       max(city) FILTER (by_address = 1) AS city, max(nation_id) FILTER (by_address = 1) AS nation_id, max(cents) FILTER (by_balance = 1) AS balance_cents,
       max(client_id) FILTER (by_name = 1 AND name IS NOT NULL) AS name_from, max(client_id) FILTER (by_email = 1 AND email IS NOT NULL) AS email_from,
       max(client_id) FILTER (by_segment = 1 AND segment IS NOT NULL) AS segment_from, max(client_id) FILTER (by_balance = 1 AND cents IS NOT NULL) AS balance_from,
       max(client_id) FILTER (by_address = 1 AND said > 0) AS address_from
FROM g GROUP BY cluster_id
"""
