"""Normalising delivered timestamps to instants, with the zone of zoneless values estimated from the data.

Every delivery has an ingestion time, and the same record is often delivered again with a zone. A candidate offset
history is charged for each zoneless value that, read with it, would lie after its own ingestion (too late), before the
delivery before it or after the one behind it (out of sequence), or apart from a neighbouring delivery although both show
the same minutes, seconds and fraction. The history with the fewest violations reads the zoneless values of a source,
unless the declared one is nearly as good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcorpus.functions.timestamps import parse_instants, to_utc
from sparkcorpus.session import cut_lineage, fresh

#: Offset histories that may be chosen; the first is the declared one.
CANDIDATES = ("Europe/Copenhagen", "UTC", "Europe/London", "Europe/Helsinki", "Europe/Moscow", "America/New_York", "+01:00", "+02:00")
#: The declared history stays unless another has fewer violations by so many and by this share of the values that tell the candidates apart.
MARGIN, SHARE = 5, 0.05
_SPAN_US = 15 * 3600 * 1_000_000
_STEP_US = 15 * 60 * 1_000_000


def zone_violations(parsed: DataFrame, wall: str, offset: str, record: list[str], ingested: str, candidates: tuple[str, ...] = CANDIDATES, source: list[str] | None = None) -> DataFrame:
    """``source`` columns, ``telling`` (zoneless values that the candidates are not charged alike for) and ``violations``
    (array, one count a candidate): one row a source, or one row altogether.

    ``parsed`` has the columns of ``parse_instants``. Each value is compared with one neighbour on either side in
    the ingestion order of its record, so the work is linear. Only repeated deliveries that show another clock time
    or another zone are evidence: they are made distinct within a record first, which also bounds a record that
    holds a large part of all rows. Nulls in any column are no evidence.
    """
    w, o, at = fresh("wall"), fresh("offset"), fresh("at")
    of = {fresh("s"): F.col(c) for c in source or []}
    keys = of | {fresh("k"): F.col(k) for k in record}
    rows = parsed.select(*[c.alias(n) for n, c in keys.items()], F.col(wall).alias(w), F.col(offset).alias(o), F.unix_micros(F.col(ingested)).alias(at)).where(F.col(w).isNotNull())
    rows = rows.groupBy(*keys, w, o).agg(F.min(at).alias(at))
    order = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_last(), w, o)
    zoned = F.when(F.col(o).isNotNull(), F.col(w) - F.col(o).cast("long") * 60_000_000)
    before, after, charges = fresh("before"), fresh("after"), fresh("charges")
    rows = rows.withColumns({before: F.lag(zoned).over(order), after: F.lead(zoned).over(order)}).where(F.col(o).isNull())
    near = lambda x: F.abs(F.col(w) - F.col(x)) <= _SPAN_US

    def charged(zone: str) -> Column:
        instant = to_utc(F.col(w), F.lit(None).cast("int"), zone)
        apart = lambda x: near(x) & ((F.col(w) - F.col(x)) % _STEP_US == 0) & (instant != F.col(x))
        tests = (instant > F.col(at), near(before) & (instant < F.col(before)), near(after) & (instant > F.col(after)), apart(before), apart(after))
        return sum(F.when(t, 1).otherwise(0) for t in tests)

    rows = rows.withColumn(charges, F.array(*[charged(z) for z in candidates]))
    counts = F.array(*[F.coalesce(F.sum(F.col(charges)[i]), F.lit(0)) for i in range(len(candidates))])
    telling = F.coalesce(F.sum(F.when(F.array_max(charges) != F.array_min(charges), 1).otherwise(0)), F.lit(0))
    out = rows.groupBy(*of).agg(telling.alias("telling"), counts.alias("violations"))
    return out.withColumnsRenamed(dict(zip(of, source or [])))


def chosen_zone(telling: int, violations: list[int], candidates: tuple[str, ...] = CANDIDATES) -> str:
    """The candidate with the fewest violations if that is fewer than the declared one's by the margin, else the declared one."""
    best = min(range(len(candidates)), key=lambda i: violations[i])
    return candidates[best] if violations[0] - violations[best] >= max(MARGIN, SHARE * telling) else candidates[0]


def estimate_zone(parsed: DataFrame, wall: str, offset: str, record: list[str], ingested: str, candidates: tuple[str, ...] = CANDIDATES) -> tuple[str, dict[str, int]]:
    """The zone of a table's zoneless values, and the violations of each candidate. An empty or wholly zoned table gives
    the declared zone with no violations."""
    row = zone_violations(parsed, wall, offset, record, ingested, candidates).first()
    violations = [int(v) for v in row["violations"]] if row else [0] * len(candidates)
    return chosen_zone(row["telling"] if row else 0, violations, candidates), dict(zip(candidates, violations))


def _chosen_column(candidates: tuple[str, ...]) -> Column:
    """``chosen_zone`` of each row of ``zone_violations``."""
    names, v = F.array(*[F.lit(z) for z in candidates]), F.col("violations")
    enough = v[0] - F.array_min(v) >= F.greatest(F.lit(float(MARGIN)), SHARE * F.col("telling"))
    return F.when(enough, F.element_at(names, F.array_position(v, F.array_min(v)).cast("int"))).otherwise(candidates[0])


def normalise_instants(df: DataFrame, source: str, out: str, record: list[str], ingested: str, zone: str | None = None, candidates: tuple[str, ...] = CANDIDATES, by: list[str] | None = None) -> DataFrame:
    """Add ``out``: microseconds UTC of the delivered timestamp in ``source``, null where it denotes none.

    ``zone`` fixes the zone of zoneless values. Without it the zone is estimated: one for the table, or one for each
    source named by the columns ``by`` (null is a source like any other). The parsed rows are then written once, because
    the estimate and the result both read them; select the columns that are needed first. Repeated rows, ties, empty
    tables, null or blank texts and texts of any length are fine; no row is added or lost, and other columns,
    whatever their names, pass through (``out`` replaces a column of that name).
    """
    wall, offset = fresh("wall"), fresh("offset")
    parsed = parse_instants(df, source, wall, offset)
    if zone is not None:
        return parsed.withColumn(out, to_utc(F.col(wall), F.col(offset), zone)).drop(wall, offset)
    parsed = cut_lineage(parsed, "instants")
    if not by:
        zone, _ = estimate_zone(parsed, wall, offset, record, ingested, candidates)
        return parsed.withColumn(out, to_utc(F.col(wall), F.col(offset), zone)).drop(wall, offset)
    named, chosen = {c: fresh("by") for c in by}, fresh("zone")
    zones = zone_violations(parsed, wall, offset, record, ingested, candidates, by).select(*[F.col(c).alias(n) for c, n in named.items()], _chosen_column(candidates).alias(chosen))
    same = None
    for c, n in named.items():
        same = F.col(c).eqNullSafe(F.col(n)) if same is None else same & F.col(c).eqNullSafe(F.col(n))
    # a source without zoneless values has no row and needs none
    rows = parsed.join(zones, same, "left")
    local = F.lit(None).cast("long")
    for z in candidates:
        local = F.when(F.coalesce(chosen, F.lit(candidates[0])) == z, to_utc(F.col(wall), F.col(offset), z)).otherwise(local)
    return rows.withColumn(out, local).drop(wall, offset, chosen, *named.values())
