"""Keyed record streams: latest-per-key, compaction, recent lists, roll-ups.

Latest-per-key is an aggregation (``max_by`` over a (ts, seq) struct), so it
gets partial aggregation before the shuffle and a hot key costs one row per
task, not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx


def latest_per_key(df: DataFrame, keys: list[str], ts: str = "ts", seq: str = "seq",
                   cols: list[str] | None = None) -> DataFrame:
    """One row per key: the columns of the row with the greatest (ts, seq)."""
    cols = cols or [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), F.col(seq))
    rec = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.max_by(rec, order).alias("_r")).select(*keys, "_r.*")


def with_default(keys: DataFrame, latest: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Point lookup with a default: left join and ``coalesce``."""
    d = keys.join(latest, on, "left")
    for c, v in defaults.items():
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return d


def compact_states(msgs: DataFrame, key: str, is_state: Column, ts: str, seq: str) -> DataFrame:
    """All non-state messages, plus only the last state message per key."""
    rest = msgs.where(~is_state)
    states = msgs.where(is_state)
    last = latest_per_key(states, [key], ts, seq, [c for c in msgs.columns if c != key])
    return rest.unionByName(last.select(*msgs.columns))


def coalesce_latest(reqs: DataFrame, key: str, ts: str, seq: str, every: str = "1 hour") -> DataFrame:
    """Per key and per batch interval keep only the newest request."""
    w = F.window(F.col(ts).cast("timestamp"), every)
    cols = [c for c in reqs.columns if c != key]
    return (
        reqs.groupBy(key, w.alias("batch"))
        .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(seq))).alias("_r"))
        .select(key, F.col("batch.start").cast("timestamp_ntz").alias("batch_start"), "_r.*")
    )


# --- fixed values: event-time blocks for per-key look-backs --------------------------
EVENT_BLOCK_MICROS = 3_600_000_000  # one hour


def previous_item(df: DataFrame, key: str, item: str, ts: str, seq: str, out: str = "_prev") -> DataFrame:
    """``out`` = ``item`` of the previous event of the same key in (ts, seq)
    order.  A blocked look-back over hourly event-time blocks, so one very
    active key is spread over its hours instead of one task."""
    from linden.operators.sequence import carry_last

    block = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(EVENT_BLOCK_MICROS))
    return carry_last(df, F.col(item), out, key=key, order=[ts, seq], block_col=block)


def recent_n(df: DataFrame, key: str, item: str, ts: str, seq: str, n: int = 10) -> DataFrame:
    """Newest-first list of the last ``n`` pushes per key, where a push equal
    to the previous one is ignored.  (rank 1 = newest).  The top-n filter is
    planned as a partial group limit before the shuffle."""
    d = previous_item(df, key, item, ts, seq).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col(item)))
    wr = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(seq).desc())
    return d.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= n).drop("_prev")


def type_counts(df: DataFrame, type_col: str, types=lx.LINT_TYPES) -> DataFrame:
    """(type, n) for each fixed type, zero when absent; other types ignored.
    The fixed types are a literal filter pushed into the scan; the zero rows
    come from a literal VALUES table joined to the (at most 5-row) counts."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate(types)], "type string, ord int")
    counts = df.where(F.col(type_col).isin(*types)).groupBy(F.col(type_col).alias("type")).agg(
        F.count(F.lit(1)).alias("n"))
    return fixed.join(counts, "type", "left").select(
        "type", F.coalesce("n", F.lit(0)).alias("n"), "ord")


def merge_maps(primary: Column, secondary: Column) -> Column:
    """Merge two string maps; a key present in ``secondary`` wins."""
    return F.map_zip_with(primary, secondary, lambda k, v1, v2: F.coalesce(v2, v1))


def _settings(config: Column) -> Column:
    """Sections of a JSON object as a map of variants; anything else has none."""
    v = F.try_parse_json(config)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string, variant>")).otherwise(F.create_map().cast("map<string, variant>"))


def _is_section(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _object(texts: Column) -> Column:
    """JSON object of a map from key to JSON text."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(texts), lambda e: F.concat(quoted(e.key), F.lit(":"), e.value)), ","), F.lit("}"))


def merge_configs(primary: Column, secondary: Column) -> Column:
    """``secondary`` merged into ``primary``, both JSON texts, as JSON text with
    keys in order.  Sections that are objects on both sides are merged key by
    key, the secondary's values winning; below that, and where either side of
    a section is not an object, the secondary's value replaces the other.  A
    JSON null is a value; a text that is null, broken or no object is empty."""
    def section(k: Column, p: Column, s: Column) -> Column:
        both = F.map_zip_with(p.cast("map<string, variant>"), s.cast("map<string, variant>"), lambda n, a, b: F.coalesce(F.to_json(b), F.to_json(a)))
        return F.when(s.isNull(), F.to_json(p)).when(_is_section(p) & _is_section(s), _object(both)).otherwise(F.to_json(s))

    return F.to_json(F.parse_json(_object(F.map_zip_with(_settings(primary), _settings(secondary), section))))


def setting_rows(config: Column) -> Column:
    """Array of (section, name, value): the settings of a JSON object in the
    order of their keys, values as JSON text.  A section that is no object has
    a null name; an empty one a null name and value."""
    def rows(section: Column, v: Column) -> Column:
        row = lambda name, value: F.struct(section.alias("section"), name.alias("name"), value.alias("value"))
        none = F.lit(None).cast("string")
        inner = F.transform(F.map_entries(v.cast("map<string, variant>")), lambda e: row(e.key, F.to_json(e.value)))
        return F.when(~_is_section(v), F.array(row(none, F.to_json(v)))).when(F.size(inner) == 0, F.array(row(none, none))).otherwise(inner)

    return F.flatten(F.transform(F.map_entries(_settings(config)), lambda e: rows(e.key, e.value)))
