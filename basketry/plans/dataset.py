"""The whole feature set of a fold as one lazy plan.

All item-level features share one aggregate per (client, item) and one pivot per client; with a ledger bucketed by
client neither needs a shuffle.  Attributes and group statistics join afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import PSEUDO_ZERO, Decay, ItemSet, LedgerSpec, trailing
from basketry.functions.decay import decay_weight
from basketry.functions.moments import exact_sum
from basketry.operators import behavior as beh
from basketry.operators.filters import sample_rows
from basketry.operators.groupstats import (
    each_attribute_stats,
    group_stats,
    join_each_attribute,
    join_group_stats,
)
from basketry.operators.labels import eligible_clients, label_rows, multiclass_labels
from basketry.operators.neighbors import neighbor_blend
from basketry.operators.decayed import decayed_features, decayed_purchases, variant_stats
from basketry.operators.panel import pivot_items
from basketry.operators.raw import client_attributes, flat_vector
from basketry.plans.blocks import BlockStore, kept


@dataclass(frozen=True)
class PurchaseVector:
    """Decayed purchase vector; ``neighbors`` adds the collaborative part."""

    decay: Decay = Decay()
    items: ItemSet = "leg"
    neighbors: dict | None = None


@dataclass(frozen=True)
class FeatureVector:
    """Decayed vector of a value column."""

    value: str
    decay: Decay = Decay()
    imputed: float = 0.0
    items: ItemSet = "leg"
    neighbors: dict | None = None


@dataclass(frozen=True)
class GroupStat:
    """Group statistics; ``keys='each'`` takes every attribute in turn."""

    keys: tuple[str, ...] | str
    features: tuple[str, ...]
    window: tuple[int, int] = (6, 0)
    items: ItemSet = "leg"
    stats: tuple[str, ...] = ("nanmean", "nanmedian", "nanstd")


@dataclass(frozen=True)
class DatasetConfig:
    t_end: int
    production: bool = True
    labels: bool = True
    raw: dict[str, tuple[tuple[int, int], ItemSet]] = field(default_factory=dict)
    purchases: dict[str, PurchaseVector] = field(default_factory=dict)
    features: dict[str, FeatureVector] = field(default_factory=dict)
    variant_stats: dict[str, tuple[str, ...]] = field(default_factory=dict)
    behavior: dict[str, ItemSet] = field(default_factory=dict)
    group_stats: tuple[GroupStat, ...] = ()
    attributes: tuple[str, ...] = ()
    drop_cold_start: bool = False
    tolerance: int = 6
    sample: tuple[float, int] | None = None


def item_features(ledger: DataFrame, spec: LedgerSpec, cfg: DatasetConfig) -> tuple[DataFrame, dict[str, Column]] | None:
    """All per-item features of a client in one wide row, and what a client without any row gets; None if none is
    configured.
    """
    t = cfg.t_end
    dt = F.col("dt")
    plain = {n: p for n, p in cfg.purchases.items() if p.neighbors is None}
    valued = {n: p for n, p in cfg.features.items() if p.neighbors is None}
    aggregates = beh.history_columns(t)
    columns: dict[str, tuple[Column, Column, ItemSet]] = {}
    for name, p in plain.items():
        aggregates.append(F.sum(decay_weight(dt, p.decay, t)).alias(f"_{name}"))
        columns[name] = (F.coalesce(F.col(f"_{name}"), F.lit(0.0)), F.lit(0.0), p.items)
    for name, p in valued.items():
        v = F.col(p.value).cast("double")
        base = F.lit(p.imputed * sum(p.decay.weights(t)))
        aggregates.append(F.sum(F.when(v != 0, decay_weight(dt, p.decay, t) * (v - p.imputed))).alias(f"_{name}"))
        columns[name] = (base + F.coalesce(F.col(f"_{name}"), F.lit(0.0)), base, p.items)
    known = beh.feature_columns(t)
    for name, which in cfg.behavior.items():
        if name == "n_shop_tags":
            continue
        for part in beh.TOGGLES if name == "st_tgl" else (name,):
            columns[part] = (*known[part], which)
    if not columns:
        return None
    used = sorted({tag for _, _, which in columns.values() for tag in spec.item_set(which)})
    rows = ledger.filter((dt <= t) & F.col("tag").isin(*used))
    per_item = rows.groupBy("chid", "tag").agg(*aggregates)
    per_item = per_item.select("chid", "tag", *[c.alias(n) for n, (c, _, _) in columns.items()])
    wide = pivot_items(per_item, spec, list(columns), used)
    fills = {f"{n}_tag{tag}": fill for n, (_, fill, which) in columns.items() for tag in spec.item_set(which)}
    return wide, fills


def _mean_over_rows(stats: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> Column:
    """Mean of joined group statistics over the rows, as one struct: from the group sizes, not from the joined rows.

    Added up as decimals, so the result does not depend on the order.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    known = stats.join(sizes, list(keys))
    means = [
        F.try_divide(exact_sum(F.col(v) * F.col("_n")), F.sum(F.when(F.col(v).isNotNull(), F.col("_n")))).alias(v)
        for v in values
    ]
    return known.agg(F.struct(*means).alias("m")).scalar()


def add_group_stats(
    out: DataFrame,
    ledger: DataFrame,
    profile: DataFrame,
    attrs: DataFrame,
    spec: LedgerSpec,
    g: GroupStat,
    t: int,
    prefix: str,
    blocks: BlockStore | None = None,
) -> DataFrame:
    """Joins the statistics of one configuration; a client without a group takes the mean over all clients."""
    first, last = trailing(t, *g.window)
    keys = list(spec.attributes) if g.keys == "each" else list(g.keys)

    def rows() -> DataFrame:
        codes = profile.filter(F.col("dt").between(first, last)).select("chid", "dt", *keys)
        window = ledger.filter(F.col("dt").between(first, last) & F.col("tag").isin(*spec.item_set(g.items)))
        return window.join(codes, ["chid", "dt"])

    if g.keys != "each":
        stats = kept(blocks, "stats", (spec, t, g), lambda: group_stats(rows(), keys, g.features, g.stats), None)
        values = [c for c in stats.columns if c not in keys]
        means = _mean_over_rows(stats, attrs, keys, values)
        out = join_group_stats(out, stats, keys)
        return out.withColumns({f"{prefix}_{v}": F.coalesce(v, means.getField(v)) for v in values}).drop(*values)
    stats = kept(blocks, "stats", (spec, t, g), lambda: each_attribute_stats(rows(), keys, g.features, g.stats), None)
    values = [c for c in stats.columns if c not in ("attr", "code")]
    out = join_each_attribute(out, stats, keys)
    filled = {}
    for a in keys:
        part = stats.filter(F.col("attr") == a).withColumn(a, F.col("code"))
        means = _mean_over_rows(part, attrs.select(F.col(a).cast("string").alias(a)), [a], values)
        filled.update({f"{prefix}_{a}_{v}": F.coalesce(f"{a}_{v}", means.getField(v)) for v in values})
    return out.withColumns(filled).drop(*[f"{a}_{v}" for a in keys for v in values])


def _families(cfg: DatasetConfig) -> list[DatasetConfig]:
    """The per-item features of a configuration, one kind at a time: what datasets have in common is one block."""
    none = {"purchases": {}, "features": {}, "behavior": {}}
    own = {
        "purchases": {n: p for n, p in cfg.purchases.items() if p.neighbors is None},
        "features": {n: p for n, p in cfg.features.items() if p.neighbors is None},
        "behavior": {n: w for n, w in cfg.behavior.items() if n != "n_shop_tags"},
    }
    return [DatasetConfig(cfg.t_end, **{**none, kind: entries}) for kind, entries in own.items() if entries]


def build_features(
    ledger: DataFrame,
    profile: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    cfg: DatasetConfig,
    blocks: BlockStore | None = None,
) -> DataFrame:
    """One row per client of the spine with every configured feature.

    With ``blocks`` every kind of feature is a block, written by the first dataset that names it.
    """
    t = cfg.t_end
    out = clients if cfg.production else ledger.filter(F.col("dt") == t).select("chid").distinct()
    spine = out

    def keep(kind: str, params: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        return kept(blocks, kind, (spec, t, *params), build)

    for part in [cfg] if blocks is None else _families(cfg):
        if found := item_features(ledger, spec, part):
            wide, fills = found
            if blocks is not None:
                wide = keep("items", (part.purchases, part.features, part.behavior), lambda wide=wide: wide)
            joined = out.join(wide, "chid", "left")
            here = [c for c in out.columns if c != "chid"]
            out = joined.select("chid", *here, *[F.coalesce(F.col(n), f).alias(n) for n, f in fills.items()])
    for value, (window, which) in cfg.raw.items():
        vector = partial(flat_vector, ledger, clients if blocks else spine, spec, value, t, window, which)
        out = out.join(keep("raw", (value, window, which), vector), "chid", "left")
    for name, p in cfg.purchases.items():
        if p.neighbors is not None:

            def near(name=name, p=p) -> DataFrame:
                own = decayed_purchases(ledger, clients, spec, t, {name: p.decay}, "all")
                return pivot_items(neighbor_blend(own, clients, spec, name, **p.neighbors), spec, [name], p.items)

            out = out.join(keep("near", (name, p), near), "chid", "left")
    for name, p in cfg.features.items():
        if p.neighbors is not None:

            def near_values(name=name, p=p) -> DataFrame:
                own = decayed_features(ledger, clients, spec, t, {name: (p.value, p.decay, p.imputed)}, "all")
                blended = neighbor_blend(own, clients, spec, name, normalize=True, **p.neighbors)
                return pivot_items(blended, spec, [name], p.items)

            out = out.join(keep("near", (name, p), near_values), "chid", "left")
    for names, stats in ((k.split("+"), s) for k, s in cfg.variant_stats.items()):
        for tag in spec.legit:
            out = variant_stats(out, [f"{n}_tag{tag}" for n in names], stats)
    if "n_shop_tags" in cfg.behavior:
        which = cfg.behavior["n_shop_tags"]
        counts = keep("counts", (which,), partial(beh.items_per_period, ledger, clients, spec, t, which))
        out = out.join(counts, "chid", "left")
    keys = {k for g in cfg.group_stats for k in (spec.attributes if g.keys == "each" else g.keys)}
    wanted = list(dict.fromkeys([*cfg.attributes, *sorted(keys)]))
    if wanted:
        every = clients if cfg.production else None
        # a block holds every attribute, so that all datasets share it
        named = wanted if blocks is None else list(dict.fromkeys([*spec.attributes, *wanted]))
        attrs = keep("attributes", (named, cfg.production), partial(client_attributes, profile, named, t, every))
        attrs = attrs.select("chid", *wanted)
        out = out.join(attrs, "chid", "left")
        for i, g in enumerate(cfg.group_stats):
            out = add_group_stats(out, ledger, profile, attrs, spec, g, t, f"g{i}", blocks)
    return out.drop(*[k for k in wanted if k not in cfg.attributes])


def build_dataset(
    ledger: DataFrame,
    profile: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    cfg: DatasetConfig,
    blocked: DataFrame | None = None,
    blocks: BlockStore | None = None,
) -> DataFrame:
    """Features, and with ``labels`` one row per bought item of the target period (column ``label``)."""
    out = build_features(ledger, profile, clients, spec, cfg, blocks)
    if cfg.labels:
        eligible = None
        if cfg.drop_cold_start or blocked is not None:
            eligible = eligible_clients(ledger, spec, cfg.t_end, cfg.drop_cold_start, cfg.tolerance, blocked)
        out = multiclass_labels(out, label_rows(ledger, spec, cfg.t_end, eligible))
    return out if cfg.sample is None else sample_rows(out, *cfg.sample)


def model_config(t_end: int, **changes) -> DatasetConfig:
    """The feature set of the shipped models: decayed counts, amounts and purchases, gaps, toggles, made ratio."""
    base = {
        "purchases": {"freq": PurchaseVector()},
        "features": {"cnt": FeatureVector("txn_cnt"), "amt": FeatureVector("amt", imputed=PSEUDO_ZERO)},
        "behavior": {"gap_since_last": "leg", "st_tgl": "leg", "made_ratio": "leg"},
    }
    base.update(changes)
    return DatasetConfig(t_end=t_end, **base)
