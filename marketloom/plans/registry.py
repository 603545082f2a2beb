"""Named feature plugins and the one-pass feature generator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import technical as T
from ..operators.series import DAILY, Blocked, Layout, blocked, ema_back

Stage = Callable[[Blocked, dict], list[str]]


@dataclass(frozen=True)
class Plugin:
    """`stage` adds columns on a blocked table; `prepare` runs before blocking."""

    name: str
    group: str
    stage: Stage
    back: int
    prepare: Callable[[DataFrame, dict, dict], DataFrame] | None = None
    exponential: bool = False

    def history(self, params: dict) -> int:
        """Rows of context for these parameters; exponential means need more than their span."""
        longest = _longest(params)
        return max(self.back, 2 * longest, ema_back(longest) if self.exponential and longest else 0)


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    params: dict = field(default_factory=dict)


class FeatureRegistry:
    def __init__(self) -> None:
        self._plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin, replace: bool = False) -> None:
        if plugin.name in self._plugins and not replace:
            raise ValueError(f"plugin already registered: {plugin.name}")
        self._plugins[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        self._plugins.pop(name, None)

    def has(self, name: str) -> bool:
        return name in self._plugins

    def get(self, name: str) -> Plugin:
        if name not in self._plugins:
            raise KeyError(f"unknown feature plugin: {name}")
        return self._plugins[name]

    def list(self) -> list[str]:
        return sorted(self._plugins)

    def generate(self, bars: DataFrame, specs: list[FeatureSpec], context: dict | None = None, *, layout: Layout = DAILY,
                 base_columns: bool = True, drop_missing: bool = False) -> tuple[DataFrame, list[dict]]:
        """All requested plugins in one blocked pass, plus the catalog."""
        context = context or {}
        plugins = [(self.get(s.name), s) for s in specs]
        base = list(bars.columns)
        df = bars
        for p, s in plugins:
            if p.prepare:
                df = p.prepare(df, s.params, context)
        widest = max(p.history(s.params) for p, s in plugins)
        b = blocked(df, layout, back=widest).indexed()
        catalog, feats = [], []
        for p, s in plugins:
            names = p.stage(b, s.params)
            catalog.append({"plugin": p.name, "group": p.group, "params": dict(s.params), "features": names})
            feats += [n for n in names if n not in feats]
        keys = [*layout.keys, layout.time]
        out = b.owned().select(*(base if base_columns else keys), *[f for f in feats if f not in base])
        return (out.dropna("any") if drop_missing else out), catalog


def _longest(params: dict) -> int:
    vals = [0]
    for v in params.values():
        for x in v if isinstance(v, (list, tuple)) else [v]:
            if isinstance(x, (int, float)) and not isinstance(x, bool):
                vals.append(int(x))
    return max(vals)


def default_registry() -> FeatureRegistry:
    from ..operators import fundamentals as FU
    from ..operators import macro as M
    from ..operators import regime as R
    from ..operators import sentiment as S

    reg = FeatureRegistry()
    B = T.PLUGIN_BACK
    for name, group, stage in (("returns", "price", T.returns), ("trend", "trend", T.trend), ("trend_ema", "trend", T.trend_ema),
                               ("momentum", "momentum", T.momentum), ("macd", "momentum", T.macd), ("volatility", "volatility", T.volatility),
                               ("structure", "structure", T.structure), ("gaps", "gaps", T.gaps)):
        reg.register(Plugin(name, group, stage, B[name], exponential=name in ("trend_ema", "macd")))
    reg.register(Plugin("volume", "volume", T.volume, B["volume"], lambda df, p, c: T.with_obv(df)))

    def ref(df, p, c):
        if c.get("benchmark") is not None:
            df = T.with_reference_close(df, c["benchmark"], "bench")
        if c.get("sector") is not None:
            keyed = "symbol" in c["sector"].columns
            df = T.with_reference_close(df, c["sector"], "sector", ("symbol",) if keyed else ())
        return df

    reg.register(Plugin("relative_strength", "relative", T.relative_strength, B["relative_strength"], ref))
    reg.register(Plugin("fundamentals", "fundamentals", FU.stage, 0, FU.prepare))
    reg.register(Plugin("earnings_events", "events", FU.stage_earnings, 0, FU.prepare_earnings))
    reg.register(Plugin("macro", "macro", M.stage, 64, M.prepare))
    reg.register(Plugin("regime", "regime", R.stage, 130, R.prepare))
    reg.register(Plugin("sentiment", "sentiment", S.stage, 21, S.prepare))
    return reg
