"""Dataset assembly: canonical bars, adjustment, gate, resampling, alignment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import bars as B
from ..operators import quality as Q
from ..operators.asof import align
from ..session import cut_lineage
from ..sources.files import slice_frame


@dataclass(frozen=True)
class DatasetRequest:
    interval: str = "1d"
    timeframe: str | None = None
    session: str | None = None
    start: str | None = None
    end: str | None = None
    horizon: int = 5
    source_tz: str = "UTC"
    policy: Q.QualityPolicy = field(default_factory=Q.QualityPolicy)
    order: tuple[str, ...] = ("volume",)


def build_dataset(raw: DataFrame, request: DatasetRequest = DatasetRequest(), *, fundamentals: DataFrame | None = None, macro: DataFrame | None = None,
                  news: DataFrame | None = None, holidays: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(aligned bars, quality report) for all symbols of `raw` at once."""
    daily = request.interval.lower().endswith("d")
    bars = B.adjust(B.canonicalize(raw, source_tz=request.source_tz, intraday=not daily))
    bars = slice_frame(bars, request.start, request.end)
    flags = Q.gate_flags(bars, request.policy, interval=request.interval, order=list(request.order), holidays=holidays)
    clean = Q.gate_rows(flags)
    if request.timeframe and request.timeframe != request.interval:
        clean = B.resample(clean, request.timeframe, session=request.session, tz="America/New_York")
    if any(side is not None for side in (fundamentals, macro, news)):
        clean = cut_lineage(clean)  # an as-of join reads its left side several times
    return align(clean, fundamentals, macro, news), Q.gate_report(flags, request.policy, request.horizon)
