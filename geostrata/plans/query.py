"""The query: what is measured, over which objects, by which levels, in which order, how often."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from geostrata.functions.spatial import Rect
from geostrata.schema import NONE, levels_of


@dataclass(frozen=True)
class WarehouseQuery:
    """`interval` (minutes) restricts to the latest objects; `sync_seconds` makes the query continuous."""

    measure: str = "count"
    k: int = 10
    group: str = NONE
    range: Rect | None = None
    keywords: tuple[str, ...] = ()
    after: date | None = None
    interval: int = 0
    topic: str | None = None
    order: str | None = None
    order_column: str | None = None
    sync_seconds: int | None = None
    query_id: int = 0
    closed: bool = False

    def __post_init__(self) -> None:
        if self.measure not in ("count", "topk"):
            raise ValueError(f"no such measure: {self.measure!r}")
        if self.order not in (None, "asc", "desc"):
            raise ValueError(f"no such order: {self.order!r}")
        levels_of(self.group)

    @property
    def levels(self) -> tuple[str, ...]:
        return levels_of(self.group)

    @property
    def continuous(self) -> bool:
        return self.sync_seconds is not None

    @property
    def spatial_only(self) -> bool:
        """Whether no predicate but the rectangle applies, so that aggregates by cell can answer."""
        return not (self.keywords or self.after or self.interval or self.topic)

    def describe(self) -> str:
        r = self.range
        parts = {
            "query": self.query_id,
            "type": f"continuous, every {self.sync_seconds} s" if self.continuous else "snapshot",
            "measure": f"topk({self.k})" if self.measure == "topk" else "count()",
            "group by": self.group,
            "range": f"{r.lat_from} {r.lon_from} {r.lat_to} {r.lon_to}" if r else "",
            "keywords": " and ".join(self.keywords),
            "after": self.after or (f"the last {self.interval} minutes" if self.interval else ""),
            "topic": self.topic or "",
            "order": self.order or "",
        }
        return "\n".join(f"{k}: {v}" for k, v in parts.items() if v != "")
