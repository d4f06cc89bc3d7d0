"""Table definitions: dimensions make the key, metrics are merged under it."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import timeops
from .types import NUM_TYPES, NumType, num_type, uint_for

UNLIMITED = 0xFFFFFFFF
#: What a string becomes when its column has no room for new values.
EXCEEDED = "__exceeded"
#: Internal columns of stored rows: how many records a row merges, and when its first one came.
COUNT, SEQ = "__count", "__seq"


def clean_name(name: str) -> str:
    if '"' in name or "\\" in name:
        raise ValueError(f"Illegal character in name: {name}")
    return name


@dataclass(frozen=True)
class Guard:
    """At most ``limit`` distinct values of the guarded dimension for each combination of ``dimensions``."""

    dimensions: tuple[str, ...]
    limit: int


@dataclass(frozen=True)
class Dimension:
    name: str
    field: str
    kind: str  # string, boolean, numeric or time
    num: NumType | None = None
    micro: bool = False
    cardinality: int = UNLIMITED
    length: int = -1
    format: str = ""
    granularity: str | None = None
    rollup: tuple[tuple[str, timeops.Duration], ...] = ()
    guard: Guard | None = None

    @property
    def spark(self) -> str:
        return {"string": "string", "boolean": "boolean", "time": "bigint"}.get(self.kind) or self.num.spark

    @classmethod
    def from_config(cls, cfg: dict) -> Dimension:
        name, kind = clean_name(cfg["name"]), cfg.get("type", "string")
        base = {"name": name, "field": cfg.get("field", name)}
        guard = cfg.get("cardinality_guard")
        guard = Guard(tuple(guard["dimensions"]), int(guard["limit"])) if guard else None
        if kind == "string":
            return cls(**base, kind="string", cardinality=int(cfg.get("cardinality", UNLIMITED)), length=int(cfg.get("length", -1)), guard=guard)
        if kind == "boolean":
            return cls(**base, kind="boolean", guard=guard)
        if kind in ("time", "microtime"):
            rules = tuple((timeops.granularity(r["granularity"]), timeops.Duration.parse(r["after"])) for r in cfg.get("rollup_rules", []))
            to = cfg.get("granularity")
            # A granularity wins over rollup rules.
            return cls(**base, kind="time", micro=kind == "microtime", format=cfg.get("format", ""), granularity=timeops.granularity(to) if to else None, rollup=() if to else rules, guard=guard)
        if guard:
            raise ValueError(f"Cardinality guard is not supported on numeric dimension: {name}")
        return cls(**base, kind="numeric", num=uint_for(int(cfg.get("max", UNLIMITED))) if kind == "numeric" else num_type(kind))


@dataclass(frozen=True)
class Metric:
    name: str
    field: str
    agg: str  # sum, min, max, avg, count or bitset
    num: NumType

    @property
    def state(self) -> str:
        """Spark type of the stored state."""
        if self.agg == "bitset":
            return f"array<{self.num.spark}>"
        return {"count": "bigint", "sum": self.num.wide, "avg": self.num.wide}.get(self.agg) or self.num.spark

    @classmethod
    def from_config(cls, cfg: dict) -> Metric:
        name, kind = clean_name(cfg["name"]), cfg["type"]
        base = {"name": name, "field": cfg.get("field", name)}
        if kind in ("count", "bitset"):
            return cls(**base, agg=kind, num=uint_for(int(cfg.get("max", UNLIMITED))))
        num, _, agg = kind.partition("_")
        if agg not in ("sum", "min", "max", "avg") or num not in NUM_TYPES:
            raise ValueError(f"Unsupported metric type: {kind}")
        return cls(**base, agg=agg, num=NUM_TYPES[num])


@dataclass(frozen=True)
class TableSpec:
    name: str
    dimensions: tuple[Dimension, ...]
    metrics: tuple[Metric, ...]
    #: Key columns and number of hash partitions that stored rows are laid out by.
    partition_by: tuple[str, ...] = ()
    partitions: int = 0
    watch: dict = field(default_factory=dict)
    strict_width: bool = False

    @classmethod
    def from_config(cls, cfg: dict) -> TableSpec:
        dims = tuple(Dimension.from_config(d) for d in cfg.get("dimensions", []))
        metrics = tuple(Metric.from_config(m) for m in cfg.get("metrics", []))
        names = [c.name.lower() for c in (*dims, *metrics)]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"Duplicate column: {sorted(twice)[0]}")
        known = {d.name for d in dims}
        for d in dims:
            if d.guard and not set(d.guard.dimensions) <= known:
                raise ValueError(f"Unknown dimension in cardinality guard of {d.name}")
        part = cfg.get("partitioning", {})
        return cls(clean_name(cfg["name"]), dims, metrics, tuple(part.get("columns", ())), int(part.get("total", 0)), dict(cfg.get("watch", {})), bool(cfg.get("strict_width", False)))

    @property
    def columns(self) -> tuple[Dimension | Metric, ...]:
        return (*self.dimensions, *self.metrics)

    def column(self, name: str) -> Dimension | Metric:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"No such column: {name}")

    @property
    def count_column(self) -> str | None:
        """The column that averages are divided by: the table's own count, or a hidden one."""
        own = [m.name for m in self.metrics if m.agg == "count"]
        return own[0] if own else COUNT if any(m.agg == "avg" for m in self.metrics) else None

    @property
    def hidden_count(self) -> bool:
        return self.count_column == COUNT
