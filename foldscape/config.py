"""Configuration of an expansion: one frozen record, resolved by pure functions."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

Ranges = tuple[tuple[int, int], ...]


def as_ranges(value) -> Ranges:
    """Inclusive 1-based row ranges from [a, b], [a, b, c, d, …] or pairs; empty stays empty."""
    flat = [x for v in (value or ()) for x in (v if isinstance(v, list | tuple) else (v,))]
    if len(flat) % 2:
        raise ValueError("row ranges need a start and a stop each")
    pairs = tuple((int(a), int(b)) for a, b in zip(flat[::2], flat[1::2], strict=True))
    if any(a < 1 or b < a for a, b in pairs):
        raise ValueError(f"row ranges must be 1-based and ascending: {pairs}")
    return pairs


def default_split(n: int) -> tuple[Ranges, Ranges]:
    """The first half of the rows as library, the rest to predict."""
    return ((1, n // 2),), ((n // 2 + 1, n),)


@dataclass(frozen=True)
class ExpandConfig:
    """Parameters of expand, driver_graph and their parts.

    Resources (cores, pools, chunking, shared memory, tree workers) have no field:
    they are Spark's own settings.
    """

    # data
    path: str | None = None
    slope_path: str | None = None
    member: str | None = None
    remove_first: bool = False
    time_col: str | None = None
    match: tuple[str, ...] = ()
    leading_names: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    # forecast
    target: str | None = None
    max_dim: int = 3
    lib: Ranges = ()
    pred: Ranges = ()
    tp: int = 1
    tau: int = -1
    exclusion_radius: int = 0
    lib_tail: str = "keep"
    rho_min: float = 0.5
    stop_on_decline: bool = False
    # causal gate
    gate: bool = True
    e: int = 0
    max_e: int = 15
    first_peak: bool = False
    embed_rho_min: float = 0.5
    sample: int = 20
    lib_sizes: tuple[int, ...] = ()
    lib_percents: tuple[float, ...] = (10, 15, 85, 90)
    slope_min: float = 0.01
    seed: int = 0
    slope_orientation: str = "candidate_row"
    # afterwards
    time_delay: int = 0
    # output
    out_dir: str = "."
    out_csv: str | None = None
    out_tables: str | None = None
    log_file: str | None = None
    keep_ranked: int | None = None
    keep_passing: int | None = None
    console: bool = True
    verbose: bool = False
    debug: bool = False
    log_percent: float = 0
    plot: bool = False

    def __post_init__(self):
        for name in ("match", "leading_names", "exclude", "lib_sizes", "lib_percents"):
            value = getattr(self, name)
            if isinstance(value, str) or not isinstance(value, list | tuple):
                raise ValueError(f"{name} takes a list")
            object.__setattr__(self, name, tuple(value))
        object.__setattr__(self, "lib", as_ranges(self.lib))
        object.__setattr__(self, "pred", as_ranges(self.pred))
        if self.max_dim < 1 or self.max_e < 1 or self.e < 0 or self.sample < 1 or self.exclusion_radius < 0 or self.time_delay < 0:
            raise ValueError("max_dim, max_e and sample are 1 at least; e, exclusion_radius and time_delay 0 at least")
        if not self.tau:
            raise ValueError("tau can't be 0")
        if self.lib_tail not in ("keep", "trim") or self.slope_orientation not in ("candidate_row", "candidate_column"):
            raise ValueError("lib_tail is keep or trim; slope_orientation is candidate_row or candidate_column")

    def needs_target(self) -> ExpandConfig:
        if not self.target:
            raise ValueError("a target is required")
        return self

    def split(self, n: int) -> ExpandConfig:
        """Row ranges filled in for n rows."""
        lib, pred = default_split(n)
        return replace(self, lib=self.lib or lib, pred=self.pred or pred)

    def sizes(self, n: int) -> tuple[int, ...]:
        """Library sizes of the causal gate for n rows: as given, or from percentages."""
        found = self.lib_sizes or tuple(int(n * p / 100) for p in self.lib_percents)
        if len(found) < 3:
            raise ValueError("the gate needs three library sizes at least")
        if min(found) < 5 or max(found) > n:
            raise ValueError(f"library sizes must lie between 5 and the {n} rows: {found}")
        return tuple(found)


def resolve(config: ExpandConfig | None = None, args: dict | None = None, **overrides) -> ExpandConfig:
    """Command-line values win over a given config with overrides, which wins over overrides on defaults."""
    known = {f.name for f in fields(ExpandConfig)}
    unknown = set(overrides) - known
    if unknown:
        raise TypeError(f"no such parameters: {sorted(unknown)}")
    if args is not None:
        return ExpandConfig(**{k: v for k, v in args.items() if k in known and v is not None})
    return replace(config, **overrides) if config is not None else ExpandConfig(**overrides)
