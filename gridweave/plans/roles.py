"""Which columns of a DataFrame play which part."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """``series`` may be several columns. ``stale`` is a boolean column that marks the end of a series' presence."""

    series: str | tuple[str, ...] = "series_id"
    ts: str = "ts"
    value: str = "value"
    start_ts: str | None = None
    stale: str | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.series,) if isinstance(self.series, str) else tuple(self.series)

    def resolve(self, df: DataFrame, numeric: bool = True) -> Roles:
        """Checks names and types. A column named start_ts or stale plays its part unasked."""
        found = {f.name: f.dataType for f in df.schema.fields}
        if not all(c in found for c in (*self.keys, self.ts, self.value)):
            raise ValueError(f"input must project columns named {', '.join(repr(k) for k in self.keys)}, {self.ts!r} and {self.value!r}")
        times = (T.TimestampNTZType, T.TimestampType, T.LongType)
        if not isinstance(found[self.ts], times):
            raise ValueError(f"'{self.ts}' column must be TIMESTAMP")
        if numeric and not isinstance(found[self.value], T.DoubleType):
            raise ValueError(f"'{self.value}' column must be DOUBLE")
        start_ts = self.start_ts or ("start_ts" if "start_ts" in found and "start_ts" not in (*self.keys, self.ts, self.value) else None)
        if start_ts is not None:
            if start_ts not in found:
                raise ValueError(f"input must project a column named {start_ts!r}")
            if type(found[start_ts]) is not type(found[self.ts]):
                raise ValueError(f"'{start_ts}' column must be TIMESTAMP")
        stale = self.stale or ("stale" if isinstance(found.get("stale"), T.BooleanType) else None)
        return replace(self, start_ts=start_ts, stale=stale)


@dataclass(frozen=True)
class Profile:
    """A named layout of sample tables: roles and the default lookback, so that callers need not repeat them."""

    name: str
    roles: Roles = Roles()
    lookback: int = 300_000_000


PROFILES: dict[str, Profile] = {"default": Profile("default"), "samples": Profile("samples", Roles(("metric_name", "series_id")))}


def profile(name: str = "default") -> Profile:
    return PROFILES[name]


def set_profile(p: Profile) -> None:
    PROFILES[p.name] = p
