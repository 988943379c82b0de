"""Values of the domain: enumerations, market shapes, and settings with their defaults."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

# The order of books decides ties.
BOOKS = ("tipsport", "fortuna", "betano", "chance", "sazka", "merkurxtip", "kingsbet", "betx", "synot")
SPORTS = ("football", "tennis", "basketball", "hockey", "handball", "volleyball", "baseball", "american_football", "mma", "boxing", "darts", "snooker", "table_tennis")
INDIVIDUAL_SPORTS = ("tennis", "mma", "boxing", "darts", "snooker", "table_tennis")
DRAW_SPORTS = ("football", "hockey", "basketball", "handball", "american_football", "mma", "boxing")
OVERTIME_SPORTS = ("hockey", "basketball", "handball")
MODES = ("PREMATCH", "PAUSED", "LIVE")
SCOPES = ("REG", "MATCH", "H1", "H2", "P1", "P2", "P3", "Q1", "Q2", "Q3", "Q4", "S1", "S2", "S3", "S4", "S5")
SELECTIONS = ("HOME", "DRAW", "AWAY", "OVER", "UNDER", "YES", "NO", "ODD", "EVEN", "HOME_DRAW", "HOME_AWAY", "DRAW_AWAY")
CENSORING = ("system_restart", "stale", "threshold_changed", "unlinked", "event_started", "pause_started", "pause_ended", "event_finished")

# The outcomes that together cover a market of each type.
OUTCOMES = {
    "1X2": ("HOME", "DRAW", "AWAY"),
    "ML": ("HOME", "AWAY"),
    "DNB": ("HOME", "AWAY"),
    "DC": ("HOME_DRAW", "HOME_AWAY", "DRAW_AWAY"),
    "OU": ("OVER", "UNDER"),
    "AH": ("HOME", "AWAY"),
    "BTTS": ("YES", "NO"),
    "OE": ("ODD", "EVEN"),
    "OU_HOME": ("OVER", "UNDER"),
    "OU_AWAY": ("OVER", "UNDER"),
    "OU_SETS": ("OVER", "UNDER"),
    "AH_SETS": ("HOME", "AWAY"),
    "H_DA": ("HOME", "DRAW_AWAY"),
    "A_HD": ("AWAY", "HOME_DRAW"),
    "D_HA": ("DRAW", "HOME_AWAY"),
}
LINE_TYPES = ("OU", "AH", "OU_HOME", "OU_AWAY", "OU_SETS", "AH_SETS")
SYNTHETIC_TYPES = ("H_DA", "A_HD", "D_HA")
OVERLAPPING_TYPES = ("DC",)
HISTOGRAM_EDGES_SEC = (0, 1, 2, 5, 10, 20, 30, 60, 120, 300, 600, 1800)

# Seconds a break is expected to last, and for how long a clock must stand before it counts as one.
BREAK_SECONDS = {
    "football_ht": 900,
    "basketball_ht": 900,
    "basketball_quarter": 120,
    "hockey_intermission": 1020,
    "tennis_set_break": 120,
    "handball_ht": 600,
    "volleyball_set_break": 180,
    "american_football_ht": 780,
    "american_football_quarter": 120,
    "other_break": 120,
}
STANDSTILL_SECONDS = {
    "football": 45,
    "tennis": 30,
    "basketball": 45,
    "hockey": 45,
    "handball": 45,
    "volleyball": 30,
    "baseball": 60,
    "american_football": 60,
    "mma": 60,
    "boxing": 60,
    "darts": 60,
    "snooker": 60,
    "table_tennis": 30,
}


@dataclass(frozen=True)
class ModeSettings:
    min_margin: float
    max_leg_age_ms: int
    confirm_ms: int


@dataclass(frozen=True)
class Settings:
    """What a user may change. ``merged`` lays a partial patch over the values; a bad patch leaves them as they are."""

    modes: dict[str, ModeSettings] = field(default_factory=lambda: {
        "PREMATCH": ModeSettings(0.5, 300_000, 0),
        "PAUSED": ModeSettings(1.0, 15_000, 1_000),
        "LIVE": ModeSettings(1.5, 5_000, 1_500),
    })
    bankroll: float = 10_000.0
    unit: float = 1.0
    consensus_books: int = 3
    consensus_deviation: float = 0.35
    fee: dict[str, float] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()
    auto_accept: float = 0.86
    review: float = 0.6
    match_minutes: int = 15
    leg_age_share: float = 0.8
    max_dropped_share: float = 0.2
    min_events: int = 1

    def merged(self, patch: dict) -> Settings:
        try:
            values = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
            for name, value in patch.items():
                if name == "modes":
                    values["modes"] = self.modes | {m: dataclasses.replace(self.modes[m], **own) for m, own in value.items()}
                elif name not in values or not isinstance(value, type(values[name]) if not isinstance(values[name], float) else (int, float)):
                    return self
                else:
                    values[name] = value
            out = Settings(**values)
            sane = out.bankroll > 0 and out.unit > 0 and 0 <= out.review <= out.auto_accept <= 1 and all(m.max_leg_age_ms > 0 and m.confirm_ms >= 0 for m in out.modes.values())
            return out if sane else self
        except (KeyError, TypeError, AttributeError):
            return self
