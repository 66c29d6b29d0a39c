"""SQL of feature families A to C, written from their definitions and apart from the DataFrame code."""

from __future__ import annotations

from quadrille.functions import timeutil
from quadrille.plans.panel_queries import PANEL

_W = "OVER (PARTITION BY region_id ORDER BY ts{0})"
_ROWS = " ROWS BETWEEN {0} PRECEDING AND CURRENT ROW"
_DAYS = ", ".join(f"DATE '{d}'" for y in (2023, 2024) for d in timeutil.holidays(y))


def _over(expr: str, back: int | None = None) -> str:
    return f"{expr} {_W.format(_ROWS.format(back) if back is not None else '')}"


def _real(expr: str, name: str) -> str:
    return f"round({expr}, 5) + 0.0 AS {name}"


def _columns() -> list[str]:
    out = []
    for t in ("pickups", "dropoffs"):
        out += [f"{t} AS {t}_lag_0", *(f"{_over(f'lag({t}, {k})')} AS {t}_lag_{k}" for k in (1, 2, 4, 8, 12, 24, 96, 192, 672))]
        out += [f"{_over(f'lag({t}, {s - h})')} AS {t}_seasonal_{n}_h{h}" for n, s in (("yesterday", 96), ("last_week", 672)) for h in (1, 2, 3, 4)]
        out.append(_real(f"CASE WHEN count(*) OVER same >= 3 THEN avg({t}) OVER same END", f"{t}_slot_expanding_mean"))
        for n in (4, 12, 24, 96, 672):
            out += [_real(_over(f"avg({t})", n - 1), f"{t}_roll_mean_{n}"), _real(_over(f"stddev_samp({t})", n - 1), f"{t}_roll_std_{n}"), f"CAST({_over(f'sum({t})', n - 1)} AS BIGINT) AS {t}_roll_sum_{n}"]
        out += [f"{t} - {_over(f'lag({t}, {s})')} AS {t}_delta_{s}" for s in (1, 2, 4)]
        before = f"avg({t}) {_W.format(' ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING')}"
        out.append(_real(f"{_over(f'avg({t})', 3)} - {before}", f"{t}_hour_over_hour"))
    out += ["hour(lt) AS hour", "minute(lt) AS minute", "isodow(lt) AS day_of_week", "day(lt) AS day_of_month", "weekofyear(lt) AS week_of_year", "month(lt) AS month_of_year", "isodow(lt) > 5 AS is_weekend",
            f"CAST(lt AS DATE) IN ({_DAYS}) AS is_holiday", f"isodow(lt) < 6 AND CAST(lt AS DATE) NOT IN ({_DAYS}) AS is_business_day", "hour(lt) IN (7, 8, 9) AS is_morning_rush", "hour(lt) IN (16, 17, 18) AS is_evening_rush"]
    turns = {"tod": "(hour(lt) * 60 + minute(lt)) / 1440", "dow": "isodow(lt) / 7", "doy": "dayofyear(lt) / 365.25"}
    out += [_real(f"{f}(2 * pi() * {t})", f"{n}_{f}") for n, t in turns.items() for f in ("sin", "cos")]
    for h in (1, 2, 3, 4):
        at = f"(lt + {15 * h} * INTERVAL 1 MINUTE)"
        clock = f"(hour{at} * 60 + minute{at})"
        out += [_real(f"{f}(pi() * {clock} / 720)", f"target_tod_{f}_h{h}") for f in ("sin", "cos")]
        out += [f"isodow{at} AS target_weekday_h{h}", f"hour{at} AS target_hour_h{h}", f"hour{at} IN (7, 8, 9, 16, 17, 18) AS target_is_rush_h{h}"]
    out += [f"CAST({_over('sum(dropoffs - pickups)', n - 1)} AS BIGINT) AS net_flow_roll_sum_{n}" for n in (4, 24)]
    out += ["dropoffs - pickups AS net_flow_lag_0", f"{_over('lag(dropoffs - pickups, 1)')} AS net_flow_lag_1", _real(f"({_over('sum(dropoffs)', 3)} + 1) / ({_over('sum(pickups)', 3)} + 1)", "dropoff_pickup_ratio_1h")]
    return out


def _means(span: int) -> str:
    """Adjusted exponential means by their defining sums, as far back as the panel reaches."""
    keep = f"({span - 1}::DOUBLE / {span + 1})"
    return f"e{span} AS (SELECT a.region_id, a.ts, " + ", ".join(f"round(sum(b.{t} * pow{keep[:-1]}, a.i - b.i)) / sum(pow{keep[:-1]}, a.i - b.i)), 5) + 0.0 AS {t}_ewm_{span}" for t in ("pickups", "dropoffs")) + " FROM n a JOIN n b ON a.region_id = b.region_id AND b.i <= a.i GROUP BY 1, 2)"


FEATURES_SQL = f"""WITH {PANEL}, n AS (SELECT region_id, ts, pickups, dropoffs, ts - INTERVAL 5 HOUR AS lt, row_number() OVER (PARTITION BY region_id ORDER BY ts) AS i FROM panel),
f AS (SELECT region_id, ts, {', '.join(_columns())} FROM n WINDOW same AS (PARTITION BY region_id, isodow(lt), hour(lt), minute(lt) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{_means(4)}, {_means(12)}, {_means(96)} SELECT * FROM f JOIN e4 USING (region_id, ts) JOIN e12 USING (region_id, ts) JOIN e96 USING (region_id, ts)"""
