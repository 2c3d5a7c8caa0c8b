"""Core grain queries: cleaning, hourly and daily resampling."""

from __future__ import annotations

from roomtrace.operators import grain
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, loc, register

_H_DOUBLES = ("light", "temp", "humidity", "pressure", "sound")


@register("hourly_resample",
          S.cte(**S.base("r1"), h=S.hourly("clean")) + " select * from h",
          doubles=_H_DOUBLES, ts=("hour_ts", "local_ts"), dates=("local_date",), ints=("device_id", "hour"))
def q_hourly_resample(spark, sf_dir):
    return grain.hourly_resample(clean(spark, sf_dir))


@register("daily_resample",
          S.cte(**S.base("r1")) + """
select device_id, local_date, quantile_cont(pressure, 0.5) as pressure,
       quantile_cont(temperature_sht, 0.5) as temp, quantile_cont(humidity, 0.5) as humidity,
       quantile_cont(light, 0.5) as light, quantile_cont(sound_level, 0.5) as sound
from loc group by all having quantile_cont(pressure, 0.5) is not null""",
          doubles=("pressure", "temp", "humidity", "light", "sound"), dates=("local_date",), ints=("device_id",))
def q_daily_resample(spark, sf_dir):
    return grain.daily_resample(loc(spark, sf_dir))
