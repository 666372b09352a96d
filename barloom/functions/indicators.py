"""Indicators by name, as requests for plans.indicate().

Natives are Spark windows; what recurs is a fold over a series. Inputs are column names or Columns. In natives null rows
are skipped by averages; a null input elsewhere gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.planner import Fold, Native, number
from . import kernels as K

In = str | Column


def _one(c) -> Native:
    """A native of one level."""
    return Native(lambda s, t: [{"": c(s)}])


def _quotient(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (or either is null)."""
    return F.when(b != 0, a / b)


# overlap studies


def SMA(real: In, timeperiod: int = 30) -> Native:
    x = number(real)
    return _one(lambda s: s.skipping(x, timeperiod, F.avg))


def EMA(real: In, timeperiod: int = 30) -> Fold:
    return Fold([number(real)], lambda x: K.ema(x, timeperiod))


def WMA(real: In, timeperiod: int = 30) -> Native:
    x, p = number(real), timeperiod

    def stages(s, t):
        place = F.row_number().over(s.window(x.isNull())).cast("double")
        k = F.col(t("k"))
        weighted = lambda v: F.lit(None).cast("double")
        if p >= 1:
            w = s.last(p, x.isNull())
            weighted = lambda v: F.when(v.isNotNull() & (F.count(v).over(w) >= p), (F.sum(k * v).over(w) - (k - p) * F.sum(v).over(w)) / (p * (p + 1) / 2))
        return [{"k": place}, {"": weighted(x)}]

    return Native(stages)


def DEMA(real: In, timeperiod: int = 30) -> Fold:
    return Fold([number(real)], lambda x: K.dema(x, timeperiod))


def TEMA(real: In, timeperiod: int = 30) -> Fold:
    return Fold([number(real)], lambda x: K.tema(x, timeperiod))


def T3(real: In, timeperiod: int = 5, vfactor: float = 0.7) -> Fold:
    return Fold([number(real)], lambda x: K.t3(x, timeperiod, vfactor))


def TRIMA(real: In, timeperiod: int = 30) -> Native:
    x = number(real)
    a, b = (timeperiod // 2 + 1,) * 2 if timeperiod % 2 else (timeperiod // 2, timeperiod // 2 + 1)
    return Native(lambda s, t: [{"a": s.skipping(x, a, F.avg)}, {"": s.skipping(F.col(t("a")), b, F.avg)}])


def KAMA(real: In, timeperiod: int = 30, as_written: bool = False) -> Fold:
    return Fold([number(real)], lambda x: K.kama(x, timeperiod, as_written))


def MA(real: In, timeperiod: int = 30, matype: int = 0) -> Native | Fold:
    """0 simple, 1 EMA, 2 WMA, 3 DEMA, 4 TEMA, 5 TRIMA, 6 KAMA, 7 simple, 8 T3 with factor 0."""
    kinds = {1: EMA, 2: WMA, 3: DEMA, 4: TEMA, 5: TRIMA, 6: KAMA, 8: lambda r, p: T3(r, p, 0.0)}
    return kinds.get(matype, SMA)(real, timeperiod)


def BBANDS(real: In, timeperiod: int = 20, nbdevup: float = 2.0, nbdevdn: float = 2.0) -> Native:
    x = number(real)

    def stages(s, t):
        mean, dev = s.skipping(x, timeperiod, F.avg), s.skipping(x, timeperiod, F.stddev_pop)
        return [{"m": mean, "d": dev}, {"bb_upper": F.col(t("m")) + nbdevup * F.col(t("d")), "bb_middle": F.col(t("m")), "bb_lower": F.col(t("m")) - nbdevdn * F.col(t("d"))}]

    return Native(stages)


def MIDPOINT(real: In, timeperiod: int = 14) -> Native:
    x = number(real)

    def one(s):
        w = s.last(max(1, timeperiod), x.isNull())
        return F.when(x.isNotNull(), (F.max(x).over(w) + F.min(x).over(w)) / 2)

    return _one(one)


def MIDPRICE(high: In, low: In, timeperiod: int = 14) -> Native:
    h, l = number(high), number(low)  # noqa: E741

    def one(s):
        gone = h.isNull() | l.isNull()
        w = s.last(max(1, timeperiod), gone)
        return F.when(~gone, (F.max(h).over(w) + F.min(l).over(w)) / 2)

    return _one(one)


def MAMA(real: In, fastlimit: float = 0.5, slowlimit: float = 0.05) -> Fold:
    return Fold([number(real)], lambda x: K.mama(x, fastlimit, slowlimit), ("mama", "fama"))


def MAVP(real: In, periods: In, minperiod: int = 2, maxperiod: int = 30, matype: int = 0) -> Native | Fold:
    x, p = F.coalesce(number(real), F.lit(0.0)), F.least(F.greatest(F.coalesce(number(periods), F.lit(0.0)), F.lit(float(minperiod))), F.lit(float(maxperiod)))
    if matype not in (0, 7):
        return Fold([number(real), number(periods)], lambda a, b: K.mavp(a, b, minperiod, maxperiod, matype))

    def one(s):
        out = F.lit(None).cast("double")
        for k in range(maxperiod, minperiod - 1, -1):
            out = F.when(F.floor(p) == k, s.full(x, k, F.avg)).otherwise(out)
        return out

    return _one(one)


def SAR(high: In, low: In, acceleration: float = 0.02, maximum: float = 0.2) -> Fold:
    a, m = acceleration, maximum
    return Fold([number(high), number(low)], lambda h, l: K.stops(h, l, 0.0, 0.0, a, a, m, a, a, m)[0])


def SAREXT(high: In, low: In, startvalue: float = 0.0, offsetonreverse: float = 0.0, accelerationinitlong: float = 0.02, accelerationlong: float = 0.02, accelerationmaxlong: float = 0.2, accelerationinitshort: float = 0.02, accelerationshort: float = 0.02, accelerationmaxshort: float = 0.2) -> Fold:
    more = (startvalue, offsetonreverse, accelerationinitlong, accelerationlong, accelerationmaxlong, accelerationinitshort, accelerationshort, accelerationmaxshort)
    return Fold([number(high), number(low)], lambda h, l: K.sarext(h, l, *more))


# momentum


def _bars(*names: In) -> list[Column]:
    return [number(x) for x in names]


def ADX(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low, close), lambda h, l, c: K.adx(h, l, c, timeperiod))


def ADXR(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low, close), lambda h, l, c: K.adxr(h, l, c, timeperiod))


def APO(real: In, fastperiod: int = 12, slowperiod: int = 26, matype: int = 0) -> Native | Fold:
    x = number(real)
    if matype in (0, 7):
        return _one(lambda s: s.skipping(x, fastperiod, F.avg) - s.skipping(x, slowperiod, F.avg))
    return Fold([x], lambda a: K.ma(a, fastperiod, matype) - K.ma(a, slowperiod, matype))


def _aroon(high: In, low: In, p: int):
    h, l = number(high), number(low)  # noqa: E741

    def stages(s, t):
        rn = F.col("__rn")
        w = s.window().rowsBetween(-p, 0)
        full = F.count(F.when(h.isNotNull() & l.isNotNull(), 1)).over(w) > p
        at = lambda x: F.when(full, 100.0 * (p - (rn - F.max(F.struct(x.alias("x"), rn.alias("rn"))).over(w)["rn"])) / p)
        return [{"__rn": F.row_number().over(s.window())}, {"aroon_up": at(h), "aroon_down": at(-l)}]

    return stages


def AROON(high: In, low: In, timeperiod: int = 14) -> Native:
    return Native(_aroon(high, low, timeperiod))


def AROONOSC(high: In, low: In, timeperiod: int = 14) -> Native:
    def stages(s, t):
        first, both = _aroon(high, low, timeperiod)(s, t)
        return [first, {"": both["aroon_up"] - both["aroon_down"]}]

    return Native(stages)


def BOP(open: In, high: In, low: In, close: In) -> Native:
    o, h, l, c = _bars(open, high, low, close)  # noqa: E741
    return _one(lambda s: F.when(h == l, 0.0 * (c - o)).otherwise(_quotient(c - o, h - l)))


def CCI(high: In, low: In, close: In, timeperiod: int = 14) -> Native:
    h, l, c = _bars(high, low, close)  # noqa: E741
    p = timeperiod

    def stages(s, t):
        tp, mean, seen = F.col(t("tp")), F.col(t("mean")), F.col(t("seen"))
        away = F.aggregate(seen, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / p
        return [{"tp": (h + l + c) / 3}, {"mean": s.full(tp, p, F.avg), "seen": F.collect_list(tp).over(s.last(max(1, p)))}, {"": _quotient(tp - mean, 0.015 * away)}]

    return Native(stages)


def CMO(real: In, timeperiod: int = 14) -> Native:
    x, p = number(real), timeperiod

    def stages(s, t):
        d = F.col(t("d"))
        up, down = s.full(F.greatest(d, F.lit(0.0)), p, F.sum), s.full(F.greatest(-d, F.lit(0.0)), p, F.sum)
        return [{"d": F.when(x.isNotNull(), F.coalesce(x - s.lag(x), F.lit(0.0)))}, {"u": up, "n": down}, {"": F.when(F.col(t("u")) + F.col(t("n")) == 0, 0.0).otherwise(100 * _quotient(F.col(t("u")) - F.col(t("n")), F.col(t("u")) + F.col(t("n"))))}]

    return Native(stages)


def DX(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low, close), lambda h, l, c: K.directional(h, l, c, timeperiod)[2])


def MACD(real: In, fastperiod: int = 12, slowperiod: int = 26, signalperiod: int = 9) -> Fold:
    return Fold([number(real)], lambda x: K.macd(x, fastperiod, slowperiod, signalperiod), ("macd", "macd_signal", "macd_hist"))


def MACDEXT(real: In, fastperiod: int = 12, fastmatype: int = 0, slowperiod: int = 26, slowmatype: int = 0, signalperiod: int = 9, signalmatype: int = 0) -> Native | Fold:
    names, x = ("macd_dif", "macd_dea", "macd_hist"), number(real)
    if {fastmatype, slowmatype, signalmatype} <= {0, 7}:

        def stages(s, t):
            dif, dea = F.col(t("dif")), F.col(t("dea"))
            return [{"dif": s.skipping(x, fastperiod, F.avg) - s.skipping(x, slowperiod, F.avg)}, {"dea": s.skipping(dif, signalperiod, F.avg)}, dict(zip(names, (dif, dea, dif - dea), strict=True))]

        return Native(stages)
    return Fold([x], lambda a: K.macdext(a, fastperiod, fastmatype, slowperiod, slowmatype, signalperiod, signalmatype), names)


def MACDFIX(real: In, signalperiod: int = 9) -> Fold:
    return MACD(real, 12, 26, signalperiod)


def MFI(high: In, low: In, close: In, volume: In, timeperiod: int = 14) -> Native:
    h, l, c, v = _bars(high, low, close, volume)  # noqa: E741
    p = timeperiod

    def stages(s, t):
        tp, move, flow = F.col(t("tp")), F.col(t("move")), F.col(t("flow"))
        up, down = F.col(t("up")), F.col(t("down"))
        part = lambda ok: s.full(F.when(move.isNotNull() & flow.isNotNull(), F.when(ok, flow).otherwise(0.0)), p, F.sum)
        return [{"tp": (h + l + c) / 3}, {"move": tp - s.lag(tp), "flow": tp * v}, {"up": part(move > 0), "down": part(move < 0)}, {"": F.when(down == 0, 100.0).otherwise(100 - _quotient(F.lit(100.0), 1 + _quotient(up, down)))}]

    return Native(stages)


def MINUS_DI(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low, close), lambda h, l, c: K.directional(h, l, c, timeperiod)[1])


def MINUS_DM(high: In, low: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low), lambda h, l: K.rma(K.moves(h, l)[1], timeperiod))


def MOM(real: In, timeperiod: int = 10) -> Native:
    x = number(real)
    return _one(lambda s: x - s.lag(x, timeperiod))


def PLUS_DI(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low, close), lambda h, l, c: K.directional(h, l, c, timeperiod)[0])


def PLUS_DM(high: In, low: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low), lambda h, l: K.rma(K.moves(h, l)[0], timeperiod))


def PPO(real: In, fastperiod: int = 12, slowperiod: int = 26, matype: int = 0) -> Native | Fold:
    x = number(real)
    if matype in (0, 7):

        def one(s):
            fast, slow = s.skipping(x, fastperiod, F.avg), s.skipping(x, slowperiod, F.avg)
            return 100 * _quotient(fast - slow, slow)

        return _one(one)

    def ppo(a):
        slow = K.ma(a, slowperiod, matype)
        slow[slow == 0] = K.NAN
        return 100 * (K.ma(a, fastperiod, matype) - slow) / slow

    return Fold([x], ppo)


def _against(real: In, p: int, rule) -> Native:
    x = number(real)
    return _one(lambda s: rule(x, s.lag(x, p)))


def ROC(real: In, timeperiod: int = 10) -> Native:
    return _against(real, timeperiod, lambda x, y: _quotient(x - y, y) * 100)


def ROCP(real: In, timeperiod: int = 10) -> Native:
    return _against(real, timeperiod, lambda x, y: _quotient(x - y, y))


def ROCR(real: In, timeperiod: int = 10) -> Native:
    return _against(real, timeperiod, lambda x, y: _quotient(x, y))


def ROCR100(real: In, timeperiod: int = 10) -> Native:
    return _against(real, timeperiod, lambda x, y: _quotient(x, y) * 100)


def RSI(real: In, timeperiod: int = 14) -> Fold:
    return Fold([number(real)], lambda x: K.rsi(x, timeperiod))


def _fastk(s, h: Column, l: Column, c: Column, k: int) -> Column:  # noqa: E741
    top, bottom = s.full(h, k, F.max), s.full(l, k, F.min)
    return 100 * _quotient(c - bottom, top - bottom)


def STOCH(high: In, low: In, close: In, fastk_period: int = 5, slowk_period: int = 3, slowk_matype: int = 0, slowd_period: int = 3, slowd_matype: int = 0) -> Native | Fold:
    h, l, c = _bars(high, low, close)  # noqa: E741
    if {slowk_matype, slowd_matype} <= {0, 7}:

        def stages(s, t):
            k, slow = F.col(t("k")), F.col(t("slow"))
            return [{"k": _fastk(s, h, l, c, fastk_period)}, {"slow": s.skipping(k, slowk_period, F.avg)}, {"slowk": slow, "slowd": s.skipping(slow, slowd_period, F.avg)}]

        return Native(stages)

    def both(h, l, c):  # noqa: E741
        slow = K.ma(K.stochastic(h, l, c, fastk_period), slowk_period, slowk_matype)
        return slow, K.ma(slow, slowd_period, slowd_matype)

    return Fold([h, l, c], both, ("slowk", "slowd"))


def STOCHF(high: In, low: In, close: In, fastk_period: int = 5, fastd_period: int = 3, fastd_matype: int = 0) -> Native | Fold:
    h, l, c = _bars(high, low, close)  # noqa: E741
    if fastd_matype in (0, 7):

        def stages(s, t):
            k = F.col(t("k"))
            return [{"k": _fastk(s, h, l, c, fastk_period)}, {"fastk": k, "fastd": s.skipping(k, fastd_period, F.avg)}]

        return Native(stages)

    def both(h, l, c):  # noqa: E741
        k = K.stochastic(h, l, c, fastk_period)
        return k, K.ma(k, fastd_period, fastd_matype)

    return Fold([h, l, c], both, ("fastk", "fastd"))


def STOCHRSI(real: In, timeperiod: int = 14, fastk_period: int = 5, fastd_period: int = 3, fastd_matype: int = 0) -> Fold:
    def both(x):
        r = K.rsi(x, timeperiod)
        k = K.stochastic(r, r, r, fastk_period)
        return k, K.ma(k, fastd_period, fastd_matype)

    return Fold([number(real)], both, ("fastk", "fastd"))


def TRIX(real: In, timeperiod: int = 30) -> Fold:
    return Fold([number(real)], lambda x: K.trix(x, timeperiod))


def ULTOSC(high: In, low: In, close: In, timeperiod1: int = 7, timeperiod2: int = 14, timeperiod3: int = 28) -> Native:
    h, l, c = _bars(high, low, close)  # noqa: E741

    def stages(s, t):
        last = F.col(t("pc"))
        bottom, top = F.least(l, last), F.greatest(h, last)
        known = last.isNotNull()
        bp, tr = F.col(t("bp")), F.col(t("tr"))
        part = lambda p: _quotient(s.full(bp, p, F.sum), s.full(tr, p, F.sum))
        return [{"pc": s.lag(c)}, {"bp": F.when(known, c - bottom).otherwise(0.0), "tr": F.when(known, top - bottom).otherwise(0.0)}, {"": 100 * (4 * part(timeperiod1) + 2 * part(timeperiod2) + part(timeperiod3)) / 7}]

    return Native(stages)


def WILLR(high: In, low: In, close: In, timeperiod: int = 14) -> Native:
    h, l, c = _bars(high, low, close)  # noqa: E741

    def stages(s, t):
        top, bottom = F.col(t("top")), F.col(t("bottom"))
        return [{"top": s.full(h, timeperiod, F.max), "bottom": s.full(l, timeperiod, F.min)}, {"": F.when(top == bottom, 0.0).otherwise(-100 * _quotient(top - c, top - bottom))}]

    return Native(stages)


# cycle


def HT_DCPERIOD(real: In) -> Fold:
    return Fold([number(real)], K.ht_dcperiod)


def HT_DCPHASE(real: In) -> Fold:
    return Fold([number(real)], K.ht_dcphase)


def HT_PHASOR(real: In) -> Fold:
    return Fold([number(real)], K.ht_phasor, ("inphase", "quadrature"))


def HT_SINE(real: In) -> Fold:
    return Fold([number(real)], K.ht_sine, ("sine", "leadsine"))


def _mean4(x: Column):
    return lambda s: F.when(F.row_number().over(s.window()) >= 32, F.avg(x).over(s.last(4)))


def HT_TRENDLINE(real: In) -> Native:
    return _one(_mean4(number(real)))


def HT_TRENDMODE(real: In) -> Native:
    x = number(real)
    return Native(lambda s, t: [{"m": _mean4(x)(s)}, {"": F.when(F.col(t("m")).isNotNull(), F.when(F.abs(x - F.col(t("m"))) > 0.01 * F.col(t("m")), 1).otherwise(0))}])


# price, volatility, volume


def AVGPRICE(open: In, high: In, low: In, close: In) -> Native:
    o, h, l, c = _bars(open, high, low, close)  # noqa: E741
    return _one(lambda s: (o + h + l + c) * 0.25)


def MEDPRICE(high: In, low: In) -> Native:
    h, l = _bars(high, low)  # noqa: E741
    return _one(lambda s: (h + l) * 0.5)


def TYPPRICE(high: In, low: In, close: In) -> Native:
    h, l, c = _bars(high, low, close)  # noqa: E741
    return _one(lambda s: (h + l + c) / 3)


def WCLPRICE(high: In, low: In, close: In) -> Native:
    h, l, c = _bars(high, low, close)  # noqa: E741
    return _one(lambda s: (h + l + 2 * c) / 4)


def TRANGE(high: In, low: In, close: In) -> Native:
    h, l, c = _bars(high, low, close)  # noqa: E741

    def stages(s, t):
        last = F.col(t("pc"))
        return [{"pc": s.lag(c)}, {"": F.when(h.isNotNull() & l.isNotNull() & last.isNotNull(), F.greatest(h - l, F.abs(h - last), F.abs(l - last)))}]

    return Native(stages)


def ATR(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    return Fold(_bars(high, low, close), lambda h, l, c: K.atr(h, l, c, timeperiod))


def NATR(high: In, low: In, close: In, timeperiod: int = 14) -> Fold:
    def natr(h, l, c):  # noqa: E741
        c = c.copy()
        c[c == 0] = K.NAN
        return K.atr(h, l, c, timeperiod) / c * 100

    return Fold(_bars(high, low, close), natr)


def _flow(h: Column, l: Column, c: Column, v: Column) -> Column:  # noqa: E741
    return F.when(h == l, 0.0).otherwise(_quotient(2 * c - l - h, h - l) * v)


def AD(high: In, low: In, close: In, volume: In) -> Native:
    h, l, c, v = _bars(high, low, close, volume)  # noqa: E741
    return _one(lambda s: F.when(h == l, 0.0).otherwise(F.when(_flow(h, l, c, v).isNotNull(), F.sum(_flow(h, l, c, v)).over(s.upto()))))


def ADOSC(high: In, low: In, close: In, volume: In, fastperiod: int = 3, slowperiod: int = 10) -> Fold:
    return Fold(_bars(high, low, close, volume), lambda h, l, c, v: K.adosc(h, l, c, v, fastperiod, slowperiod))


def OBV(real: In, volume: In) -> Native:
    x, v = _bars(real, volume)

    def stages(s, t):
        d = F.col(t("d"))
        return [{"d": x - s.lag(x)}, {"": F.when(d.isNotNull(), F.sum(F.signum(d) * v).over(s.upto()))}]

    return Native(stages)


