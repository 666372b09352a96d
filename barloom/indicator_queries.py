"""A registered query for each indicator, over hourly walk bars, with an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import candle_sql
from .functions import candles
from .functions import indicators
from .plans import Indicator, indicate
from .sources.bars import JUMP_BARS_SQL, WALK_BARS_SQL, jump_bars, walk_bars


class _Later:
    """Indicator requests made when a session exists: Columns need one, the names of the queries do not."""

    def __getattr__(self, name: str):
        def later(*args):
            return lambda: getattr(indicators, name)(*(a() if callable(a) else a for a in args))

        return later


I = _Later()  # noqa: E741
HLC = ("high", "low", "close")
OHLC = ("open", *HLC)
C = "close"


def W(p: int, first: int | None = None) -> str:
    """A window of the last p rows (or rows from `first` back)."""
    return f"(PARTITION BY symbol ORDER BY hour ROWS BETWEEN {p - 1 if first is None else first} PRECEDING AND CURRENT ROW)"


ALL = "(PARTITION BY symbol ORDER BY hour)"


def full(agg: str, x: str, p: int) -> str:
    return f"CASE WHEN count({x}) OVER {W(p)} >= {p} THEN {agg}({x}) OVER {W(p)} END"


def skipping(x: str, p: int) -> str:
    """Average of the last p non-null values."""
    w = f"(PARTITION BY symbol, {x} IS NULL ORDER BY hour ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {w} >= {p} THEN avg({x}) OVER {w} END"


#: Six digits, the same in both engines on ties, without negative zeros.
SIX = "floor(({})::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def floor(c: Column) -> Column:
    """As a double, where Spark gives a long: NaN, infinite and large numbers stay what they are."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def six(c: Column) -> Column:
    return floor(c.cast("double") * 1e6 + 0.5) / 1e6


class Sql:
    """Common table expressions built up over `bars`, and with jumps over jump_bars too."""

    def __init__(self, jumps: bool = False) -> None:
        more = [JUMP_BARS_SQL.strip(), "every AS (SELECT * FROM bars UNION ALL SELECT * FROM jumps)"] if jumps else []
        self.ctes = [WALK_BARS_SQL.strip(), *more, f"b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) AS rn FROM {'every' if jumps else 'bars'})"]
        self.last = "b"
        self.n = 0

    def step(self, **columns: str) -> Sql:
        """Add columns to the current table."""
        self.n += 1
        self.ctes.append(f"s{self.n} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {self.last})")
        self.last = f"s{self.n}"
        return self

    def smooth(self, out: str, x: str, p: int, alpha: float) -> Sql:
        """Exponential average of the non-null values of column x, seeded by the mean of the first p."""
        self.n += 1
        n = self.n
        self.ctes += [
            f"k{n} AS (SELECT symbol, rn, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM {self.last} WHERE {x} IS NOT NULL)",
            f"r{n} AS (SELECT symbol, {p}::BIGINT AS k, avg(x) AS y FROM k{n} WHERE k <= {p} GROUP BY symbol HAVING count(*) = {p} UNION ALL SELECT r.symbol, r.k + 1, r.y + {alpha!r}::DOUBLE * (k{n}.x - r.y) FROM r{n} r JOIN k{n} ON k{n}.symbol = r.symbol AND k{n}.k = r.k + 1)",
            f"s{n} AS (SELECT t.*, y.y AS {out} FROM {self.last} t LEFT JOIN (SELECT k.symbol, k.rn, r.y FROM k{n} k JOIN r{n} r USING (symbol, k)) y USING (symbol, rn))",
        ]
        self.last = f"s{n}"
        return self

    def ema(self, out: str, x: str, p: int) -> Sql:
        return self.smooth(out, x, p, 2.0 / (p + 1))

    def rma(self, out: str, x: str, p: int) -> Sql:
        return self.smooth(out, x, p, 1.0 / p)

    def text(self, **outputs: str) -> str:
        columns = ", ".join(f"{SIX.format(v)} AS {k}" for k, v in outputs.items())
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT symbol, hour, {columns} FROM {self.last}"


def _ema_chain(x: str, p: int, n: int) -> Sql:
    s = Sql()
    for k in range(1, n + 1):
        s.ema(f"e{k}", x if k == 1 else f"e{k - 1}", p)
    return s


def directional(p: int) -> Sql:
    s = Sql().step(ph=f"lag(high) OVER {ALL}", pl=f"lag(low) OVER {ALL}", pc=f"lag(close) OVER {ALL}")
    s.step(up="coalesce(high - ph, 0)", down="coalesce(pl - low, 0)", tr="coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), 0)")
    s.step(pdm="CASE WHEN up > down AND up > 0 THEN up ELSE 0 END", mdm="CASE WHEN down > up AND down > 0 THEN down ELSE 0 END")
    s.step(tr0="CASE WHEN ph IS NULL THEN 0 ELSE tr END").rma("sp", "pdm", p).rma("sm", "mdm", p).rma("st", "tr0", p)
    s.step(pdi="100 * sp / nullif(st, 0)", mdi="100 * sm / nullif(st, 0)")
    return s.step(dx="CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END")


def _tr() -> Sql:
    return Sql().step(pc=f"lag(close) OVER {ALL}").step(tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END")


def _flow() -> Sql:
    return Sql().step(flow="CASE WHEN high = low THEN 0 ELSE (2 * close - low - high) / (high - low) * volume END").step(total=f"sum(flow) OVER {ALL}")


def _aroon(p: int) -> Sql:
    s = Sql().step(hh=full("max", "high", p + 1), ll=full("min", "low", p + 1))
    at = lambda x, best: f"(SELECT max(z.rn) FROM b z WHERE z.symbol = t.symbol AND z.rn BETWEEN t.rn - {p} AND t.rn AND z.{x} = t.{best})"
    s.ctes.append(f"ar AS (SELECT *, {at('high', 'hh')} AS ih, {at('low', 'll')} AS il FROM {s.last} t)")
    s.last = "ar"
    return s.step(up=f"100.0 * ({p} - (rn - ih)) / {p}", down=f"100.0 * ({p} - (rn - il)) / {p}")


def _rsi(p: int, s: Sql | None = None) -> Sql:
    s = (s or Sql()).step(d=f"coalesce(close - lag(close) OVER {ALL}, 0)").step(u="greatest(d, 0)", n="greatest(-d, 0)").rma("au", "u", p).rma("an", "n", p)
    return s.step(rsi="CASE WHEN an = 0 THEN 100 ELSE 100 - 100 / (1 + au / an) END")


def _stochk(s: Sql, h: str, l: str, c: str, k: int) -> Sql:  # noqa: E741
    s.step(top=full("max", h, k), bottom=full("min", l, k))
    return s.step(fastk=f"({c} - bottom) * 100 / nullif(top - bottom, 0)")


def _macd(fast: int, slow: int, signal: int) -> str:
    s = Sql().ema("f", "close", fast).ema("l", "close", slow).step(dif="f - l").step(d0="coalesce(dif, 0)").ema("sig", "d0", signal)
    return s.text(macd="dif", macd_signal="sig", macd_hist="dif - sig")


def _wma(p: int) -> str:
    return "CASE WHEN rn >= {p} THEN ({terms}) / {d}.0 END".format(p=p, terms=" + ".join(f"{p - k} * coalesce(lag(close, {k}) OVER {ALL}, 0)" for k in range(p)), d=p * (p + 1) // 2)


def _kama(p: int) -> str:
    s = Sql().step(d=f"abs(close - lag(close) OVER {ALL})", ch=f"abs(close - lag(close, {p}) OVER {ALL})").step(vol=f"sum(coalesce(d, 0)) OVER {W(p)}")
    s.step(sc="power(CASE WHEN vol > 0 THEN ch / vol ELSE 0 END * (2.0e0 / 3 - 2.0e0 / 31) + 2.0e0 / 31, 2)")
    s.ctes.append(f"kr AS (SELECT symbol, {2 * p}::BIGINT AS rn, avg(close) AS y FROM {s.last} WHERE rn BETWEEN {p + 1} AND {2 * p} GROUP BY symbol UNION ALL SELECT r.symbol, t.rn, r.y + t.sc * (t.close - r.y) FROM kr r JOIN {s.last} t ON t.symbol = r.symbol AND t.rn = r.rn + 1)")
    s.ctes.append(f"ko AS (SELECT t.*, CASE WHEN t.rn > {2 * p} THEN r.y END AS y FROM {s.last} t LEFT JOIN kr r USING (symbol, rn))")
    s.last = "ko"
    return s.text(kama="y")


def _sar(a: float, m: float) -> str:
    """Parabolic stop and reverse as a recursion over (long, stop, extreme, factor)."""
    s = Sql().step(ph=f"lag(high) OVER {ALL}", pl=f"lag(low) OVER {ALL}")
    s.ctes += [
        f"""f0 AS (SELECT t.symbol, t.rn, t.high, t.low, NOT ((pl - low) > (high - ph) AND (pl - low) > 0) AS lng, ph, pl FROM {s.last} t WHERE rn = 2)""",
        f"""st AS (
  SELECT symbol, 1::BIGINT AS rn, lng, CASE WHEN lng THEN pl ELSE ph END AS stop, CASE WHEN lng THEN high ELSE low END AS ep, {a}::DOUBLE AS af, high AS last_high, low AS last_low, NULL::DOUBLE AS out FROM f0
  UNION ALL
  SELECT symbol, rn, nl, CASE WHEN nl THEN least(s1 + naf * (nep - s1), last_low, low) ELSE greatest(s1 + naf * (nep - s1), last_high, high) END, nep, naf, high, low, out FROM (
    SELECT *, CASE WHEN flip THEN s0 ELSE stop END AS s1, CASE WHEN flip THEN s0 ELSE stop END AS out,
      CASE WHEN flip THEN {a}::DOUBLE WHEN lng AND high > ep OR NOT lng AND low < ep THEN least(af + {a}::DOUBLE, {m}::DOUBLE) ELSE af END AS naf,
      CASE WHEN flip THEN (CASE WHEN lng THEN low ELSE high END) WHEN lng THEN greatest(ep, high) ELSE least(ep, low) END AS nep, (lng AND NOT flip) OR (NOT lng AND flip) AS nl
    FROM (SELECT st.symbol, t.rn, st.lng, st.stop, st.ep, st.af, st.last_high, st.last_low, t.high, t.low,
        CASE WHEN st.lng THEN t.low <= st.stop ELSE t.high >= st.stop END AS flip,
        CASE WHEN st.lng THEN greatest(st.ep, st.last_high, t.high) ELSE least(st.ep, st.last_low, t.low) END AS s0
      FROM st JOIN {s.last} t ON t.symbol = st.symbol AND t.rn = st.rn + 1)))""",
        f"so AS (SELECT t.*, st.out, st.lng AS is_long FROM {s.last} t LEFT JOIN st USING (symbol, rn))",
    ]
    s.last = "so"
    return s.text(sar="out")


def _cycle(fast: float = 0.5, slow: float = 0.05) -> Sql:
    """The homodyne discriminator as a recursion over bars, its delay lines as lists (newest first): i and q of each bar,
    the smoothed period, and both adaptive averages."""
    tap = lambda v: f"(0.0962e0 * {v}[1] + 0.5769e0 * {v}[3] - 0.5769e0 * {v}[5] - 0.0962e0 * {v}[7])"
    push = lambda x, v: f"list_prepend({x}, {v}[1:6])"
    s = Sql().step(n="count(*) OVER (PARTITION BY symbol)", sp=f"CASE WHEN rn >= 4 THEN (4 * close + 3 * lag(close) OVER {ALL} + 2 * lag(close, 2) OVER {ALL} + lag(close, 3) OVER {ALL}) * 0.1e0 ELSE 0 END")
    s.step(four=f"0.0962e0 * sp + 0.5769e0 * lag(sp, 2) OVER {ALL} - 0.5769e0 * lag(sp, 4) OVER {ALL} - 0.0962e0 * lag(sp, 6) OVER {ALL}")
    zero = "[0, 0, 0, 0, 0, 0, 0]::DOUBLE[]"
    s.ctes.append(f"""hil AS (
  SELECT symbol, 6::BIGINT AS rn, {zero} AS det, {zero} AS qs, {zero} AS ins, 0::DOUBLE AS i2, 0::DOUBLE AS q2, 0::DOUBLE AS re, 0::DOUBLE AS im, 0::DOUBLE AS per, 0::DOUBLE AS sm, 0::DOUBLE AS ph, close AS ma, close AS fa FROM {s.last} WHERE rn = 6 AND n >= 32
  UNION ALL
  SELECT symbol, rn, det, qs, ins, i2, q2, re, im, per, 0.33e0 * per + 0.67e0 * sm AS sm, ph, ma, alpha / 2 * ma + (1 - alpha / 2) * fa AS fa FROM (
    SELECT *, 0.2e0 * least(greatest(least(greatest(raw, 0.67e0 * was), 1.5e0 * was), 6), 50) + 0.8e0 * was AS per, alpha * close + (1 - alpha) * last_ma AS ma FROM (
      SELECT *, CASE WHEN im != 0 AND re != 0 THEN 2 * pi() / atan(im / re) ELSE before END AS raw, greatest({fast} / greatest(last_ph - ph, 1), {slow}) AS alpha FROM (
        SELECT *, 0.2e0 * (i2 * i2p + q2 * q2p) + 0.8e0 * rep AS re, 0.2e0 * (i2 * q2p - q2 * i2p) + 0.8e0 * imp AS im, CASE WHEN ins[1] != 0 THEN degrees(atan(qs[1] / ins[1])) ELSE 0 END AS ph FROM (
          SELECT *, 0.2e0 * (ins[1] - {tap('qs')} * g) + 0.8e0 * i2p AS i2, 0.2e0 * (qs[1] + {tap('ins')} * g) + 0.8e0 * q2p AS q2 FROM (
            SELECT *, {push(f"{tap('det')} * g", 'lq')} AS qs, {push('det[4]', 'li')} AS ins FROM (
              SELECT symbol, rn, close, g, was, before, i2p, q2p, rep, imp, sm, last_ph, last_ma, fa, lq, li, {push('four * g', 'ld')} AS det FROM (
                SELECT h.symbol, t.rn, t.close, t.four, CASE WHEN t.rn = 7 THEN 6 ELSE h.per END AS was, h.per AS before, 0.075e0 * CASE WHEN t.rn = 7 THEN 6 ELSE h.per END + 0.54e0 AS g,
                  h.i2 AS i2p, h.q2 AS q2p, h.re AS rep, h.im AS imp, h.sm, h.ph AS last_ph, h.ma AS last_ma, h.fa, h.det AS ld, h.qs AS lq, h.ins AS li
                FROM hil h JOIN {s.last} t ON t.symbol = h.symbol AND t.rn = h.rn + 1))))))))""")
    s.ctes.append(f"cy AS (SELECT t.*, CASE WHEN t.rn >= 32 THEN h.ins[1] END AS i, CASE WHEN t.rn >= 32 THEN h.qs[1] END AS q, CASE WHEN t.rn >= 32 THEN h.sm END AS sm, CASE WHEN t.rn >= 32 THEN h.ph END AS ph, CASE WHEN t.rn >= 33 THEN h.ma END AS ma, CASE WHEN t.rn >= 33 THEN h.fa END AS fa FROM {s.last} t LEFT JOIN hil h USING (symbol, rn))")
    s.last = "cy"
    return s


def _catalog() -> dict[str, tuple[Callable[[], Indicator], str | None]]:
    """name -> (request, oracle); a struct's fields are the oracle's columns, else the column is the name."""
    q: dict[str, tuple[Callable[[], Indicator], str | None]] = {}

    def add(name: str, ind: Callable[[], Indicator], oracle: str | None) -> None:
        q[name] = (ind, oracle)

    add("sma", I.SMA(C, 20), Sql().text(sma=full("avg", C, 20)))
    add("ema", I.EMA(C, 12), Sql().ema("e", C, 12).text(ema="e"))
    add("wma", I.WMA(C, 9), Sql().text(wma=_wma(9)))
    add("dema", I.DEMA(C, 10), _ema_chain(C, 10, 2).text(dema="2 * e1 - e2"))
    add("tema", I.TEMA(C, 8), _ema_chain(C, 8, 3).text(tema="3 * e1 - 3 * e2 + e3"))
    v = 0.7
    add("t3", I.T3(C, 5, v), _ema_chain(C, 5, 6).text(t3=f"{-(v**3)!r}::DOUBLE * e6 + {3 * v**2 + 3 * v**3!r}::DOUBLE * e5 + {-6 * v**2 - 3 * v - 3 * v**3!r}::DOUBLE * e4 + {1 + 3 * v + v**3 + 3 * v**2!r}::DOUBLE * e3"))
    add("trima", I.TRIMA(C, 10), Sql().step(a=full("avg", C, 5)).text(trima=full("avg", "a", 6)))
    add("kama", I.KAMA(C, 10), _kama(10))
    add("ma", I.MA(C, 15, 1), Sql().ema("e", C, 15).text(ma="e"))
    add("bbands", I.BBANDS(C, 20), Sql().step(m=full("avg", C, 20), d=full("stddev_pop", C, 20)).text(bb_upper="m + 2 * d", bb_middle="m", bb_lower="m - 2 * d"))
    add("midpoint", I.MIDPOINT(C, 14), Sql().text(midpoint=f"(max(close) OVER {W(14)} + min(close) OVER {W(14)}) / 2"))
    add("midprice", I.MIDPRICE("high", "low", 14), Sql().text(midprice=f"(max(high) OVER {W(14)} + min(low) OVER {W(14)}) / 2"))
    add("mama", I.MAMA(C), _cycle().text(mama="ma", fama="fa"))
    cases = " ".join(f"WHEN {k} THEN {full('avg', C, k)}" for k in range(2, 13))
    add("mavp", I.MAVP(C, lambda: F.col("hour") % 15, 2, 12), Sql().text(mavp=f"CASE least(greatest(hour % 15, 2), 12) {cases} END"))
    add("sar", I.SAR("high", "low"), _sar(0.02, 0.2))
    add("sarext", I.SAREXT("high", "low"), _sar(0.02, 0.2).replace("((out)::DOUBLE", "((CASE WHEN is_long THEN out ELSE -out END)::DOUBLE").replace(" AS sar FROM", " AS sarext FROM"))

    add("adx", I.ADX(*HLC), directional(14).step(d0="coalesce(dx, 0)").rma("a", "d0", 14).text(adx="a"))
    add("adxr", I.ADXR(*HLC), directional(14).step(d0="coalesce(dx, 0)").rma("a", "d0", 14).text(adxr=f"(a + lag(a, 13) OVER {ALL}) * 0.5"))
    add("apo", I.APO(C), Sql().text(apo=f"{full('avg', C, 12)} - {full('avg', C, 26)}"))
    add("aroon", I.AROON("high", "low"), _aroon(14).text(aroon_up="up", aroon_down="down"))
    add("aroonosc", I.AROONOSC("high", "low"), _aroon(14).text(aroonosc="up - down"))
    add("bop", I.BOP(*OHLC), Sql().text(bop="CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END"))
    cci = Sql().step(tp="(high + low + close) / 3").step(m=full("avg", "tp", 14), xs=f"list(tp) OVER {W(14)}").step(dev="list_sum(list_transform(xs, lambda x: abs(x - m))) / 14")
    add("cci", I.CCI(*HLC), cci.text(cci="(tp - m) / nullif(0.015e0 * dev, 0)"))
    cmo = Sql().step(d=f"coalesce(close - lag(close) OVER {ALL}, 0)").step(u=full("sum", "greatest(d, 0)", 14), n=full("sum", "greatest(-d, 0)", 14))
    add("cmo", I.CMO(C), cmo.text(cmo="CASE WHEN u + n = 0 THEN 0 ELSE 100 * (u - n) / (u + n) END"))
    add("dx", I.DX(*HLC), directional(14).text(dx="dx"))
    add("macd", I.MACD(C), _macd(12, 26, 9))
    ext = Sql().step(dif=f"{full('avg', C, 12)} - {full('avg', C, 26)}").step(dea=full("avg", "dif", 9))
    add("macdext", I.MACDEXT(C), ext.text(macd_dif="dif", macd_dea="dea", macd_hist="dif - dea"))
    add("macdfix", I.MACDFIX(C), _macd(12, 26, 9))
    mfi = Sql().step(tp="(high + low + close) / 3").step(mv=f"tp - lag(tp) OVER {ALL}").step(a="CASE WHEN mv IS NOT NULL THEN CASE WHEN mv > 0 THEN tp * volume ELSE 0 END END", z="CASE WHEN mv IS NOT NULL THEN CASE WHEN mv < 0 THEN tp * volume ELSE 0 END END")
    mfi.step(up=full("sum", "a", 14), down=full("sum", "z", 14))
    add("mfi", I.MFI(*HLC, "volume"), mfi.text(mfi="CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END"))
    add("minus_di", I.MINUS_DI(*HLC), directional(14).text(minus_di="mdi"))
    add("minus_dm", I.MINUS_DM("high", "low"), directional(14).text(minus_dm="sm"))
    add("mom", I.MOM(C), Sql().text(mom=f"close - lag(close, 10) OVER {ALL}"))
    add("plus_di", I.PLUS_DI(*HLC), directional(14).text(plus_di="pdi"))
    add("plus_dm", I.PLUS_DM("high", "low"), directional(14).text(plus_dm="sp"))
    add("ppo", I.PPO(C), Sql().step(f=full("avg", C, 12), l=full("avg", C, 26)).text(ppo="100 * (f - l) / nullif(l, 0)"))
    y = f"nullif(lag(close, 10) OVER {ALL}, 0)"
    add("roc", I.ROC(C), Sql().text(roc=f"(close - {y}) / {y} * 100"))
    add("rocp", I.ROCP(C), Sql().text(rocp=f"(close - {y}) / {y}"))
    add("rocr", I.ROCR(C), Sql().text(rocr=f"close / {y}"))
    add("rocr100", I.ROCR100(C), Sql().text(rocr100=f"close / {y} * 100"))
    add("rsi", I.RSI(C), _rsi(14).text(rsi="rsi"))
    add("stoch", I.STOCH(*HLC), None)
    add("stochf", I.STOCHF(*HLC), None)
    add("stochrsi", I.STOCHRSI(C), None)
    add("trix", I.TRIX(C, 12), Sql().ema("e1", C, 12).step(z1="coalesce(e1, 0)").ema("e2", "z1", 12).step(z2="coalesce(e2, 0)").ema("e3", "z2", 12).step(p=f"lag(e3) OVER {ALL}").text(trix="(e3 - p) / nullif(p, 0) * 100"))
    ult = Sql().step(pc=f"lag(close) OVER {ALL}").step(bp="CASE WHEN pc IS NULL THEN 0 ELSE close - least(low, pc) END", tr="CASE WHEN pc IS NULL THEN 0 ELSE greatest(high, pc) - least(low, pc) END")
    part = lambda p: f"{full('sum', 'bp', p)} / nullif({full('sum', 'tr', p)}, 0)"
    ult.step(a=part(7), z=part(14), y=part(28))
    add("ultosc", I.ULTOSC(*HLC), ult.text(ultosc="100 * (4 * a + 2 * z + y) / 7"))
    add("willr", I.WILLR(*HLC), Sql().step(t=full("max", "high", 14), m=full("min", "low", 14)).text(willr="CASE WHEN t = m THEN 0 ELSE -100 * (t - close) / (t - m) END"))

    add("ht_dcperiod", I.HT_DCPERIOD(C), _cycle().text(ht_dcperiod="sm"))
    add("ht_dcphase", I.HT_DCPHASE(C), _cycle().step(a="ph + 90 + CASE WHEN i < 0 THEN 180 ELSE 0 END").text(ht_dcphase="CASE WHEN a > 315 THEN a - 360 ELSE a END"))
    add("ht_phasor", I.HT_PHASOR(C), _cycle().text(inphase="i", quadrature="q"))
    add("ht_sine", I.HT_SINE(C), _cycle().text(sine="sin(radians(ph))", leadsine="sin(radians(ph + 45))"))
    m4 = f"CASE WHEN rn >= 32 THEN avg(close) OVER {W(4)} END"
    add("ht_trendline", I.HT_TRENDLINE(C), Sql().text(ht_trendline=m4))
    add("ht_trendmode", I.HT_TRENDMODE(C), Sql().step(m=m4).text(ht_trendmode="CASE WHEN m IS NOT NULL THEN CASE WHEN abs(close - m) > 0.01e0 * m THEN 1 ELSE 0 END END"))

    add("avgprice", I.AVGPRICE(*OHLC), Sql().text(avgprice="(open + high + low + close) * 0.25e0"))
    add("medprice", I.MEDPRICE("high", "low"), Sql().text(medprice="(high + low) * 0.5e0"))
    add("typprice", I.TYPPRICE(*HLC), Sql().text(typprice="(high + low + close) / 3"))
    add("wclprice", I.WCLPRICE(*HLC), Sql().text(wclprice="(high + low + 2 * close) / 4"))
    add("trange", I.TRANGE(*HLC), _tr().text(trange="tr"))
    add("atr", I.ATR(*HLC), _tr().ema("a", "tr", 27).text(atr="a"))
    add("natr", I.NATR(*HLC), _tr().ema("a", "tr", 27).text(natr="a / close * 100"))
    add("ad", I.AD(*HLC, "volume"), _flow().text(ad="CASE WHEN high = low THEN 0 ELSE total END"))
    add("adosc", I.ADOSC(*HLC, "volume"), _flow().ema("f", "total", 3).ema("l", "total", 10).text(adosc="f - l"))
    add("obv", I.OBV(C, "volume"), Sql().step(d=f"close - lag(close) OVER {ALL}").text(obv=f"CASE WHEN d IS NOT NULL THEN sum(sign(d) * volume) OVER {ALL} END"))

    # stochastics skip the rows without a range
    q["stoch"] = (q["stoch"][0], _stochk(Sql(), *HLC, 5).step(k=skipping("fastk", 3)).text(slowk="k", slowd=skipping("k", 3)))
    q["stochf"] = (q["stochf"][0], _stochk(Sql(), *HLC, 5).text(fastk="fastk", fastd=skipping("fastk", 3)))
    q["stochrsi"] = (q["stochrsi"][0], _stochk(_rsi(14), "rsi", "rsi", "rsi", 5).text(fastk="fastk", fastd=skipping("fastk", 3)))

    both = f"{WALK_BARS_SQL.strip()}, {JUMP_BARS_SQL.strip()}, every AS (SELECT * FROM bars UNION ALL SELECT * FROM jumps), {candle_sql.BARS.strip().format(table='every')}"
    for name in candles.RULES:
        short = name[3:].lower()
        add(f"cdl_{short}", lambda name=name: candles.candle(name), f"WITH {both} SELECT symbol, hour, {SIX.format(candle_sql.pattern(short))} AS cdl_{short} FROM seq")
    return q


CATALOG = _catalog()


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = walk_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
        if name.startswith("cdl_"):  # patterns need gaps, long bodies and runs as well
            bars = bars.unionByName(jump_bars(bars))
        out = indicate(bars, ["symbol"], ["hour"], out=CATALOG[name][0]())
        kind = out.schema["out"].dataType
        fields = [(f.name, F.col(f"out.{f.name}")) for f in kind.fields] if hasattr(kind, "fields") else [(name, F.col("out"))]
        return out.select("symbol", "hour", *(six(c).alias(k) for k, c in fields))

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in CATALOG}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
