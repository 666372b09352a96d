"""The candlestick patterns once more, in DuckDB's SQL: the oracle of the registered queries, written by hand from the
definitions. Nothing here is shared with functions.candles.

z is the bar that is judged; y, x, v and u are the bars one to four before it. A bar has its prices (o, h, l, c), body,
mid, upper and lower shadow (us, ls), and tests: rise, fall, big (body over 5 % of the price), small (under 10 %), doji
(at most 0.5 %).
"""

from __future__ import annotations

BARS = """
one AS (SELECT symbol, hour, open AS o, high AS h, low AS l, close AS c, abs(open - close) AS body, (open + close) / 2 AS mid, high - greatest(open, close) AS us, least(open, close) - low AS ls FROM {table}),
two AS (SELECT *, c > o AS rise, c < o AS fall, body > 0.05::DOUBLE * (o + c) * 0.5::DOUBLE AS big, body < 0.1::DOUBLE * (o + c) * 0.5::DOUBLE AS small, body <= 0.005::DOUBLE * (o + c) * 0.5::DOUBLE AS doji FROM one),
z0 AS (SELECT symbol, hour, two AS z FROM two),
seq AS (SELECT symbol, hour, z, lag(z, 1) OVER t AS y, lag(z, 2) OVER t AS x, lag(z, 3) OVER t AS v, lag(z, 4) OVER t AS u FROM z0 WINDOW t AS (PARTITION BY symbol ORDER BY hour))
"""


def _in(a: str, low: str, high: str) -> str:
    return f"{a} > {low} AND {a} < {high}"


def _near(a: str, b: str, share: str = "0.01") -> str:
    return f"abs({a} - ({b})) < {share}::DOUBLE * (z.h + z.l) * 0.5::DOUBLE"


def _same(a: str, b: str) -> str:
    return _near(a, b, "0.001")


def _bare(b: str) -> str:
    """A body with next to no shadows."""
    return f"{b}.big AND {b}.us < 0.1::DOUBLE * {b}.body AND {b}.ls < 0.1::DOUBLE * {b}.body"


def _no(side: str, b: str = "z") -> str:
    return f"{b}.{side} < 0.1::DOUBLE * {b}.body"


def _tall(side: str, b: str = "z") -> str:
    return f"{b}.{side} > 2 * {b}.body"


_GAP_UP = f"x.rise AND y.rise AND y.o > x.c AND z.fall AND {_in('z.o', 'y.o', 'y.c')} AND {_in('z.c', 'x.o', 'x.c')}"
_GAP_DOWN = f"x.fall AND y.fall AND y.o < x.c AND z.rise AND {_in('z.o', 'y.c', 'y.o')} AND {_in('z.c', 'x.c', 'x.o')}"
_KICK_UP = f"y.fall AND {_bare('y')} AND z.rise AND {_bare('z')} AND z.o > y.o"
_KICK_DOWN = f"y.rise AND {_bare('y')} AND z.fall AND {_bare('z')} AND z.o < y.o"
_REST = "u.big AND v.small AND x.small AND y.small AND greatest(v.h, x.h, y.h) < u.h AND least(v.l, x.l, y.l) > u.l AND z.big"
_BUY, _SELL = "x.fall AND x.big", "x.rise AND x.big"
_BUY2, _SELL2 = "y.fall AND y.big", "y.rise AND y.big"

#: name: (condition of 100, condition of -100); 'false' where there is none.
CONDITIONS: dict[str, tuple[str, str]] = {
    "2crows": ("false", f"{_SELL} AND y.fall AND y.o > x.c AND z.fall AND {_in('z.o', 'y.c', 'y.o')} AND {_in('z.c', 'x.o', 'x.c')}"),
    "3blackcrows": ("false", f"{_BUY} AND {_BUY2} AND z.fall AND z.big AND {_in('y.o', 'x.c', 'x.o')} AND {_in('z.o', 'y.c', 'y.o')} AND x.c > y.c AND y.c > z.c"),
    "3inside": (f"{_BUY} AND y.rise AND y.c < x.o AND y.o > x.c AND z.rise AND z.c > x.o", f"{_SELL} AND y.fall AND y.o < x.c AND y.c > x.o AND z.fall AND z.c < x.o"),
    "3linestrike": (f"v.fall AND x.fall AND y.fall AND v.c > x.c AND x.c > y.c AND {_in('x.o', 'v.c', 'v.o')} AND {_in('y.o', 'x.c', 'x.o')} AND z.rise AND z.o < y.c AND z.c > v.o", f"v.rise AND x.rise AND y.rise AND v.c < x.c AND x.c < y.c AND {_in('x.o', 'v.o', 'v.c')} AND {_in('y.o', 'x.o', 'x.c')} AND z.fall AND z.o > y.c AND z.c < v.o"),
    "3outside": ("x.fall AND y.rise AND y.o <= x.c AND y.c >= x.o AND z.rise AND z.c > y.c", "x.rise AND y.fall AND y.o >= x.c AND y.c <= x.o AND z.fall AND z.c < y.c"),
    "3starsinsouth": (f"{_BUY} AND {_tall('ls', 'x')} AND y.fall AND y.l > x.l AND y.c > x.c AND z.fall AND z.small AND z.h < y.h AND z.l > y.l", "false"),
    "3whitesoldiers": (f"{_SELL} AND {_SELL2} AND z.rise AND z.big AND x.o < y.o AND y.o <= x.c AND y.o < z.o AND z.o <= y.c AND x.c < y.c AND y.c < z.c", "false"),
    "abandonedbaby": (f"{_BUY} AND y.doji AND y.h < x.l AND z.rise AND z.l > y.h", f"{_SELL} AND y.doji AND y.l > x.h AND z.fall AND z.h < y.l"),
    "advanceblock": ("false", f"{_SELL} AND y.rise AND z.rise AND x.o < y.o AND y.o <= x.c AND y.o < z.o AND z.o <= y.c AND x.c < y.c AND y.c < z.c AND z.body < y.body"),
    "belthold": (f"z.rise AND z.big AND {_no('ls')}", f"z.fall AND z.big AND {_no('us')}"),
    "breakaway": (f"u.fall AND u.big AND v.fall AND v.o < u.c AND x.c < v.c AND z.rise AND {_in('z.c', 'v.o', 'u.c')}", f"u.rise AND u.big AND v.rise AND v.o > u.c AND x.c > v.c AND z.fall AND {_in('z.c', 'u.c', 'v.o')}"),
    "closingmarubozu": (f"z.rise AND z.big AND {_no('us')}", f"z.fall AND z.big AND {_no('ls')}"),
    "concealbabyswall": (f"v.fall AND {_bare('v')} AND x.fall AND {_bare('x')} AND x.c < v.c AND y.fall AND y.h > x.c AND z.fall AND z.big AND z.o > y.h AND z.c < x.l", "false"),
    "counterattack": (f"{_BUY2} AND z.rise AND z.big AND {_near('z.c', 'y.c')}", f"{_SELL2} AND z.fall AND z.big AND {_near('z.c', 'y.c')}"),
    "darkcloudcover": ("false", f"{_SELL2} AND z.fall AND z.o > y.c AND z.c < y.c - 0.5::DOUBLE * y.body AND z.c > y.o"),
    "doji": ("z.doji", "false"),
    "dojistar": (f"{_BUY2} AND z.doji AND z.mid < y.c", f"{_SELL2} AND z.doji AND z.mid > y.c"),
    "dragonflydoji": (f"z.doji AND {_tall('ls')} AND {_no('us')}", "false"),
    "engulfing": ("y.fall AND z.rise AND z.o <= y.c AND z.c >= y.o AND NOT (z.o = y.c AND z.c = y.o)", "y.rise AND z.fall AND z.o >= y.c AND z.c <= y.o AND NOT (z.o = y.c AND z.c = y.o)"),
    "eveningdojistar": ("false", f"{_SELL} AND y.doji AND y.o > x.c AND y.c > x.c AND z.fall AND z.c < x.c - 0.3::DOUBLE * x.body"),
    "eveningstar": ("false", f"{_SELL} AND y.small AND y.o > x.c AND y.c > x.c AND z.fall AND z.c < x.c - 0.3::DOUBLE * x.body"),
    "gapsidesidewhite": (f"x.rise AND y.o > x.c AND y.rise AND z.rise AND {_near('z.body', 'y.body')} AND {_near('z.o', 'y.o')}", f"x.fall AND y.c < x.c AND y.rise AND z.rise AND {_near('z.body', 'y.body')} AND {_near('z.o', 'y.o')}"),
    "gravestonedoji": ("false", f"z.doji AND {_tall('us')} AND {_no('ls')}"),
    "hammer": (f"y.fall AND z.small AND {_tall('ls')} AND {_no('us')}", "false"),
    "hangingman": ("false", f"y.rise AND z.small AND {_tall('ls')} AND {_no('us')}"),
    "harami": (f"{_BUY2} AND z.rise AND z.small AND z.o > y.c AND z.c < y.o", f"{_SELL2} AND z.fall AND z.small AND z.o < y.c AND z.c > y.o"),
    "haramicross": (f"{_BUY2} AND z.doji AND {_in('z.o', 'y.c', 'y.o')} AND {_in('z.c', 'y.c', 'y.o')}", f"{_SELL2} AND z.doji AND {_in('z.o', 'y.o', 'y.c')} AND {_in('z.c', 'y.o', 'y.c')}"),
    "highwave": (f"z.rise AND z.small AND {_tall('us')} AND {_tall('ls')}", f"z.fall AND z.small AND {_tall('us')} AND {_tall('ls')}"),
    "hikkake": ("y.h < x.h AND y.l > x.l AND z.rise AND z.c > x.h", "y.h < x.h AND y.l > x.l AND z.fall AND z.c < x.l"),
    "hikkakemod": ("v.h > x.h AND x.h > y.h AND v.l < x.l AND x.l < y.l AND z.rise AND z.c > v.h", "v.h > x.h AND x.h > y.h AND v.l < x.l AND x.l < y.l AND z.fall AND z.c < v.l"),
    "homingpigeon": (f"{_BUY2} AND z.fall AND z.small AND z.o < y.o AND z.c > y.c", "false"),
    "identical3crows": ("false", f"{_BUY} AND {_BUY2} AND z.fall AND z.big AND {_same('y.o', 'x.c')} AND {_same('z.o', 'y.c')} AND x.c > y.c AND y.c > z.c"),
    "inneck": ("false", f"{_BUY2} AND z.rise AND z.o < y.c AND {_near('z.c', 'y.c')}"),
    "invertedhammer": (f"y.fall AND z.small AND {_tall('us')} AND {_no('ls')}", "false"),
    "kicking": (_KICK_UP, _KICK_DOWN),
    "kickingbylength": (_KICK_UP, _KICK_DOWN),
    "ladderbottom": (f"u.fall AND u.big AND v.fall AND x.fall AND y.fall AND u.c > v.c AND v.c > x.c AND {_tall('us', 'y')} AND z.rise AND z.o > y.o", "false"),
    "longleggeddoji": (f"z.doji AND {_tall('us')} AND {_tall('ls')}", "false"),
    "longline": ("z.rise AND z.big AND z.us < 0.5::DOUBLE * z.body AND z.ls < 0.5::DOUBLE * z.body", "z.fall AND z.big AND z.us < 0.5::DOUBLE * z.body AND z.ls < 0.5::DOUBLE * z.body"),
    "marubozu": (f"z.rise AND {_bare('z')}", f"z.fall AND {_bare('z')}"),
    "matchinglow": (f"{_BUY2} AND z.fall AND {_same('z.c', 'y.c')}", "false"),
    "mathold": ("u.rise AND u.big AND v.small AND v.o > u.c AND x.small AND y.small AND least(v.l, x.l, y.l) > u.o AND z.rise AND z.c > u.c", "false"),
    "morningdojistar": (f"{_BUY} AND y.doji AND y.o < x.c AND y.c < x.c AND z.rise AND z.c > x.c + 0.3::DOUBLE * x.body", "false"),
    "morningstar": (f"{_BUY} AND y.small AND y.o < x.c AND y.c < x.c AND z.rise AND z.c > x.c + 0.3::DOUBLE * x.body", "false"),
    "onneck": ("false", f"{_BUY2} AND z.rise AND z.o < y.c AND {_near('z.c', 'y.l')}"),
    "piercing": (f"{_BUY2} AND z.rise AND z.o < y.c AND z.c > y.c + 0.5::DOUBLE * y.body AND z.c < y.o", "false"),
    "rickshawman": (f"z.doji AND {_tall('us')} AND {_tall('ls')} AND {_near('z.us', 'z.ls')}", "false"),
    "risefall3methods": (f"{_REST} AND u.rise AND z.rise AND z.c > u.c", f"{_REST} AND u.fall AND z.fall AND z.c < u.c"),
    "separatinglines": (f"{_BUY2} AND z.rise AND z.big AND {_same('z.o', 'y.o')}", f"{_SELL2} AND z.fall AND z.big AND {_same('z.o', 'y.o')}"),
    "shootingstar": ("false", f"y.rise AND z.small AND {_tall('us')} AND {_no('ls')}"),
    "shortline": ("z.rise AND z.small AND greatest(z.us, z.ls) < 0.5::DOUBLE * z.body", "z.fall AND z.small AND greatest(z.us, z.ls) < 0.5::DOUBLE * z.body"),
    "spinningtop": ("z.rise AND z.small AND least(z.us, z.ls) > z.body", "z.fall AND z.small AND least(z.us, z.ls) > z.body"),
    "stalledpattern": ("false", f"{_SELL} AND {_SELL2} AND y.c > x.c AND z.rise AND z.small AND z.c > y.c AND y.o < z.o AND z.o <= y.c"),
    "sticksandwich": (f"{_BUY} AND y.rise AND y.big AND y.o > x.c AND z.fall AND z.big AND {_same('z.c', 'x.c')}", "false"),
    "takuri": (f"z.doji AND z.ls > 3 * z.body AND {_no('us')}", "false"),
    "tasukigap": (_GAP_UP, _GAP_DOWN),
    "thrusting": ("false", f"{_BUY2} AND z.rise AND z.o < y.c AND z.c > y.c AND z.c < y.c + 0.5::DOUBLE * y.body"),
    "tristar": ("x.doji AND y.doji AND z.doji AND y.mid < x.mid AND y.mid < z.mid", "x.doji AND y.doji AND z.doji AND y.mid > x.mid AND y.mid > z.mid"),
    "unique3river": (f"{_BUY} AND y.fall AND y.l < x.l AND y.c > y.l AND {_in('y.o', 'x.c', 'x.o')} AND z.rise AND z.small AND z.c < y.c", "false"),
    "upsidegap2crows": ("false", f"{_SELL} AND y.fall AND y.o > x.c AND y.c > x.c AND z.fall AND z.o > y.o AND {_in('z.c', 'x.c', 'y.c')}"),
    "xsidegap3methods": (_GAP_UP, _GAP_DOWN),
}


def pattern(name: str) -> str:
    """100, -100 or 0 as SQL over `seq`."""
    up, down = CONDITIONS[name]
    return f"CASE WHEN {up} THEN 100 WHEN {down} THEN -100 ELSE 0 END"
