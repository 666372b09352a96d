"""Candlestick patterns as rules over a few bars: 100, -100 or 0; 0 too until there are enough bars.

A rule numbers bars from 1, the oldest of the pattern; 0 is the current bar. o, h, l, c are prices. Bn and Sn: rises,
falls. Ln, Tn, Dn: long, short body, doji. LUn, LDn: long upper, lower shadow; sun, sdn: short; VUn, VDn: very short;
VLDn: very long lower. bodyn, midn, usn, lsn: sizes. NEAR(a, b), SAME(a, b) measure by the current bar. A
comparison with a missing price fails, but greatest() and least() skip it. All patterns of a request share one window:
prices are lagged once.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..plans.planner import Native, number

_ATOMS = {
    "B": "c{n} > o{n}", "S": "c{n} < o{n}",
    "body": "abs(o{n} - c{n})", "mid": "(o{n} + c{n}) / 2", "us": "h{n} - greatest(o{n}, c{n})", "ls": "least(o{n}, c{n}) - l{n}",
    "L": "body{n} > 0.05e0 * (o{n} + c{n}) * 0.5e0", "T": "body{n} < 0.1e0 * (o{n} + c{n}) * 0.5e0", "D": "body{n} <= 0.005e0 * (o{n} + c{n}) * 0.5e0",
    "LU": "us{n} > 2 * body{n}", "LD": "ls{n} > 2 * body{n}", "su": "us{n} < 0.5e0 * body{n}", "sd": "ls{n} < 0.5e0 * body{n}",
    "VU": "us{n} < 0.1e0 * body{n}", "VD": "ls{n} < 0.1e0 * body{n}", "VLD": "ls{n} > 3 * body{n}",
}
_ATOM = re.compile(r"\b(VLD|VU|VD|LU|LD|su|sd|us|ls|body|mid|B|S|L|T|D)(\d)\b")

_TASUKI = ("B1; B2; o2 > c1; S0; o0 > o2; o0 < c2; c0 > o1; c0 < c1", "S1; S2; o2 < c1; B0; o0 > c2; o0 < o2; c0 > c1; c0 < o1")
_KICK = ("S1; L1; VU1; VD1; B0; L0; VU0; VD0; o0 > o1", "B1; L1; VU1; VD1; S0; L0; VU0; VD0; o0 < o1")
_THREE = "L1; T2; T3; T4; greatest(h2, h3, h4) < h1; least(l2, l3, l4) > l1; L0; "

#: name: (bars, rule of 100, rule of -100)
RULES: dict[str, tuple[int, str, str]] = {
    "CDL2CROWS": (3, "", "B1; L1; S2; o2 > c1; S0; o0 > c2; o0 < o2; c0 > o1; c0 < c1"),
    "CDL3BLACKCROWS": (3, "", "S1; L1; S2; L2; S0; L0; o2 > c1; o2 < o1; o0 > c2; o0 < o2; c2 < c1; c0 < c2"),
    "CDL3INSIDE": (3, "S1; L1; B2; c2 < o1; o2 > c1; B0; c0 > o1", "B1; L1; S2; o2 < c1; c2 > o1; S0; c0 < o1"),
    "CDL3LINESTRIKE": (4, "S1; S2; S3; c2 < c1; c3 < c2; o2 > c1; o2 < o1; o3 > c2; o3 < o2; B0; o0 < c3; c0 > o1", "B1; B2; B3; c2 > c1; c3 > c2; o2 > o1; o2 < c1; o3 > o2; o3 < c2; S0; o0 > c3; c0 < o1"),
    "CDL3OUTSIDE": (3, "S1; B2; o2 <= c1; c2 >= o1; B0; c0 > c2", "B1; S2; o2 >= c1; c2 <= o1; S0; c0 < c2"),
    "CDL3STARSINSOUTH": (3, "S1; L1; LD1; S2; l2 > l1; c2 > c1; S0; T0; h0 < h2; l0 > l2", ""),
    "CDL3WHITESOLDIERS": (3, "B1; L1; B2; L2; B0; L0; o2 > o1; o2 <= c1; o0 > o2; o0 <= c2; c2 > c1; c0 > c2", ""),
    "CDLABANDONEDBABY": (3, "S1; L1; D2; h2 < l1; B0; l0 > h2", "B1; L1; D2; l2 > h1; S0; h0 < l2"),
    "CDLADVANCEBLOCK": (3, "", "B1; L1; B2; B0; o2 > o1; o2 <= c1; o0 > o2; o0 <= c2; c2 > c1; c0 > c2; body0 < body2"),
    "CDLBELTHOLD": (1, "B0; L0; VD0", "S0; L0; VU0"),
    "CDLBREAKAWAY": (5, "S1; L1; S2; o2 < c1; c3 < c2; B0; c0 > o2; c0 < c1", "B1; L1; B2; o2 > c1; c3 > c2; S0; c0 > c1; c0 < o2"),
    "CDLCLOSINGMARUBOZU": (1, "B0; L0; VU0", "S0; L0; VD0"),
    "CDLCONCEALBABYSWALL": (4, "S1; L1; VU1; VD1; S2; L2; VU2; VD2; c2 < c1; S3; h3 > c2; S0; L0; o0 > h3; c0 < l2", ""),
    "CDLCOUNTERATTACK": (2, "S1; L1; B0; L0; NEAR(c0, c1)", "B1; L1; S0; L0; NEAR(c0, c1)"),
    "CDLDARKCLOUDCOVER": (2, "", "B1; L1; S0; o0 > c1; c0 < c1 - body1 * PEN; c0 > o1"),
    "CDLDOJI": (1, "D0", ""),
    "CDLDOJISTAR": (2, "S1; L1; D0; mid0 < c1", "B1; L1; D0; mid0 > c1"),
    "CDLDRAGONFLYDOJI": (1, "D0; LD0; VU0", ""),
    "CDLENGULFING": (2, "S1; B0; o0 <= c1; c0 >= o1; o0 < c1 OR c0 > o1", "B1; S0; o0 >= c1; c0 <= o1; o0 > c1 OR c0 < o1"),
    "CDLEVENINGDOJISTAR": (3, "", "B1; L1; D2; least(o2, c2) > c1; S0; c0 < c1 - body1 * PEN"),
    "CDLEVENINGSTAR": (3, "", "B1; L1; T2; least(o2, c2) > c1; S0; c0 < c1 - body1 * PEN"),
    "CDLGAPSIDESIDEWHITE": (3, "B1; o2 > c1; B2; B0; NEAR(body0, body2); NEAR(o0, o2)", "S1; c2 < c1; B2; B0; NEAR(body0, body2); NEAR(o0, o2)"),
    "CDLGRAVESTONEDOJI": (1, "", "D0; LU0; VD0"),
    "CDLHAMMER": (2, "T0; LD0; VU0; S1", ""),
    "CDLHANGINGMAN": (2, "", "T0; LD0; VU0; B1"),
    "CDLHARAMI": (2, "S1; L1; B0; T0; o0 > c1; c0 < o1", "B1; L1; S0; T0; o0 < c1; c0 > o1"),
    "CDLHARAMICROSS": (2, "S1; L1; D0; greatest(o0, c0) < o1; least(o0, c0) > c1", "B1; L1; D0; greatest(o0, c0) < c1; least(o0, c0) > o1"),
    "CDLHIGHWAVE": (1, "T0; LU0; LD0; B0", "T0; LU0; LD0; S0"),
    "CDLHIKKAKE": (3, "h2 < h1; l2 > l1; c0 > h1; B0", "h2 < h1; l2 > l1; c0 < l1; S0"),
    "CDLHIKKAKEMOD": (4, "h2 < h1; l2 > l1; h3 < h2; l3 > l2; c0 > h1; B0", "h2 < h1; l2 > l1; h3 < h2; l3 > l2; c0 < l1; S0"),
    "CDLHOMINGPIGEON": (2, "S1; L1; S0; T0; o0 < o1; c0 > c1", ""),
    "CDLIDENTICAL3CROWS": (3, "", "S1; L1; S2; L2; S0; L0; SAME(o2, c1); SAME(o0, c2); c2 < c1; c0 < c2"),
    "CDLINNECK": (2, "", "S1; L1; B0; o0 < c1; NEAR(c0, c1)"),
    "CDLINVERTEDHAMMER": (2, "T0; LU0; VD0; S1", ""),
    "CDLKICKING": (2, *_KICK),
    "CDLKICKINGBYLENGTH": (2, *_KICK),
    "CDLLADDERBOTTOM": (5, "S1; L1; S2; c2 < c1; S3; c3 < c2; S4; LU4; B0; o0 > o4", ""),
    "CDLLONGLEGGEDDOJI": (1, "D0; LU0; LD0", ""),
    "CDLLONGLINE": (1, "L0; su0; sd0; B0", "L0; su0; sd0; S0"),
    "CDLMARUBOZU": (1, "L0; VU0; VD0; B0", "L0; VU0; VD0; S0"),
    "CDLMATCHINGLOW": (2, "S1; L1; S0; SAME(c0, c1)", ""),
    "CDLMATHOLD": (5, "B1; L1; T2; o2 > c1; T3; T4; least(l2, l3, l4) > o1; B0; c0 > c1", ""),
    "CDLMORNINGDOJISTAR": (3, "S1; L1; D2; greatest(o2, c2) < c1; B0; c0 > c1 + body1 * PEN", ""),
    "CDLMORNINGSTAR": (3, "S1; L1; T2; greatest(o2, c2) < c1; B0; c0 > c1 + body1 * PEN", ""),
    "CDLONNECK": (2, "", "S1; L1; B0; o0 < c1; NEAR(c0, l1)"),
    "CDLPIERCING": (2, "S1; L1; B0; o0 < c1; c0 > c1 + body1 * PEN; c0 < o1", ""),
    "CDLRICKSHAWMAN": (1, "D0; LU0; LD0; NEAR(us0, ls0)", ""),
    "CDLRISEFALL3METHODS": (5, _THREE + "B1; B0; c0 > c1", _THREE + "S1; S0; c0 < c1"),
    "CDLSEPARATINGLINES": (2, "S1; L1; B0; L0; SAME(o0, o1)", "B1; L1; S0; L0; SAME(o0, o1)"),
    "CDLSHOOTINGSTAR": (2, "", "T0; LU0; VD0; B1"),
    "CDLSHORTLINE": (1, "T0; greatest(us0, ls0) < 0.5e0 * body0; B0", "T0; greatest(us0, ls0) < 0.5e0 * body0; S0"),
    "CDLSPINNINGTOP": (1, "T0; least(us0, ls0) > body0; B0", "T0; least(us0, ls0) > body0; S0"),
    "CDLSTALLEDPATTERN": (3, "", "B1; L1; B2; L2; c2 > c1; B0; T0; c0 > c2; o0 > o2; o0 <= c2"),
    "CDLSTICKSANDWICH": (3, "S1; L1; B2; L2; o2 > c1; S0; L0; SAME(c0, c1)", ""),
    "CDLTAKURI": (1, "D0; VLD0; VU0", ""),
    "CDLTASUKIGAP": (3, *_TASUKI),
    "CDLTHRUSTING": (2, "", "S1; L1; B0; o0 < c1; c0 > c1; c0 < c1 + 0.5e0 * body1"),
    "CDLTRISTAR": (3, "D1; D2; D0; mid2 < mid1; mid0 > mid2", "D1; D2; D0; mid2 > mid1; mid0 < mid2"),
    "CDLUNIQUE3RIVER": (3, "S1; L1; S2; l2 < l1; c2 > l2; o2 > c1; o2 < o1; B0; T0; c0 < c2", ""),
    "CDLUPSIDEGAP2CROWS": (3, "", "B1; L1; S2; o2 > c1; c2 > c1; S0; o0 > o2; c0 > c1; c0 < c2"),
    "CDLXSIDEGAP3METHODS": (3, *_TASUKI),
}
#: Accepted by these; ignored where the rule has no PEN.
PENETRATION = {"CDLABANDONEDBABY": 0.3, "CDLDARKCLOUDCOVER": 0.5, "CDLEVENINGDOJISTAR": 0.3, "CDLEVENINGSTAR": 0.3, "CDLMATHOLD": 0.5, "CDLMORNINGDOJISTAR": 0.3, "CDLMORNINGSTAR": 0.3, "CDLPIERCING": 0.5, "CDLTHRUSTING": 0.3}


def _condition(rule: str, bars: int, penetration: float, price) -> str:
    if not rule:
        return "false"
    rule = " AND ".join(f"({part.strip()})" for part in rule.split(";"))
    while _ATOM.search(rule):
        rule = _ATOM.sub(lambda m: f"({_ATOMS[m[1]].format(n=m[2])})", rule)
    while m := re.search(r"(NEAR|SAME)\(", rule):  # arguments may hold brackets
        depth, k, comma = 1, m.end(), 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rule[k], 0)
            comma = k if rule[k] == "," and depth == 1 else comma
            k += 1
        share = "0.01e0" if m[1] == "NEAR" else "0.001e0"
        rule = f"{rule[: m.start()]}abs(({rule[m.end() : comma]}) - ({rule[comma + 1 : k - 1]})) < {share} * (h0 + l0) * 0.5e0{rule[k:]}"
    rule = rule.replace("PEN", f"{penetration}e0")
    return re.sub(r"\b([ohlc])(\d)\b", lambda m: price(m[1], bars - int(m[2]) if m[2] != "0" else 0), rule)


def expression(name: str, price, penetration: float | None = None) -> str:
    """SQL of a pattern; price(letter, lag) names a price."""
    bars, up, down = RULES[name]
    pen = PENETRATION.get(name, 0.3) if penetration is None else penetration
    return f"CASE WHEN {_condition(up, bars, pen, price)} THEN 100 WHEN {_condition(down, bars, pen, price)} THEN -100 ELSE 0 END"


def candle(name: str, open: str = "open", high: str = "high", low: str = "low", close: str = "close", penetration: float | None = None) -> Native:
    """A pattern of RULES as a request for plans.indicate()."""
    names = dict(zip("ohlc", (open, high, low, close), strict=True))
    tag = "_".join(names.values())

    def stages(s, t):
        lags = {f"__{tag}_{k}{n}": (number(v) if n == 0 else s.lag(number(v), n)) for k, v in names.items() for n in range(RULES[name][0])}
        return [lags, {"": F.expr(expression(name, lambda k, n: f"`__{tag}_{k}{n}`", penetration)).cast("int")}]

    return Native(stages)


def _named(name: str):
    def pattern(open="open", high="high", low="low", close="close", penetration: float | None = None) -> Native:
        return candle(name, open, high, low, close, penetration)

    pattern.__name__ = pattern.__qualname__ = name
    pattern.__doc__ = f"{RULES[name][0]}-bar pattern."
    return pattern


PATTERNS = {name: _named(name) for name in RULES}
globals().update(PATTERNS)
