"""Brute-force reference models (plain Python) used by the unit tests."""

from decimal import Decimal


def replay_clamped(events):
    """H-03: events = [(key, order, type, qty)] → {key: (balance, created_order)}."""
    out = {}
    for key in sorted({e[0] for e in events}):
        bal, created, per = Decimal(0), None, []
        for _k, order, typ, q in sorted(e for e in events if e[0] == key):
            before = bal
            bal = max(Decimal(0), bal + (q if typ == "BUY" else -q))
            if before == 0 and bal > 0 or created is None and bal > 0:
                created = order if before == 0 else created
            if bal == 0:
                created = None
            per.append(bal)
        out[key] = (bal, created, per)
    return out


def replay_gate(events):
    """K-02: sells refused when the holding is absent or too small."""
    out = {}
    for key in sorted({e[0] for e in events}):
        bal, res = Decimal(0), []
        for _k, order, typ, q in sorted(e for e in events if e[0] == key):
            if typ == "BUY":
                bal += q
                res.append(True)
            elif bal > 0 and bal >= q:
                bal -= q
                res.append(True)
            else:
                res.append(False)
        out[key] = (bal, res)
    return out


def bucket(times_us, rate, burst):
    """W-03 leaky bucket over one client's sorted request times (µs)."""
    a, b = rate
    den = b * 1_000_000
    excess, last, refused = None, None, []
    for t in times_us:
        new = 0 if excess is None else max(0, excess - a * (t - last) + den)
        if new > burst * den:
            refused.append(True)
        else:
            excess, last = new, t
            refused.append(False)
    return refused
