"""Small change logs, and what must come of them by plain Python."""

import json
from collections import defaultdict
from datetime import datetime, timedelta, timezone

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MODIFICATIONS = (
    "delivery_id bigint, subscription_id string, file_no bigint, received_at timestamp, timestamp timestamp, namespace string, name string, lsn bigint, sequence bigint, before string, after string"
)
SCHEMAS = "entry_id bigint, subscription_id string, file_no bigint, received_at timestamp, timestamp timestamp, namespace string, name string, lsn bigint, spec string"


def at_second(s):
    return START + timedelta(seconds=s)


def us(s):
    return int(at_second(s).timestamp() * 1_000_000)


def image(value):
    return value if value is None or isinstance(value, str) else json.dumps(value)


def change(n, second, lsn, before, after, sequence=1, name="dogs", namespace="public", file_no=1, received=None, sub="s"):
    return (n, sub, file_no, at_second(second if received is None else received), at_second(second), namespace, name, lsn, None if lsn is None else sequence, image(before), image(after))


def schema_entry(n, second, lsn, columns, name="dogs", namespace="public"):
    spec = json.dumps({"columns": [c if isinstance(c, dict) else {"key": c[2] if len(c) > 2 else False, "name": c[0], "type": c[1]} for c in columns]})
    return (n, "s", 1, at_second(second), at_second(second), namespace, name, lsn, spec)


DOGS = schema_entry(1, 0, 1, [("id", 20, True), ("msg", 25), ("another", "text")])


def text(v):
    return v if isinstance(v, str) else json.dumps(v)


def events(rows, key="id"):
    """Row key → sorted states (ts, is_change, lsn, sequence, map or None)."""
    out = defaultdict(set)
    for r in rows:
        before, after = (json.loads(x) if x else None for x in (r[9], r[10]))
        order = (int(r[4].timestamp() * 1_000_000), int(r[7] is not None), r[7] or 0, (r[8] or 0) if r[7] is not None else 0)
        new = text(after[key]) if after and after.get(key) is not None else None
        old = text(before[key]) if before and before.get(key) is not None else None
        if new is not None:
            out[(r[5], r[6], new)].add((*order, tuple(sorted((k, text(v)) for k, v in after.items() if v is not None))))
        if old is not None and old != new:
            out[(r[5], r[6], old)].add((*order, None))
    return out


def present(rows):
    out = set()
    for k, e in events(rows).items():
        last = max(e, key=lambda x: x[:4])
        if last[4] is not None:
            out.add((*k, last[2], last[3]))
    return out


def versions(rows):
    out = []
    for k, e in events(rows).items():
        by_time = {x[0]: x[4] for x in sorted(e, key=lambda x: x[:4])}
        now, since = None, None
        for t in sorted(by_time):
            if by_time[t] != now:
                if now is not None:
                    out.append((*k, since, t, now))
                now, since = by_time[t], t
        if now is not None:
            out.append((*k, since, 0, now))
    return sorted(out)


def random_log(rng, n, keys=4, imports=True):
    """Deliveries of a consistent log over a few rows: ties in time, repeats, key changes, deletes, imports, in random order."""
    rows, state, lsn, second = [], {}, 100, 0
    for i in range(n):
        second += rng.choice([0, 0, 1, 2])
        lsn += rng.choice([1, 1, 5])
        key = rng.randrange(keys)
        old = state.get(key)
        kind = rng.random()
        if old is None:
            new = {"id": key, "msg": rng.choice("abc"), "another": None}
            row = change(i, second, lsn, None, new, rng.choice([1, 2]))
        elif kind < 0.2:
            new, row = None, change(i, second, lsn, {"id": key, "msg": None}, rng.choice([None, "null"]))
        elif kind < 0.3 and (target := next((k for k in range(keys) if state.get(k) is None), None)) is not None:
            new, row = None, change(i, second, lsn, old, {**old, "id": target})
            state[target] = {**old, "id": target}
        else:
            new = {**old, "msg": rng.choice("abc")}
            row = change(i, second, lsn, rng.choice([None, old]), new)
        state[key] = new
        rows.append(row)
        if imports and rng.random() < 0.2:
            k = rng.randrange(keys)
            if state.get(k) is not None:
                second += 1
                rows.append(change(1000 + i, second, None, None, state[k]))
                second += 1
        if rng.random() < 0.3:
            rows.append((2000 + i, *rng.choice(rows)[1:]))
    rng.shuffle(rows)
    return rows
