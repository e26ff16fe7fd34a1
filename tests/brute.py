"""Rounds the slow and obvious way, for comparison on small inputs."""

from collections import defaultdict
from datetime import timedelta


def rounds(events, gap_minutes):
    """``events``: (user, time or None, label or None). Feature rows as dicts."""
    gap = timedelta(minutes=gap_minutes)
    by_user = defaultdict(list)
    for user, time, label in events:
        if user is not None:
            by_user[user].append((time, label))
    labels = sorted({label for user, _, label in events if None not in (user, label)})
    out = []
    for user, rows in by_user.items():
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        groups, prev = [], None
        for time, label in rows:
            if prev is None or (time is not None and time - prev > gap):
                groups.append([])
            groups[-1].append((time, label))
            prev = time
        prev_end = None
        for index, group in enumerate(groups, 1):
            times = [t for t, _ in group if t is not None]
            start, end = (min(times), max(times)) if times else (None, None)
            before = prev_end if times else None
            row = {
                "round_id": f"{user}_{index}",
                "user_id": user,
                "round_start": start,
                "round_end": end,
                "event_count": len(times),
                "duration_seconds": (end - start).total_seconds() if times else 0.0,
                "prev_round_end": before,
                "gap_since_prev_seconds": (start - before).total_seconds() if before else -1.0,
            }
            row |= {v: sum(label == v for _, label in group) for v in labels}
            out.append(row)
            prev_end = end or prev_end
    return sorted(out, key=lambda r: r["round_id"])
