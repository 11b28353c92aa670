"""Row-by-row replica of the classification rules (test oracle only; small inputs)."""

from __future__ import annotations

from datetime import datetime, timedelta


def _common(a, b):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def _ratio(a, b):
    size = len(a) + len(b)
    return (1.0 - (size - 2 * _common(a, b)) / size) * 100 if size else 100.0


def similarity(a, b):
    """Company, sorted title and location with weights 0.1, 0.6, 0.3."""
    (c1, t1, l1), (c2, t2, l2) = a.split("|"), b.split("|")
    t1, t2 = (" ".join(sorted(t.split())) for t in (t1, t2))
    return (0.1 * _ratio(c1, c2) + 0.6 * _ratio(t1, t2) + 0.3 * _ratio(l1, l2)) / 100.0


def classify_sequential(entities: list[dict], batch: list[dict], now: datetime, window_days=30, threshold=0.90):
    """entities: dicts with id, entity_seq, company_id, signature, status, last_seen, first_seen,
    source_identifier; batch: dicts with batch_seq, company_id, signature, source_identifier.
    Returns (decisions by batch_seq -> (decision, entity_key, target_key), final records)."""
    known = {}
    for e in sorted(entities, key=lambda e: e["entity_seq"]):
        known["K:" + e["id"]] = dict(e)
    cutoff = now - timedelta(days=window_days)
    out = {}
    for r in sorted(batch, key=lambda r: r["batch_seq"]):
        sid = r["source_identifier"]
        hit = None
        if sid:
            for k, j in known.items():
                if j["company_id"] == r["company_id"] and j["source_identifier"] == sid:
                    hit = k
                    break
        if hit:
            j = known[hit]
            j["last_seen"] = now
            if j["status"] == "missing":
                j["status"] = "active"
            out[r["batch_seq"]] = ("existing", hit, None)
            continue

        def best(cands):
            best_sig, best_score = None, 0.0
            for j in cands:
                s = similarity(r["signature"], j["signature"])
                if s > best_score:
                    best_score, best_sig = s, j["signature"]
            if best_score >= threshold:
                for k, j in known.items():
                    if j in cands and j["signature"] == best_sig:
                        return k, best_score
            return None, best_score

        recent = [j for j in known.values() if j["company_id"] == r["company_id"] and j["last_seen"] >= cutoff
                  and j["status"] != "closed"]
        k, s = best(recent) if recent else (None, 0.0)
        if k:
            me = "B:%d" % r["batch_seq"]
            known[me] = {"id": me, "company_id": r["company_id"], "signature": r["signature"], "status": "active",
                         "last_seen": now, "first_seen": now, "source_identifier": sid}
            out[r["batch_seq"]] = ("repost", me, k)
            continue
        closed = [j for j in known.values() if j["company_id"] == r["company_id"] and j["status"] == "closed"]
        k, s = best(closed) if closed else (None, 0.0)
        if k:
            j = known[k]
            j.update(status="reopened", last_seen=now, source_identifier=sid)
            out[r["batch_seq"]] = ("reopened", k, k)
            continue
        me = "B:%d" % r["batch_seq"]
        known[me] = {"id": me, "company_id": r["company_id"], "signature": r["signature"], "status": "active",
                     "last_seen": now, "first_seen": now, "source_identifier": sid}
        out[r["batch_seq"]] = ("new", me, None)
    return out, known
