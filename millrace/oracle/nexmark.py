"""DuckDB answers for the auction-stream queries and their event-table shapes."""

from __future__ import annotations

from .generated import AUCTIONS, BIDS, ONE, PERSONS

BOTH = (
    f"WITH persons AS (SELECT *, p_date_time AS p_ms FROM ({PERSONS})), "
    f"auctions AS (SELECT *, a_date_time AS a_ms FROM ({AUCTIONS}))"
)
WINDOW, HOP = 10 * 86_400_000, 2 * 86_400_000
Q3_HIT = "category = 10 AND state IN ('OR', 'ID', 'CA')"
SAME_WINDOW = f"p_id = seller AND p_ms // {WINDOW} = a_ms // {WINDOW}"


def hops(source: str, key: str, time: str, size: int, slide: int) -> str:
    """CTEs: copies of each row per hopping window, counts, and the winners."""
    return (
        f"first AS (SELECT min({time}) // {slide} * {slide} AS t0 FROM {source}), "
        f"copies AS (SELECT s.*, ({time} // {slide} - k) * {slide} AS w FROM {source} s, "
        f"(SELECT unnest(range({size // slide})) AS k)), "
        f"counts AS (SELECT w, {key}, count(*) AS num FROM copies, first WHERE w >= t0 GROUP BY ALL), "
        f"hot AS (SELECT * FROM counts QUALIFY rank() OVER (PARTITION BY w ORDER BY num DESC) = 1)"
    )


BID_HOPS = f"bids AS (SELECT *, row_number() OVER () AS rid FROM ({BIDS})), " + hops("bids", "auction", "date_time", WINDOW, HOP)
EVENT_US = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
HOUR = 3_600_000_000
SIX_HOURS = 6 * HOUR


def at(us: str) -> str:
    return f"make_timestamp({us})"


EV_HOT = (
    f"WITH {EVENT_US}, {hops('ev', 'event_type', 'us', 2 * HOUR, HOUR // 2)} "
    f"SELECT {at('w')} AS w_start, {at(f'w + {2 * HOUR}')} AS w_end, event_type, num FROM hot"
)
EV_BUYERS = (
    f"WITH {EVENT_US}, s AS (SELECT user_id, us // {SIX_HOURS} AS w, min(ts) AS signup_ts FROM ev "
    "WHERE event_type = 'signup' GROUP BY ALL) "
    f"SELECT ev.user_id, {at(f's.w * {SIX_HOURS}')} AS w_start, signup_ts, event_id FROM ev, s "
    f"WHERE event_type = 'purchase' AND ev.user_id = s.user_id AND us // {SIX_HOURS} = s.w"
)


def statements() -> dict[str, str]:
    return {
        "nexmark_q3": (
            f"{BOTH} SELECT CASE WHEN {Q3_HIT} THEN name END AS name, "
            f"CASE WHEN {Q3_HIT} THEN city END AS city, "
            f"CASE WHEN {Q3_HIT} THEN state END AS state, "
            f"CASE WHEN {Q3_HIT} THEN a_id END AS auction_id, {ONE} "
            "FROM auctions LEFT JOIN persons ON seller = p_id"
        ),
        "nexmark_q3_matches": (
            f"{BOTH} SELECT name, city, state, a_id AS auction_id, {ONE} "
            f"FROM auctions JOIN persons ON seller = p_id WHERE {Q3_HIT}"
        ),
        "nexmark_q5": (
            f"WITH {BID_HOPS}, best AS (SELECT rid, c.auction, max(h.num) AS num "
            "FROM copies c JOIN hot h ON c.w = h.w AND c.auction = h.auction GROUP BY ALL) "
            f"SELECT best.auction, best.num, {ONE} FROM bids LEFT JOIN best USING (rid)"
        ),
        "nexmark_q5_hot_items": (
            f"WITH {BID_HOPS} SELECT w AS w_start, w + {WINDOW} AS w_end, auction, num FROM hot"
        ),
        "nexmark_q8": (
            f"{BOTH} SELECT p_id AS person_id, name, p_ms // {WINDOW} * {WINDOW} AS starttime, "
            f"CASE WHEN p_id IS NOT NULL THEN a_id END AS auction_id, {ONE} "
            f"FROM auctions LEFT JOIN persons ON {SAME_WINDOW}"
        ),
        "nexmark_q8_matches": (
            f"{BOTH} SELECT p_id AS person_id, name, p_ms // {WINDOW} * {WINDOW} AS starttime, "
            f"a_id AS auction_id, {ONE} FROM auctions JOIN persons ON {SAME_WINDOW}"
        ),
        "nexmark_q8_active": (
            f"{BOTH} SELECT p_id AS person_id, name, p_ms // {WINDOW} * {WINDOW} AS starttime "
            f"FROM persons WHERE EXISTS (SELECT 1 FROM auctions WHERE {SAME_WINDOW})"
        ),
        "ev_hot_types": EV_HOT,
        "ev_new_user_buyers": EV_BUYERS,
    }
