"""DuckDB answers for the streaming queries."""

from __future__ import annotations

from . import nexmark
from .generated import ONE

STEPPED = "SELECT event_id AS id, value + 1 AS price FROM events"
QUANTITY = "CAST(user_id % 10 + 1 AS INTEGER)"


def statements() -> dict[str, str]:
    hour = nexmark.HOUR

    def hot(source: str, key: str) -> str:
        return (
            f"WITH {source}, {nexmark.hops('ev', key, 'us', 2 * hour, hour // 2)} "
            f"SELECT w // 1000 AS w_start, (w + {2 * hour}) // 1000 AS w_end, {key}, num FROM hot"
        )

    def sellers(join: str, auction: str) -> str:
        return (
            f"WITH {nexmark.EVENT_US}, p AS (SELECT * FROM ev WHERE event_type = 'signup'), a AS (SELECT * FROM ev WHERE event_type = 'purchase') "
            f"SELECT p.user_id AS person_id, 'user_' || p.user_id AS name, p.us // {nexmark.SIX_HOURS} * {nexmark.SIX_HOURS} // 1000 AS starttime, "
            f"{auction} AS auction_id, {ONE} FROM a {join} p ON p.user_id = a.user_id AND p.us // {nexmark.SIX_HOURS} = a.us // {nexmark.SIX_HOURS}"
        )

    return {
        "src_stream_datagen": f"SELECT event_id AS id, value AS price, {QUANTITY} AS quantity FROM events",
        "stream_price_lateral": STEPPED,
        "stream_price_native": STEPPED,
        "stream_vectorised_calc": (
            "SELECT l_orderkey AS id, round(l_extendedprice * l_quantity + ln(l_extendedprice + 1), 3) "
            "AS value FROM lineitem"
        ),
        "stream_statement_set": (
            "SELECT 'stepped' AS sink, event_id AS id, round(value + 1, 3) AS value FROM events "
            "UNION ALL SELECT 'valued' AS sink, event_id AS id, "
            f"round(value * {QUANTITY} + ln(value + 1), 3) AS value FROM events"
        ),
        "stream_nexmark_q5": hot("ev AS (SELECT user_id % 100 AS auction, epoch_us(ts) AS us FROM events)", "auction"),
        "stream_nexmark_q8": sellers("JOIN", "a.event_id"),
        "stream_nexmark_q8_outer": sellers("LEFT JOIN", "CASE WHEN p.user_id IS NOT NULL THEN a.event_id END"),
        "stream_ev_hot_types": hot(nexmark.EVENT_US, "event_type"),
    }
