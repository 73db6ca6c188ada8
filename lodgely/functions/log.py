"""Column expressions over the request log: status, action, retry and waiting time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host

# Marks of challenge pages, statuses and what follows from them.
CHALLENGE_MARKS = ("just a moment", "challenges.cloudflare.com", "cf-chl-", "attention required! | cloudflare")
STATUS_CODES = {400: "bad_request", 401: "unauthorized", 404: "not_found", 429: "rate_limited"}
ACTIONS = {"success": "parse", "rate_limited": "cooldown", "server_error": "retry_later", "timeout": "retry_later", "connection_error": "retry_later"}
RETRIED = ("timeout", "connection_error", "server_error")
COOLDOWNS = (60, 300, 900, 1800)


def classify(code: Column, html: Column) -> Column:
    """Crawl status of a response. A page of code 2xx or 403 with a challenge's marks is a challenge."""
    body = F.lower(F.coalesce(html, F.lit("")))
    challenge = F.greatest(*[F.contains(body, F.lit(m)) for m in CHALLENGE_MARKS])
    fine = (code >= 200) & (code < 300)
    status = F.when(((code == 403) | fine) & challenge, "cloudflare_challenge").when(code == 403, "access_denied").when(fine, "success")
    for number, name in STATUS_CODES.items():
        status = status.when(code == number, name)
    return status.when((code >= 500) & (code < 600), "server_error").otherwise("unknown")


def decide(status: Column) -> Column:
    action = F.when(F.lit(False), "stop")
    for name, what in ACTIONS.items():
        action = action.when(status == name, what)
    return action.otherwise("stop")


def should_retry(status: Column, attempt: Column, most: int = 3) -> Column:
    return F.coalesce(status.isin(*RETRIED) & (attempt < most), F.lit(False))


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 30.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))


def cooldown_seconds(status: Column, attempt: Column) -> Column:
    limited = F.when(attempt <= 1, COOLDOWNS[0]).when(attempt == 2, COOLDOWNS[1]).when(attempt == 3, COOLDOWNS[2]).otherwise(COOLDOWNS[3])
    return F.when(status == "rate_limited", limited).when(status == "server_error", F.least(F.lit(120), 30 * F.greatest(attempt, F.lit(1)))).otherwise(0).cast("int")


def strategy(url: Column, browser_domains: tuple[str, ...] = ()) -> Column:
    """browser for hosts that are one of the domains or below it, else http."""
    h = F.coalesce(host(url), F.lit(""))
    hit = F.lit(False)
    for d in browser_domains:
        hit = hit | (h == d) | h.endswith("." + d)
    return F.when(hit, "browser").otherwise("http")
