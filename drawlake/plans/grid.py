"""Backtest grids from tables of requests: guards per row, parameters distinct and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drawlake.spec import by_pool, clean_type, is_known_type


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``errors``: what is wrong with their parameters, empty for usable ones.

    A request has lottery_type, limits (array), seed_from, seed_to and ticket_count. A missing
    value is an error like a wrong one. These are the guards of ``run_grid``, for each row.
    """
    kind = clean_type("lottery_type")
    count, limits = F.col("ticket_count"), F.col("limits")
    wrong = {
        "pool": ~is_known_type(kind),
        "limits": F.coalesce((F.size(limits) == 0) | F.exists(limits, lambda n: F.coalesce(n <= 0, F.lit(True))), F.lit(True)),
        "seeds": F.coalesce(F.col("seed_to") < F.col("seed_from"), F.lit(True)),
        "count": F.coalesce(count <= 0, F.lit(True)),
        "combinations": F.coalesce(count > by_pool(kind, "combinations"), F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(test, name) for name, test in wrong.items()]))
    return requests.withColumns({"lottery_type": kind, "errors": errors})


def requested_grid(requests: DataFrame) -> DataFrame:
    """Grid points of all usable requests, each once, with the number of requests that ask for it.

    Repeated limits of a request count once, seeds are an inclusive range. Points expand
    from their requests where these lie and combine before they shuffle.
    """
    usable = checked_requests(requests).filter(F.size("errors") == 0)
    points = (
        usable.select(
            "lottery_type", "ticket_count", "seed_from", "seed_to",
            F.explode(F.array_sort(F.array_distinct("limits"))).alias("history_limit"),
        )
        .withColumn("seed", F.explode(F.sequence("seed_from", "seed_to")))
    )
    keys = ["lottery_type", "history_limit", "seed", "ticket_count"]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))
