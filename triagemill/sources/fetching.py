"""Pages of the web fetched host by host: a host's links are in one task, which keeps to the host's pace; what was fetched is kept as a table
and not fetched again.

A host with very many links takes as long as its pace asks, in one task that streams them; other hosts of the task go on meanwhile."""

from __future__ import annotations

import heapq
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.functions import urls as U
from triagemill.scratch import cut

#: (content type, body) of a link, or None.
Fetcher = Callable[[str], tuple[str, bytes] | None]
#: Requests a second to a host, tries of a link, and seconds that a failed host rests before the next try.
PER_SECOND, TRIES, REST = 2.0, 3, 1.0
PAGES = "link string, kind string, body binary, ok boolean"


class Pace:
    """When each host may be asked next."""

    def __init__(self, per_second: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.now, self.sleep = 1 / per_second, now, sleep
        self.next: dict[str, float] = defaultdict(float)

    def run(self, queues: dict[str, deque], ask: Callable[[str, object], float]) -> None:
        """Asks all that is queued, hosts in the order in which they may be; `ask` gives the seconds that the host rests beyond its pace."""
        ready = [(self.next[h], h) for h in queues]
        heapq.heapify(ready)
        while ready:
            at, host = heapq.heappop(ready)
            if (wait := at - self.now()) > 0:
                self.sleep(wait)
            # The gap is counted from the start of a request, so that no second has more of them than the pace.
            started = self.now()
            rest = ask(host, queues[host].popleft())
            self.next[host] = max(started + self.gap, self.now() + rest if rest else 0.0)
            if queues[host]:
                heapq.heappush(ready, (self.next[host], host))


def fetch(links: DataFrame, fetcher: Fetcher, per_second: float = PER_SECOND, tries: int = TRIES, tasks: int | None = None, rest: float = REST) -> DataFrame:
    """(link, kind, body, ok) of distinct links (link); a link that fails is tried again at its host's pace, up to `tries` times in all."""
    n = tasks or int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second)
        for frame in frames:
            queues: dict[str, deque] = defaultdict(deque)
            for host, link in zip(frame["host"], frame["link"]):
                queues[host].append((link, 1))
            out: list[tuple] = []

            def ask(host: str, item: tuple[str, int]) -> float:
                link, turn = item
                try:
                    found = fetcher(link)
                    out.append((link, *(found or ("", b"")), found is not None))
                    return 0.0
                except Exception:  # noqa: BLE001 - whatever a site does, the others go on
                    if turn < tries:
                        queues[host].append((link, turn + 1))
                        return rest
                    out.append((link, "", b"", False))
                    return 0.0

            pace.run(queues, ask)
            yield pd.DataFrame(out, columns=["link", "kind", "body", "ok"])

    return links.select(U.host(F.col("link")).alias("host"), "link").repartition(n, "host").mapInPandas(ask_all, PAGES)


def fetch_new(links: DataFrame, fetcher: Fetcher, cache: str, **options) -> DataFrame:
    """(link, kind, body, ok) of all web links (link): those that the table `cache` has from there, the others fetched and, if they are pages, put there."""
    spark = links.sparkSession
    wanted = cut(links.where(F.lower("link").rlike("^https?://")).select("link").distinct())
    try:
        kept = spark.read.schema(PAGES).parquet(cache)
    except Exception:  # noqa: BLE001 - no page was ever kept
        kept = spark.createDataFrame([], PAGES)
    # Held apart from the table before that grows.
    known = cut(kept.join(wanted, "link", "left_semi"))
    fresh = cut(fetch(wanted.join(known.select("link"), "link", "left_anti"), fetcher, **options))
    fresh.where("ok").write.mode("append").parquet(cache)
    return known.unionByName(fresh)
