"""Hand rows to an injected sender, from the executors."""

from __future__ import annotations

import logging
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame

logger = logging.getLogger(__name__)


def deliver(messages: DataFrame, sender: Callable[..., None], *before: str) -> None:
    """Call `sender` with `before` and the only column of every row; a failed send is logged and
    skipped.

    A sender that is a context manager is entered once per task, around all that the task sends,
    so it can keep a connection or a file open.
    """

    def send_all(rows) -> None:
        with sender if hasattr(sender, "__exit__") else nullcontext():
            for row in rows:
                try:
                    sender(*before, row[0])
                except Exception as error:  # a sink outage must not fail the job
                    logger.warning("delivery failed: %s", error)

    messages.foreachPartition(send_all)
