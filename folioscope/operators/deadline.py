"""Work that has to be done by a deadline, with the Spark jobs that it starts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def within(spark: SparkSession, seconds: float, task: Callable):
    """What ``task`` gives, or its error; a TimeoutError if it isn't done in ``seconds``.

    The task's jobs run under a tag of their own. At the deadline all jobs of the tag are cancelled, and jobs that the task
    starts later are cancelled as they come, until it ends; a task that waits outside Spark is left to itself.
    """
    sc, tag, done, found = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event(), {}

    def run() -> None:
        sc.addJobTag(tag)
        try:
            found["value"] = task()
        except BaseException as e:  # noqa: BLE001: handed on to the caller
            found["error"] = e
        finally:
            done.set()

    threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True).start()
    if not done.wait(seconds):
        def stop() -> None:
            while not done.is_set() and spark._jsc is not None and not sc._jsc.sc().isStopped():
                sc.cancelJobsWithTag(tag)
                done.wait(0.2)

        sc.cancelJobsWithTag(tag)
        threading.Thread(target=stop, daemon=True).start()
        raise TimeoutError
    if "error" in found:
        raise found["error"]
    return found["value"]
