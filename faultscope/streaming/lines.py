"""The stateless part of the work on a stream of lines.

Matching, payloads and masking look at one line at a time, so they run unchanged
on a stream. Numbers, block context, aggregates and rules need a whole artifact:
they run per batch of finished artifacts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultscope.functions.secrets import sanitize
from faultscope.operators.signatures import match_signatures
from faultscope.plans.diagnosis import Diagnosis, diagnose_lines
from faultscope.schema import KEY
from faultscope.sources.artifacts import explode_lines


def stream_facts(lines: DataFrame) -> DataFrame:
    """Raw facts of a streaming ``lines`` table, excerpts and payload values masked."""
    raw = match_signatures(lines)
    return raw.withColumns({"excerpt": sanitize(F.col("excerpt"))["text"],
                            "data": F.transform_values("data", lambda k, v: sanitize(v)["text"])})


def diagnose_stream(artifacts: DataFrame, sink: Callable[[Diagnosis, int], None], checkpoint: str,
                    **trigger) -> StreamingQuery:
    """Diagnose finished artifacts of a stream ``(family, artifact, text)``, batch by batch."""
    def work(batch: DataFrame, epoch: int) -> None:
        sink(diagnose_lines(explode_lines(batch), artifacts=batch.select(*KEY)), epoch)
    return artifacts.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()
